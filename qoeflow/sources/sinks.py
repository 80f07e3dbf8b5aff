"""Decision sinks.

Batch forms return DataFrames; ``merge_latest`` is the streaming form
used from ``foreachBatch``: it adds a micro-batch to the latest-decision table
(``streaming.tables.MergeTable``), idempotent per batch id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_decision(decisions: DataFrame, order: str = "tick",
                    payload: list[str] | None = None) -> DataFrame:
    """Newest decision per group (one row per group); of several with the
    same ``order`` the one with the largest payload."""
    payload = payload or [c for c in decisions.columns if c not in ("group_id", order)]
    best = F.max_by(F.struct(*payload, F.col(order)), F.struct(F.col(order), *payload))
    return (decisions.groupBy("group_id").agg(best.alias("_b"))
            .select("group_id", *[F.col(f"_b.{c}").alias(c) for c in payload + [order]]))


def export_epsilon(decisions: DataFrame) -> DataFrame:
    """Epsilon-greedy decision -> ordered lines: epsilon, best, rest..."""
    lines = F.concat(F.array(F.col("epsilon").cast("string"), F.col("best")), F.col("rest"))
    return decisions.select("group_id", F.posexplode(lines).alias("pos", "line"))


def write_decision_files(lines: DataFrame, path: str) -> None:
    """One folder per group holding its lines, in order."""
    (lines.repartition("group_id").sortWithinPartitions("group_id", "pos")
     .select("group_id", "line").write.mode("overwrite").partitionBy("group_id").text(path))


def write_series(series: DataFrame, order: str, value: str, path: str) -> None:
    """A per-second series as text, ordered (range-partitioned sort)."""
    (series.orderBy(order).select(F.col(value).cast("string"))
     .write.mode("overwrite").text(path))


def latest_table(decisions: DataFrame, path: str, order: str = "tick"):
    """The table of the newest decision per group (``MergeTable``) for rows
    like ``decisions``."""
    from qoeflow.streaming.tables import MergeTable
    return MergeTable(decisions.sparkSession, path, decisions.schema, ["group_id"], order=[order])


def merge_latest(batch: DataFrame, table_path: str, version: int, order: str = "tick") -> DataFrame:
    """Streaming S7: merge a micro-batch into the latest-decision table, newest
    per group by ``order`` (equal ones: the later batch); returns the table.
    Re-running a batch id rewrites its own rows, so the sink is idempotent."""
    table = latest_table(batch, table_path, order)
    table.merge(latest_decision(batch, order), version)
    return table.read(before=version + 1)
