"""M3: the frontend failover report.

Round-robin sessions over frontends; a failed request falls back to a
fixed local decision at its plain cost; then means over blocks of
``block`` consecutive records per frontend (short tail dropped), the two
series zipped by block number, and the gap in block counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qoeflow.functions import exact_mean4, scaled_units
from qoeflow.operators.ordinals import ordinal_by_number


def round_robin(sessions: DataFrame, n_frontends: int, line_no: str = "line_no",
                decision: str = "decision", ok: str = "ok", local_pos: int = 3) -> DataFrame:
    """W4 + K9: frontend = line_no mod n; failed -> local fallback
    (``local_pos``-th decision in sorted key order, last if fewer)."""
    keys = F.array_sort(F.map_keys("decision_map"))
    local = F.get(keys, F.least(F.lit(local_pos), F.size(keys)) - 1)   # null if the map is empty
    chosen = F.when(F.col(ok), F.col(decision)).otherwise(local)
    return (sessions.withColumn("url_idx", F.pmod(F.col(line_no), F.lit(n_frontends)).cast("int"))
                    .withColumn("mode", F.when(F.col(ok), "online").otherwise("local"))
                    .withColumn("chosen", chosen)
                    .withColumn("cost", F.element_at("decision_map", chosen)))


def cost_by_mode(log: DataFrame) -> DataFrame:
    """Outcome count and mean cost per (frontend, mode); costs have two
    decimals, so the mean is exact to four places (integer sums)."""
    sums = log.groupBy("url_idx", "mode").agg(F.count(F.lit(1)).alias("n"), F.sum(scaled_units("cost", 2)).alias("_u"))
    return sums.select("url_idx", "mode", "n", exact_mean4("_u", "n", 2).alias("avg_cost"))


def two_series(log: DataFrame, src: str = "url_idx") -> DataFrame:
    """The report's two series: frontend 0, and every other one together."""
    return log.withColumn(src, F.when(F.col(src) == 0, F.lit(0)).otherwise(F.lit(1)).cast(log.schema[src].dataType))


def block_means(log: DataFrame, block: int, src: str = "url_idx", line_no: str = "line_no") -> DataFrame:
    """W2 + A12: mean of every ``block`` consecutive records per source
    (line numbers are unique integers: arithmetic buckets, no checkpoint).
    For the report of more than two frontends pass ``two_series(log)``."""
    o = ordinal_by_number(log, [src], line_no, "_ord")
    return (o.withColumn("block", F.floor((F.col("_ord") - 1) / block).cast("bigint"))
             .groupBy(src, "block").agg(F.avg("cost").alias("mean_cost"), F.count(F.lit(1)).alias("_n"))
             .where(F.col("_n") == block).drop("_n"))


def block_zip(means: DataFrame, a: int = 0, b: int = 1, src: str = "url_idx") -> DataFrame:
    """K-th block of source a with k-th block of source b, cut to the
    shorter series: one pass, blocks that both have."""
    one = lambda k: F.max(F.when(F.col(src) == k, F.col("mean_cost")))
    return (means.where(F.col(src).isin(a, b)).groupBy("block").agg(one(a).alias("mean_a"), one(b).alias("mean_b"))
            .where("mean_a is not null and mean_b is not null"))


def block_gap(means: DataFrame, a: int = 0, b: int = 1, src: str = "url_idx") -> DataFrame:
    """|blocks(a) - blocks(b)| as one row."""
    c = means.agg(F.count_if(F.col(src) == a).alias("n_blocks_a"),
                  F.count_if(F.col(src) == b).alias("n_blocks_b"))
    return c.withColumn("gap", F.abs(F.col("n_blocks_a") - F.col("n_blocks_b")))
