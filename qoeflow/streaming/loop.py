"""The decision loop (the main streaming program), end to end, for any policy.

Updates arrive as JSON messages; every micro-batch is one tick, as in the
reference (a record counts in the batch it arrives in).  Per batch, in
``foreachBatch``:

1. parse the messages (P1, rejects kept apart), sum and count per
   (group, decision) -- the tick's stats (A2);
2. ``policy.advance`` gives the rows of the state that change (discounted
   sums of the groups in the batch: J4, idle groups decay when they are read; a
   sliding window: the batch's sums as its newest tick).  They are merged into
   the state table, ``tables.MergeTable`` in buckets by group: only the buckets
   of the batch's groups are read for it, and what is written follows the batch;
3. ``policy.decide`` for every group (T8) and write ``policy.message`` (P12,
   or the epsilon-greedy form) under ``batch_id=<n>``.

Both outputs are overwritten per batch id and a batch reads the state below its
own id only, so a batch that runs again gives the same state and decisions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qoeflow.operators.policy import Policy
from qoeflow.operators.records import parse_updates
from qoeflow.session import scratch_path
from qoeflow.streaming.jobs import run_available_now, run_slices, start_stream
from qoeflow.streaming.tables import MergeTable
from qoeflow.streaming.topics import spool_source


def state_table(spark: SparkSession, base: str, policy: Policy) -> MergeTable:
    """The loop's kept state below ``base``."""
    return MergeTable(spark, f"{base}/state", policy.state_schema, policy.state_keys, by=["group_id"],
                      alive=policy.alive if policy.window_ticks else None)


def decision_loop_sink(base: str, labels: list[str], policy: Policy, origin: str,
                       topic: tuple[str, str, dict] | None = None):
    """``topic`` = (name, format, options) also publishes the decision
    messages, e.g. ("decision", "kafka", {"kafka.bootstrap.servers": ...});
    a file format writes one folder per batch id under options["path"]."""
    def sink(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        df = df.persist()
        try:
            good, bad = parse_updates(df, labels)
            bad.select("value").write.mode("overwrite").parquet(f"{base}/rejects/batch_id={batch_id}")
            new = good.groupBy("group_id", "decision").agg(F.sum("score").alias("score_sum"),
                                                           F.count(F.lit(1)).alias("n"))
            table = state_table(spark, base, policy)
            table.merge(policy.advance(new, table.read(before=batch_id, of=new), batch_id), batch_id)
        finally:
            df.unpersist()
        state = table.read(before=batch_id + 1)
        dec = policy.message(policy.decide(policy.current(state, batch_id)), origin)
        dec = dec.withColumn("tick", F.lit(batch_id).cast("bigint"))
        dec.write.mode("overwrite").parquet(f"{base}/decisions/batch_id={batch_id}")
        if topic:
            name, fmt, opts = topic
            msgs = spark.read.parquet(f"{base}/decisions/batch_id={batch_id}").select(
                F.lit(name).alias("topic"), F.col("message").alias("value"))
            if fmt == "kafka":
                msgs.write.format("kafka").options(**opts).save()
            else:
                msgs.write.mode("overwrite").format(fmt).save(f"{opts['path']}/batch_id={batch_id}")
    return sink


def decision_loop(updates: DataFrame, base: str, labels: list[str], policy: Policy,
                  origin: str, trigger: dict | None = None, topic: tuple[str, str, dict] | None = None):
    """Start the decision loop on any stream of update messages (a
    ``value`` column): a spool folder, or a topic via
    ``topics.read_topic(spark, "kafka", {...})``.  State, decisions and
    rejects are versioned under ``base`` (a shared folder); returns the
    running query."""
    return start_stream(updates.select("value"), decision_loop_sink(base, labels, policy, origin, topic),
                        f"{base}/ckpt", trigger=trigger)


def decision_loop_job(spark: SparkSession, messages: DataFrame, labels: list[str],
                      policy: Policy, origin: str, n_files: int = 6) -> DataFrame:
    """Spool of update messages -> per-tick state and decisions; returns
    the newest decision per group."""
    from qoeflow.sources.sinks import latest_decision
    base = scratch_path(spark, "decision-loop")
    sink = decision_loop_sink(base, labels, policy, origin)
    run_slices(messages, base, "seq", n_files,
               lambda: run_available_now(spool_source(spark, f"{base}/in/*"), sink, f"{base}/ckpt"),
               "text", ["value"])
    return latest_decision(spark.read.parquet(f"{base}/decisions").drop("batch_id"), "tick")


def ingest_then_decide_job(spark: SparkSession, messages: DataFrame, assign: DataFrame, me: str,
                           labels: list[str], keep: list[str], policy: Policy,
                           origin: str) -> DataFrame:
    """M4 -> T1 through a topic folder: the ingest stream routes the spool
    to topic folders; the decision loop streams the ``internal_groups``
    topic (this cluster's groups, reduced updates) and decides.  All of the
    topic's files are one micro-batch here, i.e. one tick."""
    from qoeflow.sources.sinks import latest_decision
    from qoeflow.streaming.jobs import ingest_job
    topics = ingest_job(spark, messages, assign, me, labels, keep, return_path=True)
    schema = spark.read.parquet(topics).drop("topic", "batch_id").schema
    internal = spark.readStream.schema(schema).parquet(f"{topics}/*/topic=internal_groups")
    base = scratch_path(spark, "ingest-decide")
    run_available_now(internal.select("value"), decision_loop_sink(base, keep, policy, origin),
                      f"{base}/ckpt")
    return latest_decision(spark.read.parquet(f"{base}/decisions").drop("batch_id"), "tick")
