"""Streaming jobs (M4, T7, T9, T1 end to end) run to completion.

Each job stages its input as consecutive slices (one parallel write), then
reveals slice after slice to a file stream and runs the query on the same
checkpoint until the slice is worked off: a slice is one micro-batch, read by
as many tasks as it has files.  Sinks write with ``foreachBatch`` into
``<out>/batch_id=<n>`` (overwrite), so a replayed batch rewrites its own
output: idempotent sinks on top of the checkpointed file source give
exactly-once results.  All folders live under the shared checkpoint folder
(``session.scratch_path``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qoeflow.session import file_system, list_folder, scratch_path


def batch_sink(out: str, partition_by: list[str] | None = None):
    """foreachBatch writer: one overwrite-folder per batch id."""
    def sink(df: DataFrame, batch_id: int) -> None:
        w = df.write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(f"{out}/batch_id={batch_id}")
    return sink


class session_conf:
    """Set session confs for the duration of a ``with`` block (restored
    after).  A streaming query clones the session when it starts, so confs
    read at start -- the state partition count, the state store provider --
    can be set for one query without changing the caller's session."""

    def __init__(self, spark: SparkSession, confs: dict):
        self.spark, self.confs, self.before = spark, confs, {}

    def __enter__(self):
        for k, v in self.confs.items():
            self.before[k] = self.spark.conf.get(k, None)
            self.spark.conf.set(k, v)

    def __exit__(self, *exc):
        for k, v in self.before.items():
            if v is None:
                self.spark.conf.unset(k)
            else:
                self.spark.conf.set(k, v)


def state_partitions(spark: SparkSession) -> dict:
    """Shuffle/state partitions for a job's stateful stream: the cluster's
    cores (fixed in the checkpoint at the first start)."""
    return {"spark.sql.shuffle.partitions": str(spark.sparkContext.defaultParallelism)}


def start_stream(df: DataFrame, sink, checkpoint: str, mode: str = "append",
                 trigger: dict | None = None, confs: dict | None = None):
    """Start ``df`` into a foreachBatch ``sink``.  ``trigger`` sets the pace
    (T2), e.g. ``{"processingTime": "2 seconds"}`` like the reference's
    decision interval; default: process what is available and stop.
    ``confs`` apply to this query only (see ``session_conf``)."""
    with session_conf(df.sparkSession, confs or {}):
        return (df.writeStream.outputMode(mode).foreachBatch(sink)
                .option("checkpointLocation", checkpoint)
                .trigger(**(trigger or {"availableNow": True})).start())


def finish(query, timeout_s: float | None = None):
    """Wait until ``query`` ends; an error in it is raised here.  With a limit,
    a query that needs longer is stopped and raises, so partial output is
    never taken for the result."""
    if timeout_s is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError(f"the streaming query needs more than {timeout_s} s")
    return query.recentProgress


def run_available_now(df: DataFrame, sink, checkpoint: str, timeout_s: float | None = None,
                      mode: str = "append", confs: dict | None = None):
    """Run ``df`` into ``sink`` until all input there is now is worked off."""
    confs = {**state_partitions(df.sparkSession), **(confs or {})}
    return finish(start_stream(df, sink, checkpoint, mode, confs=confs), timeout_s)


def stage_slices(df: DataFrame, base: str, order: str, n_slices: int, fmt: str = "parquet",
                 cols: list[str] | None = None) -> list[str]:
    """Write ``df`` below ``base`` as consecutive slices of the integer
    ``order`` in one parallel job; rows without an order value are in the
    first.  The bounds are one scalar aggregate.  Returns the slices' folders
    in order."""
    spark = df.sparkSession
    lo, hi = df.select(F.min(order), F.max(order)).first()
    step = 1 if lo is None else (hi - lo) // n_slices + 1
    part = F.coalesce(F.floor((F.col(order) - F.lit(lo)) / F.lit(step)).cast("int"), F.lit(0))
    (df.select(*(cols or df.columns), part.alias("_slice"))
     .write.partitionBy("_slice").format(fmt).save(f"{base}/staged"))
    names = [x for x in list_folder(spark, f"{base}/staged") if x.startswith("_slice=")]
    return [f"{base}/staged/{x}" for x in sorted(names, key=lambda x: int(x.split("=")[1]))]


def reveal(spark: SparkSession, folder: str, into: str, k: int) -> None:
    """Move a staged slice (a rename, no copy) to where the stream looks."""
    fs, target = file_system(spark, f"{into}/slice-{k:06d}")
    fs.mkdirs(target.getParent())
    if not fs.rename(file_system(spark, folder)[1], target):
        raise OSError(f"cannot move {folder} to {into}")


def run_slices(df: DataFrame, base: str, order: str, n_slices: int, run: Callable[[], object],
               fmt: str = "parquet", cols: list[str] | None = None) -> None:
    """Stage ``df`` and call ``run`` (a query on ``<base>/in/*`` that ends when
    its input is worked off) once per slice."""
    for k, folder in enumerate(stage_slices(df, base, order, n_slices, fmt, cols)):
        reveal(df.sparkSession, folder, f"{base}/in", k)
        run()


def combine(updates: DataFrame) -> DataFrame:
    """Sums per (group, decision, tick) of each Arrow batch, before any shuffle:
    (group_id, decision, tick, s, c).  Stateless, so it may stand before a
    stateful operator, which then never sees raw rows of a busy group."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            t = pa.Table.from_batches([b]).group_by(["group_id", "decision", "tick"]).aggregate(
                [("cost", "sum"), ("tick", "count")])
            yield from pa.table({"group_id": t["group_id"], "decision": t["decision"], "tick": t["tick"],
                                 "s": pa.compute.negate(t["cost_sum"]),
                                 "c": t["tick_count"].cast("double")}).to_batches()
    return (updates.select("group_id", "decision", F.col("cost").cast("double").alias("cost"),
                           F.col("tick").cast("bigint").alias("tick"))
            .where("cost is not null and tick is not null")
            .mapInArrow(run, "group_id string, decision string, tick bigint, s double, c double"))


def decision_state_job(spark: SparkSession, updates: DataFrame, gamma: float,
                       n_files: int = 6, order: str = "tick") -> DataFrame:
    """T1 end to end: stage the updates as an ordered file stream, run the
    stateful fold, return the latest emitted state per (group, decision)."""
    from qoeflow.streaming.state import decision_stream, latest_state
    base = scratch_path(spark, "decision-state")
    cols = ["group_id", "decision", "cost", "tick"]
    schema = updates.select(*cols).schema

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{base}/in/*")
        run_available_now(decision_stream(stream, gamma), batch_sink(f"{base}/out"), f"{base}/ckpt", mode="update")

    run_slices(updates.select(*dict.fromkeys([*cols, order])), base, order, n_files, run, cols=cols)
    return latest_state(spark.read.parquet(f"{base}/out"))


def ingest_job(spark: SparkSession, messages: DataFrame, assign: DataFrame, me: str,
               labels: list[str], keep: list[str], n_files: int = 4, return_path: bool = False):
    """M4: spool folder -> upload topic (raw update) + processing topic
    (reduced update, cluster, internal/external) -> file topic sink; messages
    that cannot be read go to the ``rejects`` topic as they came."""
    from qoeflow.operators.records import route, split_messages
    from qoeflow.streaming.topics import spool_source
    base = scratch_path(spark, "ingest")
    none = F.lit(None).cast("string")

    def sink(df: DataFrame, batch_id: int) -> None:
        df = df.persist()
        try:
            good, bad = split_messages(df)
            r = route(good, assign, me, labels, keep)
            upload = r.select(F.lit("upload").alias("topic"), F.col("value"), none.alias("group_id"),
                              none.alias("cluster_id"), F.get_json_object("value", "$.update").alias("update"))
            proc = r.select("topic", F.col("message").alias("value"), "group_id", "cluster_id",
                            F.col("reduced").alias("update"))
            rejects = bad.select(F.lit("rejects").alias("topic"), "value", none.alias("group_id"),
                                 none.alias("cluster_id"), none.alias("update"))
            (upload.unionByName(proc).unionByName(rejects).write.mode("overwrite").partitionBy("topic")
             .parquet(f"{base}/topics/batch_id={batch_id}"))
        finally:
            df.unpersist()

    run_slices(messages, base, "seq", n_files,
               lambda: run_available_now(spool_source(spark, f"{base}/in/*"), sink, f"{base}/ckpt"),
               "text", ["value"])
    return f"{base}/topics" if return_path else spark.read.parquet(f"{base}/topics")


def topic_roundtrip_job(spark: SparkSession, messages: DataFrame, assign: DataFrame, me: str,
                        n_files: int = 4) -> DataFrame:
    """S1 -> S6: a file topic read as a stream, each row routed to the
    topic named in its row (stream-static lookup), written by the topic
    sink, read back."""
    from qoeflow.operators.records import lookup_cluster, parse_messages
    from qoeflow.streaming.topics import read_topic, write_topic
    base = scratch_path(spark, "topics")

    def run():
        src = read_topic(spark, "text", {"path": f"{base}/in/*"})
        routed = lookup_cluster(parse_messages(src), assign, me)
        out = routed.withColumn("topic", F.when(F.col("cluster_id") == me, "internal_groups")
                                .otherwise("external_groups"))
        finish(write_topic(out, "parquet", {"path": f"{base}/out"}, f"{base}/ckpt"))

    run_slices(messages, base, "seq", n_files, run, "text", ["value"])
    return spark.read.parquet(f"{base}/out")


def multi_sink_job(spark: SparkSession, messages: DataFrame, assign: DataFrame, me: str,
                   labels: list[str], keep: list[str], fraction: float, seed: str,
                   n_files: int = 4, managed: int = 2) -> DataFrame:
    """One input, several outputs per micro-batch (upload, processing
    topics, sampled feature histogram, heartbeat, rejects), the batch cached once and
    each output written idempotently under its batch id.  Returns the
    written rows' counts per sink."""
    from qoeflow.operators.exchange import feature_histogram
    from qoeflow.operators.records import route, split_messages
    from qoeflow.streaming.topics import spool_source
    base = scratch_path(spark, "multi-sink")

    def sink(df: DataFrame, batch_id: int) -> None:
        df = df.persist()
        try:
            good, bad = split_messages(df)
            r = route(good, assign, me, labels, keep)
            outs = {
                "rejects": bad.select("value"),
                "upload": r.select(F.get_json_object("value", "$.update").alias("value")),
                "processing": r.select("topic", F.col("message").alias("value")),
                # A6/R2 per batch: histogram of the sampled updates' features,
                # published as 'index;value;count'
                "sample": feature_histogram(r.withColumn("_k", F.get(F.col("fields"), 0)), fraction,
                                            managed, seed, key="_k")
                          .select(F.concat_ws(";", F.col("feature_idx").cast("string"), "value",
                                              F.col("n").cast("string")).alias("value")),
                "heartbeat": r.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_records"))
                              .withColumn("batch_id", F.lit(batch_id)),
            }
            for name, o in outs.items():
                o.write.mode("overwrite").parquet(f"{base}/{name}/batch_id={batch_id}")
        finally:
            df.unpersist()

    run_slices(messages, base, "seq", n_files,
               lambda: run_available_now(spool_source(spark, f"{base}/in/*"), sink, f"{base}/ckpt"),
               "text", ["value"])
    up = spark.read.parquet(f"{base}/upload").select(F.lit("upload").alias("sink"))
    pr = spark.read.parquet(f"{base}/processing").select(F.col("topic").alias("sink"))
    sm = spark.read.parquet(f"{base}/sample").select(F.lit("sample").alias("sink"))
    rj = spark.read.parquet(f"{base}/rejects").select(F.lit("rejects").alias("sink"))
    return up.unionByName(pr).unionByName(sm).unionByName(rj).groupBy("sink").agg(F.count(F.lit(1)).alias("n"))


def late_rows_job(spark: SparkSession, updates: DataFrame, width: str, lateness: str,
                  n_files: int = 4, order: str | None = None) -> DataFrame:
    """Tumbling-window counts under a watermark, input sliced out of time
    order (by ``order``, else by an md5 draw of ``event_id``); returns the
    windows emitted.  What comes later than ``lateness`` is not in them: use
    the decision streams, which fold late updates into the current tick, where
    every row has to count."""
    from qoeflow.functions import hash_u32
    base = scratch_path(spark, "late")
    key = F.col(order) if order else hash_u32(F.lit("late"), F.col("event_id"))
    # the instant of a TIMESTAMP_NTZ read as UTC, whatever the session time zone
    src = updates.select(F.timestamp_seconds(F.unix_timestamp("ts")).alias("ts"), "decision", key.alias("_shuffle"))

    def run():
        stream = spark.readStream.schema("ts timestamp, decision string").parquet(f"{base}/in/*")
        agg = (stream.withWatermark("ts", lateness)
               .groupBy(F.window("ts", width).alias("w"), "decision").agg(F.count(F.lit(1)).alias("n"))
               .select(F.unix_timestamp("w.start").alias("window_start"), "decision", "n"))
        with session_conf(spark, state_partitions(spark)):
            q = (agg.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
                 .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
        finish(q)

    run_slices(src, base, "_shuffle", n_files, run, cols=["ts", "decision"])
    return spark.read.parquet(f"{base}/out")


def chained_state_job(spark: SparkSession, updates: DataFrame, policy, tick_s: int, lateness_ticks: int,
                      arrival: str, n_files: int = 6) -> DataFrame:
    """T2 -> T1 end to end: updates (.., ts, ``arrival``) come in the order of
    ``arrival``; a last row far in the future closes all ticks.  ``policy``: a
    discount, or a ``StatePolicy``.  Returns the emitted rows."""
    from qoeflow.streaming.keyed_state import ROCKSDB, decision_stream_chained, decision_stream_policy
    base = scratch_path(spark, "chained-state")
    cols = ["group_id", "decision", "cost", "ts"]
    # the instant of a TIMESTAMP_NTZ read as UTC, whatever the session time zone
    src = updates.select("group_id", "decision", "cost", F.timestamp_seconds(F.unix_timestamp("ts")).alias("ts"),
                         F.col(arrival).cast("bigint").alias("_arrival"))
    last = src.agg(F.unix_timestamp(F.max("ts")).alias("t"), F.max("_arrival").alias("a"))
    closing = last.select(F.lit("").alias("group_id"), F.lit("").alias("decision"), F.lit(0.0).alias("cost"),
                          F.timestamp_seconds(F.col("t") + (lateness_ticks + 2) * tick_s).alias("ts"),
                          (F.col("a") + 1).alias("_arrival"))
    src = src.unionByName(closing)

    def run():
        stream = spark.readStream.schema(src.select(*cols).schema).parquet(f"{base}/in/*")
        op = decision_stream_chained if isinstance(policy, float) else decision_stream_policy
        run_available_now(op(stream, policy, tick_s, lateness_ticks), batch_sink(f"{base}/out"), f"{base}/ckpt",
                          confs={"spark.sql.streaming.stateStore.providerClass": ROCKSDB})

    run_slices(src, base, "_arrival", n_files, run, cols=cols)
    return spark.read.parquet(f"{base}/out")


def bootstrapped_state_job(spark: SparkSession, updates: DataFrame, gamma: float, at_tick: int, last_tick: int,
                           n_files: int = 4) -> DataFrame:
    """The updates up to ``at_tick`` as a batch (closed form), those
    behind it streamed from that state; returns the state at ``last_tick`` from
    the state store."""
    from qoeflow.operators import stats as S
    from qoeflow.streaming.keyed_state import ROCKSDB, decision_stream_lazy, initial_state, read_store
    base = scratch_path(spark, "bootstrapped-state")
    first = S.tick_stats(updates.where(F.col("tick") <= at_tick))
    initial_state(S.discounted_state(first, gamma, at_tick=at_tick), at_tick).write.parquet(f"{base}/initial")
    src = updates.where(F.col("tick") > at_tick).select("group_id", "decision", "cost", "tick")

    def run():
        stream = spark.readStream.schema(src.schema).parquet(f"{base}/in/*")
        op = decision_stream_lazy(stream, gamma, spark.read.parquet(f"{base}/initial"))
        run_available_now(op, batch_sink(f"{base}/out"), f"{base}/ckpt", mode="update",
                          confs={"spark.sql.streaming.stateStore.providerClass": ROCKSDB})

    run_slices(src, base, "tick", n_files, run)
    return read_store(spark, f"{base}/ckpt", gamma, last_tick)


def decision_state_lazy_job(spark: SparkSession, updates: DataFrame, gamma: float, n_files: int = 4,
                            timed_tick_s: int | None = None, lateness_ticks: int = 4) -> DataFrame:
    """T1 with ``transformWithStateInPandas`` (RocksDB state store): stage
    the updates as an ordered file stream, run it, return the emitted rows
    (``streaming.keyed_state.read_state`` turns them into the state)."""
    from qoeflow.streaming.keyed_state import ROCKSDB, decision_stream_lazy, decision_stream_timed
    base = scratch_path(spark, "decision-state-lazy")
    src = updates.select("group_id", "decision", "cost", "tick")

    def run():
        stream = spark.readStream.schema(src.schema).parquet(f"{base}/in/*")
        op = (decision_stream_timed(stream, gamma, timed_tick_s, lateness_ticks) if timed_tick_s
              else decision_stream_lazy(stream, gamma))
        run_available_now(op, batch_sink(f"{base}/out"), f"{base}/ckpt", mode="update",
                          confs={"spark.sql.streaming.stateStore.providerClass": ROCKSDB})

    run_slices(src, base, "tick", n_files, run)
    return spark.read.parquet(f"{base}/out")
