"""What a run itself counted, batch by batch.

``RunMetrics`` is a ``StreamingQueryListener``: for every micro-batch of the
queries it watches it writes one small row per measure below a folder, named by
query and batch id: rows read, rows that a watermark dropped, and whatever the
query's ``observe`` calls have counted.  Sinks inside ``foreachBatch`` observe
their frames with ``observed_write``.  A batch that runs again overwrites its
own rows.  Nothing is read a second time to be counted.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from qoeflow.session import list_folder

METRIC = "query string, batch_id bigint, measure string, n bigint"


def write_metrics(spark: SparkSession, path: str, query: str, batch_id: int, source: str, counts: dict[str, int]) -> None:
    """The counts of one batch from one source of counts."""
    rows = [(query, batch_id, k, int(v)) for k, v in counts.items()]
    (spark.createDataFrame(rows, METRIC).coalesce(1).write.mode("overwrite")
     .parquet(f"{path}/query={query}/batch_id={batch_id}/source={source}"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """All rows of ``METRIC``."""
    folders = [f"{path}/{q}/{b}/{s}" for q in list_folder(spark, path) for b in list_folder(spark, f"{path}/{q}")
               for s in list_folder(spark, f"{path}/{q}/{b}")]
    return spark.read.schema(METRIC).parquet(*folders) if folders else spark.createDataFrame([], METRIC)


class RunMetrics(StreamingQueryListener):
    """Writes the progress of queries whose name begins with ``prefix``."""

    def __init__(self, spark: SparkSession, path: str, prefix: str = ""):
        self.spark, self.path, self.prefix, self.written = spark, path, prefix, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if not (p.name or "").startswith(self.prefix) or p.numInputRows + sum(
                s.numRowsDroppedByWatermark for s in p.stateOperators) == 0:
            return                                       # a batch without data
        counts = {"in": p.numInputRows, "dropped": sum(s.numRowsDroppedByWatermark for s in p.stateOperators)}
        for row in (p.observedMetrics or {}).values():
            counts |= {k: v for k, v in row.asDict().items() if v is not None}
        write_metrics(self.spark, self.path, p.name, p.batchId, "progress", counts)
        self.written += 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


class watched:
    """``with watched(spark, path, prefix) as m``: the listener is on inside the
    block; leaving it waits for the events of the queries that have ended."""

    def __init__(self, spark: SparkSession, path: str, prefix: str = ""):
        self.spark, self.listener = spark, RunMetrics(spark, path, prefix)

    def __enter__(self) -> RunMetrics:
        self.spark.streams.addListener(self.listener)
        return self.listener

    def __exit__(self, *exc) -> None:
        # progress events come through Spark's listener bus, behind the queries
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
        before = -1
        while before != self.listener.written:           # and then through Python's callbacks
            before = self.listener.written
            time.sleep(0.3)
        self.spark.streams.removeListener(self.listener)


def observed_write(df: DataFrame, measure: str, path: str) -> int:
    """Write a frame and return its rows as the write itself counted them."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias(measure)).write.mode("overwrite").parquet(path)
    return seen.get[measure]


def deduplicated_job(spark: SparkSession, messages: DataFrame, lateness_s: int, sinks: dict, name: str, arrival: str,
                     n_files: int = 5) -> DataFrame:
    """Messages (seq, value, at) in the order of ``arrival``, those later than
    ``lateness_s`` dropped and repeated ones taken once, each written to the
    ``sinks`` (measure -> condition) it belongs to; returns the run's metrics."""
    from qoeflow.session import scratch_path
    from qoeflow.streaming.jobs import finish, run_slices, session_conf, state_partitions
    base = scratch_path(spark, name)
    src = messages.select("seq", "value", F.timestamp_seconds("at").alias("ts"), F.col(arrival).alias("_arrival"))

    def sink(df: DataFrame, batch_id: int) -> None:
        df = df.persist()
        try:
            counts = {m: observed_write(df.where(cond), m, f"{base}/{m}/batch_id={batch_id}") for m, cond in sinks.items()}
        finally:
            df.unpersist()
        if sum(counts.values()):
            write_metrics(spark, f"{base}/metrics", name, batch_id, "sinks", counts)

    def run():
        stream = spark.readStream.schema("seq bigint, value string, ts timestamp").parquet(f"{base}/in/*")
        once = (stream.observe("read", F.count_if(F.col("value").isNull()).alias("null_values"))
                .withWatermark("ts", f"{lateness_s} seconds").dropDuplicatesWithinWatermark(["seq"]))
        with session_conf(spark, state_partitions(spark)):
            q = (once.writeStream.queryName(name).foreachBatch(sink).option("checkpointLocation", f"{base}/ckpt")
                 .trigger(availableNow=True).start())
        finish(q)

    with watched(spark, f"{base}/metrics", name):
        run_slices(src, base, "_arrival", n_files, run, cols=["seq", "value", "ts"])
    return read_metrics(spark, f"{base}/metrics")
