"""T5/J3 with an end: subscriptions that expire unless they are renewed.

Subscription messages and decisions are one stream in event time.  A decision at
time t goes to every cluster whose newest subscription to its group at or before
t is at most ``ttl_s`` old, whatever order the messages arrive in within the
lateness.  A decision waits until the watermark has passed t; a timer releases
it.  The state of a group holds, for each cluster, the messages that may still
matter: those after the watermark and the newest before it.  When that one has
expired, the cluster leaves the state, so the state follows the live
subscriptions and not all that there ever were.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from qoeflow.session import scratch_path
from qoeflow.streaming.jobs import batch_sink, run_available_now, run_slices

#: ``cluster_id`` of a subscription (null in a decision), ``message`` of a decision.
EVENT = "group_id string, ts timestamp, cluster_id string, message string"
SENT = "group_id string, cluster_id string, at bigint, message string"


class ExpiringSubscribers(StatefulProcessor):
    def __init__(self, ttl_s: int):
        self.ttl = ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "cluster_id string", "times array<bigint>")
        self.waiting = handle.getListState("waiting", "at bigint, message string")

    def _arm(self, times: list[int]) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if times:
            self.handle.registerTimer(min(times) * 1000)

    def _subscribers(self) -> dict[str, list[int]]:
        return {k[0]: sorted(v[0]) for k, v in self.seen.iterator()}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh: dict[str, set[int]] = {}
        wait: list[tuple[int, str]] = []
        for p in rows:
            at = p["ts"].map(lambda t: int(t.timestamp()))
            for t, c, m in zip(at, p["cluster_id"], p["message"]):
                if isinstance(c, str):
                    fresh.setdefault(c, set()).add(t)
                else:
                    wait.append((t, m))
        for c, times in fresh.items():
            old = self.seen.getValue((c,))
            self.seen.updateValue((c,), (sorted(times | set(old[0] if old else ())),))
        if wait:
            self.waiting.appendList(wait)
        held = [x[0] for x in self.waiting.get()] if self.waiting.exists() else []
        self._arm([*held, *(times[-1] + self.ttl for times in self._subscribers().values())])
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) // 1000
        held = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        due = sorted(x for x in held if x[0] <= passed)
        rest = [x for x in held if x[0] > passed]
        known = self._subscribers()
        sent = [(c, at, m) for at, m in due for c, times in known.items()
                if any(at - self.ttl < t <= at for t in times)]
        if due and rest:
            self.waiting.put(rest)
        elif due:
            self.waiting.clear()
        left = {}
        for c, times in known.items():
            before = [t for t in times if t <= passed]
            keep = [t for t in before[-1:] if t + self.ttl > passed] + [t for t in times if t > passed]
            if not keep:
                self.seen.removeKey((c,))
            elif keep != times:
                self.seen.updateValue((c,), (keep,))
            if keep:
                left[c] = keep
        self._arm([*(x[0] for x in rest), *(times[-1] + self.ttl for times in left.values())])
        if sent:
            c, at, m = zip(*sent)
            yield pd.DataFrame({"group_id": key[0], "cluster_id": c, "at": at, "message": m})


def expiring_fanout(events: DataFrame, ttl_s: int, lateness_s: int) -> DataFrame:
    """Stream of ``EVENT`` rows -> a row for each decision and live subscriber."""
    return (events.withWatermark("ts", f"{lateness_s} seconds").groupBy("group_id")
            .transformWithStateInPandas(ExpiringSubscribers(ttl_s), SENT, "Append", "EventTime"))


def expiring_fanout_job(spark: SparkSession, subs: DataFrame, decisions: DataFrame, me: str, ttl_s: int, lateness_s: int,
                        n_files: int = 4) -> DataFrame:
    """Subscriptions (group_id, cluster_id, at) and decisions (group_id, at,
    message), each with ``arrival`` in whose order they come (times in seconds)
    -> (group_id, cluster_id, at, message); our own subscriptions are not
    served (P9).  A last subscription far in the future closes the stream."""
    from qoeflow.streaming.keyed_state import ROCKSDB
    base = scratch_path(spark, "expiring")
    cols = ["group_id", "ts", "cluster_id", "message"]
    ts = F.timestamp_seconds("at").alias("ts")
    none = F.lit(None).cast("string")
    both = (subs.where(F.col("cluster_id") != me).select("group_id", ts, "cluster_id", none.alias("message"), "arrival")
            .unionByName(decisions.select("group_id", ts, none.alias("cluster_id"), "message", "arrival")))
    last = both.agg(F.unix_timestamp(F.max("ts")).alias("t"), F.max("arrival").alias("a"))
    closing = last.select(F.lit("").alias("group_id"), F.timestamp_seconds(F.col("t") + 2 * lateness_s + ttl_s + 1).alias("ts"),
                          F.lit("").alias("cluster_id"), none.alias("message"), (F.col("a") + 1).alias("arrival"))

    def run():
        stream = spark.readStream.schema(EVENT).parquet(f"{base}/in/*")
        run_available_now(expiring_fanout(stream, ttl_s, lateness_s), batch_sink(f"{base}/out"), f"{base}/ckpt",
                          confs={"spark.sql.streaming.stateStore.providerClass": ROCKSDB})

    run_slices(both.unionByName(closing), base, "arrival", n_files, run, cols=cols)
    return spark.read.schema(SENT + ", batch_id int").parquet(f"{base}/out").drop("batch_id")
