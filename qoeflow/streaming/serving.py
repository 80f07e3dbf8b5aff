"""M1/J6 online: requests against decisions that change while they stream in.

Decisions and requests are one stream, joined as of event time in keyed state:
a request gets the decision of its group that was valid at the request's own
time, whenever either of them arrives.  The watermark follows the decisions
alone.  A request at time t waits until the watermark has passed t, because
until then a decision valid at t may still come; then an event-time timer
releases it.  A request that comes after that is answered at once, from the
versions the state keeps: it is late, but it is neither dropped nor given a
version of another time.

A group's requests are dealt to ``salts`` keys by a hash of the request, each
of which holds the group's decisions (a few rows), so a group with a third of
all requests is many keys.  These keys share pages of state (``pages``): decisions
of many small groups, and requests of a busy one, are written and joined as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from qoeflow.session import scratch_path
from qoeflow.streaming.jobs import batch_sink, run_available_now, run_slices
from qoeflow.streaming.pages import codes_of, pack, page_of, parcels, starts_of, unpack

#: One schema for both kinds of rows: ``valid_from`` (event time) and ``payload``
#: of a decision; ``req_id``, ``at`` and ``body`` of a request.  Times are seconds.
EVENT = "group_id string, valid_from timestamp, version bigint, payload string, req_id bigint, at bigint, body string"
ANSWER = "group_id string, req_id bigint, at bigint, body string, version bigint, payload string, late boolean"


def decision_events(decisions: DataFrame, version: str, payload: str, valid_from_s) -> DataFrame:
    """Decisions (group_id, ``version``, ``payload``) valid from a time."""
    return decisions.select(
        "group_id", F.timestamp_seconds(valid_from_s).alias("valid_from"), F.col(version).cast("bigint").alias("version"),
        F.col(payload).alias("payload"), F.lit(None).cast("bigint").alias("req_id"),
        F.lit(None).cast("bigint").alias("at"), F.lit(None).cast("string").alias("body"))


def request_events(requests: DataFrame, at_s, body) -> DataFrame:
    """Requests (group_id, req_id) at a time, with what serving needs of them."""
    return requests.select(
        "group_id", F.lit(None).cast("timestamp").alias("valid_from"), F.lit(None).cast("bigint").alias("version"),
        F.lit(None).cast("string").alias("payload"), F.col("req_id").cast("bigint").alias("req_id"),
        at_s.cast("bigint").alias("at"), body.alias("body"))


#: Waiting requests in one state value.
CHUNK = 16384


def newest(versions: dict) -> dict:
    """One row per (group, since), the last one given, in the order of both."""
    (g,), _ = codes_of(versions["group_id"])
    order = np.lexsort((versions["since"], g))
    end = np.append(starts_of(g[order], versions["since"][order])[1:], len(g)) - 1
    return {c: v[order[end]] for c, v in versions.items()}


class AsofServer(StatefulProcessor):
    """State of a page of (group, salt) keys (``pages``): the groups' decisions
    by the second they are valid from, kept for ``keep_s`` behind the watermark
    (and the newest before that); the requests that wait, in chunks ordered by
    time (``held``: each chunk's first and last second, so that a timer reads only
    those with requests that are due); and the page's one timer, at the first of them."""

    def __init__(self, keep_s: int):
        self.keep_s = keep_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.page = handle.getValueState("page", "versions binary, held binary, timer bigint")
        self.waiting = handle.getMapState("waiting", "chunk bigint", "rows binary")

    def _load(self) -> tuple[bytes, dict, int | None]:
        known = self.page.get()
        if known is not None:
            return known[0], unpack(known[1]), known[2]
        names, whole = np.empty(0, object), np.empty(0, np.int64)
        return pack(dict(group_id=names, since=whole, version=whole, payload=names)), dict(chunk=whole, first=whole, last=whole), None

    def _store(self, versions: bytes, held: dict, timer: int | None) -> None:
        at = int(held["first"].min()) * 1000 if len(held["first"]) else None
        if at != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if at is not None:
                self.handle.registerTimer(at)
        self.page.update((versions, pack(held), at))

    def _keep(self, held: dict, parts: list[dict]) -> dict:
        """Writes requests as further chunks."""
        rows = {c: np.concatenate([x[c] for x in parts]) for c in parts[0]}
        order = np.argsort(rows["at"], kind="stable")
        for i in range(0, len(order), CHUNK):
            chunk = {c: v[order[i:i + CHUNK]] for c, v in rows.items()}
            new = int(held["chunk"].max()) + 1 if len(held["chunk"]) else 0
            self.waiting.updateValue((new,), (pack(chunk),))
            held = {c: np.append(held[c], v) for c, v in
                    dict(chunk=new, first=chunk["at"][0], last=chunk["at"][-1]).items()}
        return held

    @staticmethod
    def _answer(known: dict, asked: dict, late: bool) -> pd.DataFrame:
        (mine, theirs), _ = codes_of(known["group_id"], asked["group_id"])
        times = np.unique(known["since"])
        # versions are in the order of these numbers: a group's, then its times from 1
        n = len(times) + 1
        have = mine * n + np.searchsorted(times, known["since"]) + 1
        i = np.searchsorted(have, theirs * n + np.searchsorted(times, asked["at"], side="right"), side="right") - 1
        hit = i >= 0
        hit[hit] = mine[i[hit]] == theirs[hit]
        version, payload = np.zeros(len(i), np.int64), np.full(len(i), None, object)
        version[hit], payload[hit] = known["version"][i[hit]], known["payload"][i[hit]]
        return pd.DataFrame({"group_id": asked["group_id"], "req_id": asked["req_id"], "at": asked["at"], "body": asked["body"],
                             "version": pd.arrays.IntegerArray(version, ~hit), "payload": payload, "late": late})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() // 1000
        versions, held, timer = self._load()
        decided, due, wait = [], [], []
        for p in rows:
            dec = p[p["parcel"].isna()]
            if len(dec):
                decided.append(dict(group_id=dec["group_id"].to_numpy(object), since=dec["since"].to_numpy(np.int64),
                                    version=dec["version"].to_numpy(np.int64), payload=dec["payload"].to_numpy(object)))
            for req in map(unpack, p["parcel"].dropna()):
                for to, which in ((due, req["at"] <= passed), (wait, req["at"] > passed)):
                    if which.any():
                        to.append({c: v[which] for c, v in req.items()})
                if sum(len(x["at"]) for x in wait) >= 8 * CHUNK:
                    held, wait = self._keep(held, wait), []
        if wait:
            held = self._keep(held, wait)
        if decided or due:
            known = unpack(versions)
            if decided:
                known = newest({c: np.concatenate([known[c], *(x[c] for x in decided)]) for c in known})
                versions = pack(known)
        self._store(versions, held, timer)
        for x in due:
            yield self._answer(known, x, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) // 1000
        versions, held, timer = self._load()
        known = unpack(versions)
        keep = np.ones(len(held["chunk"]), bool)
        for k in np.flatnonzero(held["first"] <= passed):
            chunk = (int(held["chunk"][k]),)
            x = unpack(self.waiting.getValue(chunk)[0])
            n = int(np.searchsorted(x["at"], passed, side="right"))
            if n < len(x["at"]):
                self.waiting.updateValue(chunk, (pack({c: v[n:] for c, v in x.items()}),))
                held["first"] = np.where(np.arange(len(keep)) == k, x["at"][n], held["first"])
            else:
                self.waiting.removeKey(chunk)
                keep[k] = False
            yield self._answer(known, {c: v[:n] for c, v in x.items()}, False)
        (g,), _ = codes_of(known["group_id"])
        old = known["since"] <= passed - self.keep_s
        gone = old[:-1] & old[1:] & (g[:-1] == g[1:])      # the last of them is still valid
        if gone.any():
            versions = pack({c: v[np.append(~gone, True)] for c, v in known.items()})
        self._store(versions, {c: v[keep] for c, v in held.items()}, timer)

    def close(self) -> None:
        pass


def serve_asof(events: DataFrame, lateness_s: int, keep_s: int = 10**9, salts: int = 8) -> DataFrame:
    """Stream of ``EVENT`` rows -> each request with the version and payload
    valid at its time (null: none).  Decisions may come up to ``lateness_s``
    out of order; requests may come at any time, and are answered from the
    versions of the last ``keep_s`` seconds."""
    asked = F.col("req_id").isNotNull()
    # numbers without nulls, which pandas would turn into doubles; times do not depend on the session's zone
    own = lambda yes, c: F.when(asked == F.lit(yes), c).otherwise(F.lit(0).cast("bigint"))
    page = lambda salt: page_of("group_id", salt)
    every = F.array_distinct(F.array(*[page(F.lit(i)) for i in range(salts)]))
    mine = F.array(page(F.pmod(F.xxhash64("req_id"), F.lit(salts)).cast("int")))
    dealt = events.select("group_id", "valid_from", asked.alias("asked"), own(False, F.unix_timestamp("valid_from")).alias("since"),
                          own(False, F.col("version")).alias("version"), "payload", "req_id", own(True, F.col("at")).alias("at"),
                          "body", F.explode(F.when(asked, mine).otherwise(every)).alias("page"))
    dealt = parcels(dealt, ["group_id", "req_id", "at", "body"], "asked",
                    "group_id string, valid_from timestamp, since bigint, version bigint, payload string")
    dealt = dealt.withWatermark("valid_from", f"{lateness_s} seconds")
    return dealt.groupBy("page").transformWithStateInPandas(AsofServer(keep_s), ANSWER, "Append", "EventTime")


def serve_asof_job(spark: SparkSession, decisions: DataFrame, requests: DataFrame, lateness_s: int, n_files: int = 6,
                   salts: int = 8) -> DataFrame:
    """Run ``serve_asof`` over decisions and requests, each with a column
    ``arrival`` (seconds) in whose order they come; returns the answers.  The
    end of the decisions is told by one that is valid far in the future."""
    from qoeflow.streaming.keyed_state import ROCKSDB
    base = scratch_path(spark, "serve-asof")
    names = [c for c in decisions.columns if c != "arrival"]
    top = decisions.agg(F.max("arrival")).first()[0]
    last = requests.agg(F.max("arrival"), F.max("at")).first()
    end = max(x for x in (top, *last, 0) if x is not None) + lateness_s + 1
    closing = spark.createDataFrame([("", end + lateness_s, 0, "")], "group_id string, t bigint, v bigint, p string")
    closing = decision_events(closing, "v", "p", F.col("t")).withColumn("arrival", F.lit(end))
    both = decisions.unionByName(requests).unionByName(closing)

    def run():
        stream = spark.readStream.schema(EVENT).parquet(f"{base}/in/*")
        run_available_now(serve_asof(stream, lateness_s, salts=salts), batch_sink(f"{base}/out"), f"{base}/ckpt",
                          confs={"spark.sql.streaming.stateStore.providerClass": ROCKSDB})

    run_slices(both, base, "arrival", n_files, run, cols=names)
    return spark.read.schema(ANSWER + ", batch_id int").parquet(f"{base}/out").drop("batch_id")
