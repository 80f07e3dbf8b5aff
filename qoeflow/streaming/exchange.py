"""Streaming exchange and group-table jobs.

Tables written by streams are merge tables (``streaming.tables``: a batch adds
its rows, only what has grown is merged) or append-only files; readers in other
streams re-read them inside ``foreachBatch`` so every micro-batch sees the newest
rows -- the stream-static join of shared in-memory maps, without shared memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from qoeflow.session import scratch_path
from qoeflow.streaming.jobs import combine, finish, run_available_now, run_slices
from qoeflow.sources.sinks import latest_table
from qoeflow.streaming.tables import MergeTable, latest_version, write_version


def subscriptions_stream(subs: DataFrame, table: str, checkpoint: str):
    """T5/J5: 'group;cluster' messages -> distinct pairs appended to a
    table (the dedup state holds one key per distinct pair)."""
    from qoeflow.operators.exchange import parse_subscriptions
    from qoeflow.streaming.jobs import session_conf, state_partitions
    pairs = parse_subscriptions(subs).dropDuplicates(["group_id", "cluster_id"])
    with session_conf(subs.sparkSession, state_partitions(subs.sparkSession)):
        return (pairs.writeStream.format("parquet").option("path", table)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def fanout_sink(subs_table: str, me: str, out: str):
    """Each decision to every subscriber of its group but us; the
    subscription table is re-read per batch."""
    from qoeflow.operators.exchange import fan_out

    def sink(df: DataFrame, batch_id: int) -> None:
        subs = df.sparkSession.read.parquet(subs_table)
        fan_out(df, subs, me).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
    return sink


def group_table_sink(table: str, me: str, rejects: str):
    """Merge a batch of feed messages into the assignment table,
    newest cluster per group; messages that are no feed message go to
    ``rejects`` as they came."""
    from qoeflow.sources.feed import assignments, feed_rejects

    def sink(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        feed_rejects(df).write.mode("overwrite").parquet(f"{rejects}/batch_id={batch_id}")
        new = assignments(df).select("group_id", "cluster_id", F.lit(batch_id).cast("bigint").alias("b"), "seq", "pos")
        # the default is older than every message
        first = spark.createDataFrame([("null", me, -1, -1, -1)], GROUP_TABLE)
        group_table(spark, table).merge(new.unionByName(first), batch_id)
    return sink


GROUP_TABLE = "group_id string, cluster_id string, b bigint, seq bigint, pos int"


def group_table(spark: SparkSession, path: str) -> MergeTable:
    """Group -> cluster, the newest by (batch, message, position)."""
    return MergeTable(spark, path, GROUP_TABLE, ["group_id"], order=["b", "seq", "pos"])


def latest_decision_sink(table: str, order: str = "tick"):
    """Newest decision per group, by ``order`` and then batch, merged into
    a table of one row per group."""
    from qoeflow.sources.sinks import merge_latest

    def sink(df: DataFrame, batch_id: int) -> None:
        merge_latest(df, table, batch_id, order)
    return sink


# ----------------------------------------------------------------- T3 ring
RING_OUT = "group_id string, tick bigint, decision string, score_sum double, n bigint"
RING_STATE = "ticks array<bigint>, decisions array<string>, sums array<double>, ns array<bigint>"


def _ring(length: int):
    def fn(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ring: dict[tuple[int, str], list] = {}
        touched: set[tuple[int, str]] = set()
        if state.exists:
            for t, d, s, n in zip(*state.get):
                ring[(t, d)] = [s, n]
        for p in pdfs:
            for t, d, s, c in zip(p["tick"].tolist(), p["decision"].tolist(), p["s"].tolist(), p["c"].tolist()):
                a = ring.setdefault((t, d), [0.0, 0])
                a[0] += s
                a[1] += int(c)
                touched.add((t, d))
        if ring:
            top = max(t for t, _ in ring)
            ring = {k: v for k, v in ring.items() if k[0] > top - length}
        keys = sorted(ring)
        ticks = [k[0] for k in keys]
        decs = [k[1] for k in keys]
        sums = [float(ring[k][0]) for k in keys]
        ns = [int(ring[k][1]) for k in keys]
        state.update((ticks, decs, sums, ns))
        new = [i for i, k in enumerate(keys) if k in touched]
        if new:
            yield pd.DataFrame({"group_id": [key[0]] * len(new), "tick": [ticks[i] for i in new],
                                "decision": [decs[i] for i in new], "score_sum": [sums[i] for i in new],
                                "n": [ns[i] for i in new]})
    return fn


def window_ring_stream(updates: DataFrame, length_ticks: int) -> DataFrame:
    """Per group, a ring of the last ``length`` ticks' sums per
    decision kept in the state store (bounded by length x decisions),
    instead of a sliding window that copies each row into length/slide
    windows.  Emits the entries that a batch changed."""
    return (combine(updates).groupBy("group_id")
            .applyInPandasWithState(_ring(length_ticks), RING_OUT, RING_STATE, "update",
                                    GroupStateTimeout.NoTimeout))


# ------------------------------------------------------------------- jobs
def _replay(df: DataFrame, base: str, order: str, n_files: int, sink, name: str = "") -> None:
    """Run ``df`` slice by slice through ``sink``; folders below ``base/name``."""
    spark, at = df.sparkSession, f"{base}/{name}" if name else base
    run_slices(df, at, order, n_files, lambda: run_available_now(
        spark.readStream.schema(df.schema).parquet(f"{at}/in/*"), sink, f"{at}/ckpt"))


def subscribe(subs: DataFrame, base: str, n_files: int) -> str:
    """Stream subscription messages (seq, value) into the table of pairs, those
    that name no cluster into ``rejects`` beside it; returns the table's folder."""
    from qoeflow.operators.exchange import subscription_rejects
    spark, at = subs.sparkSession, f"{base}/subs"

    def run():
        lines = spark.readStream.text(f"{at}/in/*")
        pairs = subscriptions_stream(lines, f"{at}/table", f"{at}/ckpt")
        rest = (subscription_rejects(lines).writeStream.format("parquet").option("path", f"{at}/rejects")
                .option("checkpointLocation", f"{at}/ckpt-rejects").trigger(availableNow=True).start())
        finish(pairs)
        finish(rest)

    run_slices(subs, at, "seq", n_files, run, "text", ["value"])
    return f"{at}/table"


def exchange_job(spark: SparkSession, subs: DataFrame, decisions: DataFrame, me: str,
                 n_files: int = 3) -> DataFrame:
    """M5: subscription stream into a table, then the decision stream fanned
    out to subscribers (table re-read per batch)."""
    base = scratch_path(spark, "exchange")
    table = subscribe(subs, base, n_files)
    _replay(decisions, base, "tick", n_files, fanout_sink(table, me, f"{base}/out"), "decisions")
    return spark.read.parquet(f"{base}/out")


def forward_sink(base: str, assign: DataFrame, clusters: DataFrame, me: str, labels: list[str], keep: list[str]):
    """J10/P9/A14 in one batch: external updates to their cluster's address
    (unknown clusters and unreadable messages to rejects), and one
    subscription per group forwarded for the first time.  ``known`` is the
    table of groups subscribed to so far."""
    from qoeflow.operators.exchange import auto_subscribe
    from qoeflow.operators.records import forward, route, split_messages

    def sink(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        df = df.persist()
        try:
            good, bad = split_messages(df)
            sent, lost = forward(route(good, assign, me, labels, keep), clusters, me)
            sent.select("seq", "group_id", "cluster_id", "address", "message").write.mode("overwrite").parquet(
                f"{base}/forwarded/batch_id={batch_id}")
            (bad.select("value", F.lit("unreadable").alias("why"))
             .unionByName(lost.select("value", F.lit("unknown cluster").alias("why")))
             .write.mode("overwrite").parquet(f"{base}/rejects/batch_id={batch_id}"))
            known = MergeTable(spark, f"{base}/known", "group_id string, cluster_id string, message string", ["group_id"])
            new = auto_subscribe(sent, me)
            new = new.join(known.read(before=batch_id, of=new).select("group_id"), "group_id", "left_anti")
            new.write.mode("overwrite").parquet(f"{base}/subscriptions/batch_id={batch_id}")
            known.merge(spark.read.parquet(f"{base}/subscriptions/batch_id={batch_id}"), batch_id)
        finally:
            df.unpersist()
    return sink


def forward_job(spark: SparkSession, messages: DataFrame, assign: DataFrame, clusters: DataFrame, me: str,
                labels: list[str], keep: list[str], n_files: int = 3) -> str:
    """M5, the sending half: messages (seq, value) forwarded and subscribed for
    batch by batch; returns the folder of ``forwarded``, ``subscriptions`` and
    ``rejects``."""
    base = scratch_path(spark, "forward")
    _replay(messages.select("seq", "value"), base, "seq", n_files,
            forward_sink(base, assign, clusters, me, labels, keep))
    return base


def group_table_job(spark: SparkSession, feed: DataFrame, me: str, n_files: int = 3) -> DataFrame:
    base = scratch_path(spark, "group-table")
    _replay(feed, base, "seq", n_files, group_table_sink(f"{base}/table", me, f"{base}/rejects"))
    return group_table(spark, f"{base}/table").read()


def epsilon_lines_sink(out: str):
    """A batch's epsilon-greedy messages as ordered lines per group."""
    from qoeflow.operators.records import parse_epsilon
    from qoeflow.sources.sinks import export_epsilon

    def sink(df: DataFrame, batch_id: int) -> None:
        export_epsilon(parse_epsilon(df)).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
    return sink


def epsilon_lines_job(spark: SparkSession, messages: DataFrame, n_files: int = 3) -> DataFrame:
    """Stream of decision messages (seq, message) -> lines of every decision."""
    base = scratch_path(spark, "epsilon-lines")
    _replay(messages, base, "seq", n_files, epsilon_lines_sink(f"{base}/out"))
    return spark.read.parquet(f"{base}/out")


def latest_decision_job(spark: SparkSession, decisions: DataFrame, n_files: int = 3) -> DataFrame:
    base = scratch_path(spark, "latest")
    _replay(decisions, base, "tick", n_files, latest_decision_sink(f"{base}/table"))
    return latest_table(decisions, f"{base}/table").read()


def newest_update_job(spark: SparkSession, updates: DataFrame, n_files: int = 21) -> DataFrame:
    """The newest update of each group, by time and then number, kept in a
    merge table over many micro-batches (in the order of the numbers)."""
    base = scratch_path(spark, "newest-update")
    src = updates.select("event_id", "group_id", "decision", "cost", "tick", F.unix_micros(F.col("ts").cast("timestamp"))
                         .alias("at"))

    def table() -> MergeTable:
        return MergeTable(spark, f"{base}/table", src.schema, ["group_id"], order=["at", "event_id"], fan=4)

    _replay(src, base, "event_id", n_files, lambda df, batch_id: table().merge(df, batch_id))
    return table().read()


def window_ring_job(spark: SparkSession, updates: DataFrame, length_ticks: int,
                    n_files: int = 4) -> DataFrame:
    """Runs T3 over an ordered file stream; returns the newest form of every
    (group, tick, decision) entry emitted (filter on the window's ticks)."""
    from qoeflow.streaming.jobs import batch_sink
    base = scratch_path(spark, "ring")
    src = updates.select("group_id", "decision", "cost", "tick")

    def run():
        stream = spark.readStream.schema(src.schema).parquet(f"{base}/in/*")
        run_available_now(window_ring_stream(stream, length_ticks), batch_sink(f"{base}/out"), f"{base}/ckpt",
                          mode="update")

    run_slices(src, base, "tick", n_files, run)
    out = spark.read.parquet(f"{base}/out")
    newest = F.max_by(F.struct("score_sum", "n"), "batch_id")
    return (out.groupBy("group_id", "tick", "decision").agg(newest.alias("x"))
            .select("group_id", "tick", "decision", "x.score_sum", "x.n"))


def serve_sink(decisions_table: str, leaves: DataFrame, default_feature: int, n_features: int,
               seed: str, out: str):
    """M1 online: each micro-batch of requests is grouped by the rules,
    joined with the newest decision table (re-read per batch) and served."""
    from qoeflow.operators.assign import assign_slots
    from qoeflow.operators.records import split_request
    from qoeflow.operators.rules import match_groups

    def sink(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        latest = latest_version(spark, decisions_table)
        req = split_request(df, n_features)
        grouped = match_groups(req, leaves, F.get("features", default_feature))
        served = assign_slots(grouped, latest, seed)
        (served.select("req_id", "group_id", "decision", "source").write.mode("overwrite")
         .parquet(f"{out}/batch_id={batch_id}"))
    return sink


def serve_job(spark: SparkSession, requests: DataFrame, latest: DataFrame, leaves: DataFrame,
              default_feature: int, n_features: int, seed: str, n_files: int = 3) -> DataFrame:
    """Write the decision table as a version, stream the requests through
    ``serve_sink``, return every response."""
    base = scratch_path(spark, "serve")
    write_version(latest, f"{base}/decisions", 0)
    _replay(requests, base, "req_id", n_files, serve_sink(f"{base}/decisions", leaves, default_feature, n_features,
                                                          seed, f"{base}/out"), "requests")
    return spark.read.parquet(f"{base}/out")
