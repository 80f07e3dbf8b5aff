"""Streaming operators against their batch twins and edge cases."""

import pytest
from pyspark.sql import functions as F

from qoeflow.operators import stats as S
from qoeflow.session import scratch_path
from qoeflow.streaming.jobs import batch_sink, run_available_now
from qoeflow.streaming.state import decay_to, decision_stream, latest_state
from qoeflow.streaming.topics import broker_list

SCHEMA = "group_id string, decision string, cost double, tick bigint"


def _run(spark, batches, gamma=0.8):
    """Each inner list becomes one file = one micro-batch, in order."""
    base = scratch_path(spark, "t-stream")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    run_available_now(decision_stream(src, gamma), batch_sink(f"{base}/out"), f"{base}/ckpt", mode="update")
    return latest_state(spark.read.parquet(f"{base}/out"))


def test_stream_equals_batch_with_split_ticks(spark):
    # tick 1 split across two batches; batch 3 closes several ticks at once
    batches = [[("g", "a", 1.0, 0), ("g", "b", 2.0, 0), ("h", "a", 5.0, 0)],
               [("g", "a", 1.0, 1)],
               [("g", "b", 3.0, 1), ("g", "a", 4.0, 1)],
               [("g", "a", 1.0, 3), ("g", "b", 1.0, 4), ("h", "b", 2.0, 4), ("g", "a", 2.0, 6)]]
    st = _run(spark, batches)
    T = 6
    got = {(r.group_id, r.decision): (r.score_sum, r.n) for r in decay_to(st, 0.8, F.lit(T)).collect()}
    rows = [r for b in batches for r in b]
    stats = S.tick_stats(spark.createDataFrame(rows, SCHEMA))
    want = {(r.group_id, r.decision): (r.score_sum, r.n)
            for r in S.discounted_state(stats, 0.8, at_tick=T).collect()}
    assert set(got) == set(want)
    for k in want:
        assert got[k][0] == pytest.approx(want[k][0]) and got[k][1] == pytest.approx(want[k][1])


def test_late_ticks_count_in_the_current_tick(spark):
    batches = [[("g", "a", 1.0, 5)], [("g", "a", 7.0, 2), ("g", "b", 1.0, 6)]]
    st = {r.decision: r for r in _run(spark, batches).collect()}
    assert st["a"].late == 1 and st["a"].score_sum == pytest.approx(-8.0) and st["a"].n == pytest.approx(2.0)
    assert st["b"].group_tick == 6


def _five_files(spark):
    """One tick of one group over five micro-batches, after an earlier tick."""
    return [[("g", "a", 1.0, 1000)]] + [[("g", "b", 1.0, 1001)] for _ in range(4)] + [[("g", "a", 2.0, 1001)]]


def test_a_tick_over_many_micro_batches_in_all_state_streams(spark):
    from qoeflow.streaming.keyed_state import ROCKSDB, decision_stream_lazy, decision_stream_timed, read_state
    batches = _five_files(spark)
    rows = [r for b in batches for r in b]
    want = {r.decision: (r.score_sum, r.n) for r in
            S.discounted_state(S.tick_stats(spark.createDataFrame(rows, SCHEMA)), 0.8, at_tick=1001).collect()}
    got = {"fold": decay_to(_run(spark, batches), 0.8, F.lit(1001))}
    for name, op in (("lazy", lambda s: decision_stream_lazy(s, 0.8)),
                     ("timed", lambda s: decision_stream_timed(s, 0.8, 10, 1))):
        base = scratch_path(spark, "t-five")
        for part in batches:
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
        src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        run_available_now(op(src), batch_sink(f"{base}/out"), f"{base}/ckpt", mode="update",
                          confs={"spark.sql.streaming.stateStore.providerClass": ROCKSDB})
        got[name] = read_state(spark.read.parquet(f"{base}/out"), 0.8, F.lit(1001))
    for name, df in got.items():
        res = {r.decision: (r.score_sum, r.n) for r in df.collect()}
        assert res.keys() == want.keys(), name
        for d in want:
            assert res[d][0] == pytest.approx(want[d][0]) and res[d][1] == pytest.approx(want[d][1]), name


def test_a_limit_that_is_hit_raises(spark):
    import time
    from qoeflow.streaming.jobs import run_slices
    base = scratch_path(spark, "t-limit")
    df = spark.range(3)

    def slow(batch, batch_id):
        time.sleep(5)

    with pytest.raises(TimeoutError):
        run_slices(df, base, "id", 1, lambda: run_available_now(
            spark.readStream.schema(df.schema).parquet(f"{base}/in/*"), slow, f"{base}/ckpt", timeout_s=1))


def test_rows_without_an_order_value_are_staged(spark):
    from qoeflow.streaming.jobs import stage_slices
    df = spark.createDataFrame([(1, "a"), (9, "b"), (None, "c")], "seq long, value string")
    base = scratch_path(spark, "t-stage")
    folders = stage_slices(df, base, "seq", 2)
    got = [sorted(r.value for r in spark.read.parquet(f).collect()) for f in folders]
    assert got == [["a", "c"], ["b"]]


def test_a_batch_that_runs_again_gives_the_same_state(spark):
    from qoeflow.operators.policy import DiscountedUCB, EpsilonGreedy
    from qoeflow.streaming.loop import decision_loop_sink, state_table
    batches = [[("g", "x", 1.0), ("g", "y", 2.0)], [("g", "x", 2.0)], [("h", "y", 1.0)]]
    for policy in (DiscountedUCB(0.8, 4, 1000.0), EpsilonGreedy(0.5, 2)):
        out = {}
        for again in (False, True):
            base = scratch_path(spark, "t-again")
            sink = decision_loop_sink(base, ["Id", "decision", "socre"], policy, "From: t")
            for i, rows in enumerate(batches):
                df = spark.createDataFrame([('{"update":"1\\t%s\\t%s","group_id":"%s"}' % (d, c, g),)
                                            for g, d, c in rows], "value string")
                sink(df, i)
                if again:
                    sink(df, i)
            out[again] = sorted(map(str, state_table(spark, base, policy).read().collect()))
            assert len(out[again]) >= 2
        assert out[False] == out[True]


def test_a_table_that_cannot_be_read_fails_the_batch(spark):
    from qoeflow.streaming.exchange import latest_decision_sink
    from qoeflow.sources.sinks import latest_table
    base = scratch_path(spark, "t-broken")
    df = spark.createDataFrame([("g", "s", 1)], "group_id string, slots string, tick long")
    assert latest_table(df, f"{base}/table").read().count() == 0    # nothing yet
    sink = latest_decision_sink(f"{base}/table")
    for i in range(4):
        sink(df, i)
    assert latest_table(df, f"{base}/table").read().count() == 1
    import glob
    for f in glob.glob(f"{base}/table/*/*/b=*/bucket=*/part-*"):
        with open(f, "wb") as out:
            out.write(b"broken")
    with pytest.raises(Exception):
        for i in range(4, 10):                                      # at the latest when the deltas are merged
            sink(df, i)


def test_broker_list():
    assert broker_list("a,b") == "a:9092,b:9092"


def test_spool_source_reads_once_and_deletes(spark):
    import os
    from qoeflow.streaming.topics import spool_source
    base = scratch_path(spark, "t-spool")
    os.makedirs(f"{base}/spool")
    for i in range(3):
        with open(f"{base}/spool/q{i}.json", "w") as f:
            f.write('{"update":"%d\\tx\\t1","group_id":"g"}\n' % i)
    src = spool_source(spark, f"{base}/spool", max_files=1, clean="delete")
    run_available_now(src, batch_sink(f"{base}/out"), f"{base}/ckpt")
    assert spark.read.parquet(f"{base}/out").count() == 3
    # a restart reads nothing twice (file-source log in the checkpoint)
    run_available_now(spool_source(spark, f"{base}/spool", clean="delete"), batch_sink(f"{base}/out"),
                      f"{base}/ckpt")
    assert spark.read.parquet(f"{base}/out").count() == 3
    import time
    for _ in range(50):                     # deletion happens asynchronously after commit
        if not [f for f in os.listdir(f"{base}/spool") if f.endswith(".json")]:
            break
        time.sleep(0.2)
    assert len([f for f in os.listdir(f"{base}/spool") if f.endswith(".json")]) <= 1


def test_decision_loop_with_processing_time_trigger(spark):
    import os
    from qoeflow.operators.policy import DiscountedUCB
    from qoeflow.streaming.loop import decision_loop
    from qoeflow.streaming.topics import spool_source
    base = scratch_path(spark, "t-loop")
    os.makedirs(f"{base}/spool")
    with open(f"{base}/spool/a.json", "w") as f:
        for i, (g, d, c) in enumerate([("g", "x", 1.0), ("g", "y", 3.0), ("h", "x", 2.0)]):
            f.write('{"update":"%d\\t%s\\t%s","group_id":"%s"}\n' % (i, d, c, g))
    q = decision_loop(spool_source(spark, f"{base}/spool"), f"{base}/loop", ["Id", "decision", "socre"],
                      DiscountedUCB(0.8, 4, 1000.0), "From: t", trigger={"processingTime": "1 second"},
                      topic=("decision", "json", {"path": f"{base}/topic"}))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    dec = {r.group_id: r.slots for r in spark.read.parquet(f"{base}/loop/decisions").collect()}
    assert set(dec) == {"g", "h"} and len(dec["g"]) == 4 and dec["h"] == ["x"] * 4
    published = {r.value for r in spark.read.json(f"{base}/topic").collect()}
    assert "h;x:x:x:x:;From: t" in published


def test_lazy_keyed_state_equals_batch(spark):
    from qoeflow.streaming.jobs import decision_state_lazy_job
    from qoeflow.streaming.keyed_state import read_state
    rows = [("g", "a", 1.0, 0), ("g", "b", 2.0, 0), ("h", "a", 5.0, 0), ("g", "a", 1.0, 1),
            ("g", "b", 3.0, 1), ("g", "a", 4.0, 1), ("g", "a", 1.0, 3), ("g", "b", 1.0, 4),
            ("h", "b", 2.0, 4), ("g", "a", 2.0, 6), ("k", "z", 1.0, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = decision_state_lazy_job(spark, df, 0.8, n_files=4)
    got = {(r.group_id, r.decision): (r.score_sum, r.n)
           for r in read_state(out, 0.8, F.lit(6)).collect()}
    want = {(r.group_id, r.decision): (r.score_sum, r.n)
            for r in S.discounted_state(S.tick_stats(df), 0.8, at_tick=6).collect()}
    assert set(got) == set(want)
    for k in want:
        assert got[k][0] == pytest.approx(want[k][0]) and got[k][1] == pytest.approx(want[k][1])


def test_timers_emit_idle_groups(spark):
    from qoeflow.streaming.jobs import decision_state_lazy_job
    from qoeflow.streaming.keyed_state import read_state
    b = 1000      # ticks away from the epoch: event time 0 is never after the initial watermark
    rows = [("g", "a", 1.0, b), ("h", "a", 4.0, b), ("h", "b", 2.0, b),
            ("g", "a", 2.0, b + 2), ("g", "b", 1.0, b + 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = decision_state_lazy_job(spark, df, 0.8, n_files=3, timed_tick_s=10)
    h = out.where("group_id = 'h'")
    # h was active only at tick b; as event time moved on it was re-emitted, decayed
    assert h.where(f"group_tick > {b}").count() >= 2
    got = {(r.group_id, r.decision): (r.score_sum, r.n)
           for r in read_state(out, 0.8, F.lit(b + 5)).collect()}
    want = {(r.group_id, r.decision): (r.score_sum, r.n)
            for r in S.discounted_state(S.tick_stats(df), 0.8, at_tick=b + 5).collect()}
    assert set(got) == set(want)
    for k in want:
        assert got[k][0] == pytest.approx(want[k][0]) and got[k][1] == pytest.approx(want[k][1])
    for r in h.collect():      # every idle emission carries the decayed state at its tick
        t = r.group_tick - b
        if t > 0:
            base = {"a": -4.0, "b": -2.0}[r.decision]
            assert r.score_sum == pytest.approx(base * 0.8 ** t)
