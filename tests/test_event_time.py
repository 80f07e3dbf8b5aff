"""Event-time streams: arrival order, late rows, expiry, user state."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from qoeflow.operators import stats as S
from qoeflow.operators.policy import StatePolicy
from qoeflow.session import scratch_path

TICK = 100
BASE = 10_000                       # ticks away from the epoch


def updates(spark, n=300, seed=5):
    r = random.Random(seed)
    rows = [(r.choice("gggh"), r.choice("ab"), r.randint(1, 90) / 10, BASE * TICK + r.randint(0, 12 * TICK - 1), i)
            for i in range(n)]
    return spark.createDataFrame(rows, "group_id string, decision string, cost double, s bigint, i int").select(
        "*", F.timestamp_seconds("s").alias("ts"))


def rows_of(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


def test_two_arrival_orders_give_the_same_rows(spark):
    from qoeflow.streaming.jobs import chained_state_job
    from qoeflow.streaming.keyed_state import read_state
    u = updates(spark)
    got = []
    for seed in (1, 2):
        r = random.Random(seed)
        delay = spark.createDataFrame([(i, r.randint(0, 3 * TICK)) for i in range(300)], "i int, d bigint")
        shuffled = u.join(delay, "i").withColumn("arrival", F.col("s") + F.col("d"))
        out = chained_state_job(spark, shuffled, 0.8, TICK, 4, "arrival", n_files=4)
        assert out.agg(F.max("late")).first()[0] == 0
        got.append(rows_of(read_state(out, 0.8, F.lit(BASE + 12))))
    stats = S.tick_stats(u.withColumn("tick", F.floor(F.col("s") / TICK).cast("bigint")))
    want = S.discounted_state(stats, 0.8, at_tick=BASE + 12).select("group_id", "decision", "score_sum", "n", "last_tick")
    assert got[0] == got[1] and [x[:5] for x in got[0]] == rows_of(want) and len(got[0]) == 4


def fade_policy():
    # inside a function, so that it travels to the workers by value
    class Fade(StatePolicy):
        fields = "total double, ticks double"

        def merge(self, old, score_sum, n, idle):
            kept = np.nan_to_num(old["total"]) * 0.5 ** idle
            return {"total": kept * 0.9 + score_sum, "ticks": np.nan_to_num(old["ticks"]) + (n > 0)}

        def read(self, state, idle):
            return {"total": state["total"] * 0.5 ** idle, "ticks": state["ticks"]}

        def decide(self, state, keys=None):
            return state.groupBy("group_id").agg(F.max_by("decision", F.struct("total", "decision")).alias("decision"))
    return Fade()


def plain_fade(rows, top):
    """(group, decision) -> (total, ticks) by the recurrence, tick by tick."""
    state, last = {}, {}
    for t in sorted({r[2] for r in rows}):
        for g in {r[0] for r in rows if r[2] == t}:
            sums = {}
            for a, d, u, s, c in rows:
                if (a, u) == (g, t):
                    sums[d] = (sums.get(d, (0, 0))[0] + s, sums.get(d, (0, 0))[1] + c)
            idle = t - last.get(g, t - 1) - 1
            for d in {*sums, *(d for a, d in state if a == g)}:
                total, n = state.get((g, d), (0.0, 0))
                s, c = sums.get(d, (0.0, 0))
                state[g, d] = (total * 0.5 ** idle * 0.9 + s, n + (c > 0))
            last[g] = t
    return {k: (v[0] * 0.5 ** (top - last[k[0]]), v[1]) for k, v in state.items()}


def test_a_user_state_is_the_same_in_batch_loop_and_stream(spark):
    from qoeflow.streaming.jobs import chained_state_job
    from qoeflow.streaming.loop import decision_loop_sink, state_table
    u = updates(spark, 120, 8).withColumn("tick", F.floor(F.col("s") / TICK).cast("bigint"))
    stats = S.tick_stats(u)
    rows = [(r.group_id, r.decision, r.tick, r.score_sum, r.n) for r in stats.collect()]
    top = max(r[2] for r in rows)
    want = plain_fade(rows, top)

    def same(df):
        got = {(r.group_id, r.decision): (r.total, r.ticks) for r in df.collect()}
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k]) for k in want)

    policy = fade_policy()
    same(policy.state(stats, top))
    out = chained_state_job(spark, u.withColumn("arrival", F.col("s")), policy, TICK, 1, "arrival", n_files=3)
    newest = out.groupBy("group_id", "decision").agg(F.max_by(F.struct("total", "ticks", "tick"), "tick").alias("x"))
    same(policy.current(newest.select("group_id", "decision", "x.*"), top))
    base = scratch_path(spark, "t-user-state")
    sink = decision_loop_sink(base, ["Id", "decision", "socre"], policy, "From: t")
    first = min(r[2] for r in rows)
    for t in range(first, top + 1):                       # a batch is a tick; some have no data
        batch = u.where(F.col("tick") == t).select(F.to_json(F.struct(
            F.concat_ws("\t", F.lit("1"), "decision", F.col("cost").cast("string")).alias("update"), "group_id")).alias("value"))
        sink(batch, t)
    same(policy.current(state_table(spark, base, policy).read(), top))


def test_late_requests_get_the_version_of_their_own_time(spark):
    from qoeflow.streaming.serving import decision_events, request_events, serve_asof_job
    at = lambda k: BASE * TICK + k * TICK
    dec = spark.createDataFrame([("g", k, f"v{k}", at(k)) for k in (0, 2, 4, 6, 8)] + [("h", 3, "w3", at(3))],
                                "group_id string, k int, p string, t bigint")
    dec = decision_events(dec, "k", "p", F.col("t")).withColumn("arrival", F.unix_timestamp("valid_from"))
    r = random.Random(2)
    asked = [(i, r.choice(["g", "g", "h", "nobody"]), at(0) + r.randint(-150, 950), r.choice([0, 0, 700])) for i in range(120)]
    req = spark.createDataFrame(asked, "req_id bigint, group_id string, t bigint, delay bigint")
    events = request_events(req.withColumn("at", F.col("t")), F.col("at"), F.col("group_id"))
    delay = req.select("req_id", "delay")
    events = events.join(delay, "req_id").withColumn("arrival", F.col("at") + F.col("delay")).select(*events.columns, "arrival")
    out = serve_asof_job(spark, dec, events, TICK, n_files=6, salts=3).collect()
    assert sorted(x.req_id for x in out) == list(range(120)) and any(x.late for x in out) and not all(x.late for x in out)
    known = {"g": [0, 2, 4, 6, 8], "h": [3]}
    for x in out:
        want = [k for k in known.get(x.group_id, []) if at(k) <= x["at"]]
        assert x.version == (want[-1] if want else None) and (x.payload is None) == (not want), x


def test_subscriptions_expire_and_renewals_move_the_expiry(spark):
    from qoeflow.streaming.subscriptions import expiring_fanout_job
    t0, ttl = BASE * TICK, 250
    subs = [("g", "c1", t0), ("g", "c2", t0 + 10), ("g", "c1", t0 + 200), ("g", "me", t0), ("h", "c3", t0 + 900)]
    dec = [("g", t0 + 100, "first"), ("g", t0 + 300, "second"), ("g", t0 + 500, "third"), ("h", t0 + 800, "early"),
           ("h", t0 + 900, "now"), ("k", t0 + 900, "nobody")]
    s = spark.createDataFrame(subs, "group_id string, cluster_id string, at bigint").withColumn("arrival", F.col("at") + 90)
    d = spark.createDataFrame(dec, "group_id string, at bigint, message string").withColumn("arrival", F.col("at"))
    got = sorted((x.group_id, x.cluster_id, x.message) for x in expiring_fanout_job(spark, s, d, "me", ttl, 100).collect())
    assert got == [("g", "c1", "first"), ("g", "c1", "second"), ("g", "c2", "first"), ("h", "c3", "now")]


def test_a_stream_from_a_batch_state_keeps_groups_without_new_data(spark):
    from qoeflow.streaming.jobs import bootstrapped_state_job
    rows = [("old", "a", 3.0, BASE), ("g", "a", 1.0, BASE), ("g", "b", 2.0, BASE + 2), ("g", "a", 1.0, BASE + 5),
            ("new", "b", 4.0, BASE + 6)]
    u = spark.createDataFrame(rows, "group_id string, decision string, cost double, tick bigint")
    st = bootstrapped_state_job(spark, u, 0.8, BASE + 3, BASE + 7, n_files=2)
    want = {(r.group_id, r.decision): (r.score_sum, r.n) for r in
            S.discounted_state(S.tick_stats(u), 0.8, at_tick=BASE + 7).collect()}
    got = {(r.group_id, r.decision): (r.score_sum, r.n) for r in st.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
