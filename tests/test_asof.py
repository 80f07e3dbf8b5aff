"""As-of join and block-wise window sums against plain Python."""

import random
from bisect import bisect_left, bisect_right

import pytest
from pyspark.sql import functions as F

from qoeflow.operators.asof import asof_join, block_width
from qoeflow.operators.stats import sums_in_window, windowed_stats


def brute_asof(left, right, strict):
    by = {}
    for k, t, v in right:
        if k is not None and t is not None:
            by.setdefault(k, []).append((t, v))
    for x in by.values():
        x.sort()
    out = []
    for i, k, t in left:
        hit = None
        if k in by and t is not None:
            times = [a for a, _ in by[k]]
            at = (bisect_left if strict else bisect_right)(times, t)
            hit = by[k][at - 1][1] if at else None
        out.append((i, k, t, hit))
    return sorted(out, key=repr)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("width", [None, 3, 1000])
def test_asof_equals_plain_search(spark, strict, width):
    r = random.Random(7)
    key = lambda: r.choice(["hot"] * 6 + ["a", "b", "never", None])
    left = [(i, key(), r.choice([None, *range(200)]) if i % 9 == 0 else r.randint(-20, 220)) for i in range(600)]
    right = [(k, r.choice([None, r.randint(0, 200)]), r.randint(0, 10**6)) for k in (key() for _ in range(300))
             if k != "never"]
    lf = spark.createDataFrame(left, "id int, k string, t int").repartition(5)
    rf = spark.createDataFrame(right, "k string, t int, v int").repartition(4)
    got = asof_join(lf, rf, ["k"], "t", "t", ["v"], strict=strict, width=width)
    rows = sorted(((x.id, x.k, x.t, x.matched and x.matched.v) for x in got.collect()), key=repr)
    assert rows == brute_asof(left, right, strict)
    assert asof_join(lf, rf.limit(0), ["k"], "t", "t", ["v"], width=width).where("matched is not null").count() == 0


def test_asof_of_doubles_and_a_hot_key_in_many_blocks(spark):
    n = 30_000
    left = spark.range(n).select(F.lit("hot").alias("k"), (F.col("id") / 7.0).alias("x"), "id")
    right = spark.range(0, n, 10).select(F.lit("hot").alias("k"), (F.col("id") / 7.0).alias("y"), F.col("id").alias("v"))
    width = block_width(right, "y", rows=100)
    got = asof_join(left, right, ["k"], "x", "y", ["v"], width=width)
    assert got.where(F.col("matched.v") != F.floor(F.col("id") / 10) * 10).count() == 0 and got.count() == n
    # the exchange deals rows by (key, block): no task can get the key as a whole
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_k0" in plan and "_b" in plan
    blocks = left.groupBy(F.floor(F.col("x") / width)).count().agg(F.max("count")).first()[0]
    assert blocks <= 1100


@pytest.mark.parametrize("length", [1, 2, 4, 37, 5000])
def test_window_sums_equal_plain_sums(spark, length):
    r = random.Random(length)
    rows = {(g, d, t): (r.randint(-500, 500) / 100, r.randint(1, 9))
            for g in ("g1", "g2") for d in ("a", "b") for t in r.sample(range(-30, 9000 if length > 100 else 120), 60)}
    stats = spark.createDataFrame([(*k, *v) for k, v in rows.items()],
                                  "group_id string, decision string, tick bigint, score_sum double, n bigint")
    want = {(g, d, t): (sum(s for (a, b, u), (s, _) in rows.items() if (a, b) == (g, d) and t - length < u <= t),
                        sum(n for (a, b, u), (_, n) in rows.items() if (a, b) == (g, d) and t - length < u <= t))
            for g, d, t in rows}
    got = {(x.group_id, x.decision, x.tick): (x.score_sum, x.n) for x in windowed_stats(stats, length).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)
    asked = spark.createDataFrame([("g1", "a", t) for t in (-100, 0, 50, 10**6)], "group_id string, decision string, at bigint")
    for x in sums_in_window(stats, asked, length).collect():
        n = sum(n for (a, b, u), (_, n) in rows.items() if (a, b) == ("g1", "a") and x["at"] - length < u <= x["at"])
        assert (x.n or 0) == n and (x.n is None) == (n == 0)


def test_window_cost_does_not_follow_the_length(spark):
    """Rows that the windows see: three for each row of the input, whatever the
    length, and no (group, decision) as a whole in one partition."""
    stats = spark.range(40_000).select(F.lit("g").alias("group_id"), F.lit("d").alias("decision"), F.col("id").alias("tick"),
                                       F.lit(1.0).alias("score_sum"), F.lit(1).cast("bigint").alias("n"))
    for length in (4, 5000):
        w = windowed_stats(stats, length)
        assert w.where(F.col("n") != F.least(F.col("tick") + 1, F.lit(length))).count() == 0
        plan = w._jdf.queryExecution().executedPlan().toString()
        assert "specifiedwindowframe(RangeFrame, unboundedpreceding$(), currentrow$())" in plan
        assert "_b" in plan and "RangeFrame, -" not in plan
