"""Property tests: operators against plain-Python twins of the reference
semantics on small random fixtures (brute force; no SQL needed)."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from qoeflow.functions import hash_u32
from qoeflow.operators import assign as A
from qoeflow.operators import failover as FO
from qoeflow.operators import replay as RP

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def weighted_walk(weights, value):
    """The serving loop: subtract p*100 from the draw until <= 0; else last."""
    out = None
    for d, p in weights:
        value -= p * 100
        out = d
        if value <= 0:
            return d
    return out


@SETTINGS
@given(st.lists(st.integers(min_value=0, max_value=60), min_size=1, max_size=5))
def test_weighted_draw_matches_walk(spark, pcts):
    from decimal import Decimal
    ws = [(f"d{i}", Decimal(p) / 100) for i, p in enumerate(pcts)]
    wdf = spark.createDataFrame([("g", i + 1, d, p) for i, (d, p) in enumerate(ws)],
                                "group_id string, pos int, decision string, p decimal(5,2)")
    req = spark.range(60).select(F.col("id").alias("req_id"), F.lit("g").alias("group_id"))
    got = {r.req_id: r.decision for r in A.assign_weighted(req, wdf, "s").collect()}
    draws = {r.req_id: r.v for r in req.select(
        "req_id", F.pmod(hash_u32(F.lit("s"), F.lit("weighted"), F.col("req_id")), F.lit(101)).alias("v")
    ).collect()}
    for k, v in draws.items():
        assert got[k] == weighted_walk(ws, v)


@SETTINGS
@given(st.lists(st.sampled_from(["a", "b", "c", "d"]), min_size=0, max_size=3, unique=True),
       st.floats(min_value=0.0, max_value=1.0))
def test_epsilon_draw_matches_rule(spark, rest, eps):
    eg = spark.createDataFrame([("g", "z", sorted(rest), eps)],
                               "group_id string, best string, rest array<string>, epsilon double")
    req = (spark.range(40).select(F.col("id").alias("req_id"), F.lit("g").alias("group_id"),
                                  F.array(*map(F.lit, "abcdz")).alias("candidates")))
    got = {r.req_id: r.decision for r in A.assign_epsilon(req, eg, "s").collect()}
    u = {r.req_id: (r.r, r.x) for r in req.select(
        "req_id", F.pmod(hash_u32(F.lit("s"), F.lit("eps"), F.col("req_id")), F.lit(101)).alias("r"),
        hash_u32(F.lit("s"), F.lit("explore"), F.col("req_id")).alias("x")).collect()}
    rs = sorted(rest)
    for k, (r, x) in u.items():
        want = "z" if not rs else (rs[x % len(rs)] if r < eps * 100 else "z")
        assert got[k] == want


@SETTINGS
@given(st.floats(min_value=0.0, max_value=1.0),
       st.lists(st.tuples(st.floats(min_value=0.0, max_value=1.0), st.floats(min_value=1.0, max_value=5.0)),
                min_size=0, max_size=4, unique_by=lambda x: x[0]))
def test_load_factor_matches_descending_scan(spark, load, table):
    def scan(load, table):
        for thr, fac in sorted(table, reverse=True):
            if load > thr:
                return fac
        return 1.0
    arr = F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(f).alias("factor")) for t, f in table]) \
        if table else F.array().cast("array<struct<threshold:double,factor:double>>")
    got = spark.range(1).select(RP.load_factor(F.lit(load), arr).alias("f")).first().f
    # thresholds are unique: a parsed load map keeps one factor per threshold
    assert got == pytest.approx(scan(load, table))


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 50)), min_size=1, max_size=700))
def test_block_means_match_counting_loop(spark, recs):
    rows = [(i, src, float(c)) for i, (src, c) in enumerate(recs)]
    df = spark.createDataFrame(rows, "line_no long, url_idx int, cost double")
    got = {(r.url_idx, r.block): r.mean_cost for r in FO.block_means(df, 100).collect()}
    want = {}
    for src in {s for s, _ in recs}:
        seq = [c for s, c in recs if s == src]
        for b in range(len(seq) // 100):
            want[(src, b)] = sum(seq[b * 100:(b + 1) * 100]) / 100
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k])


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from("xy"), st.booleans()), min_size=1, max_size=120))
def test_running_load_share_matches_counters(spark, sess):
    rows = [(i, m, d, ok) for i, (m, d, ok) in enumerate(sess)]
    b = spark.createDataFrame(rows, "line_no long, minute long, decision string, ok boolean") \
        .withColumn("ts_s", F.col("line_no"))
    got = {r.line_no: r.load for r in RP.load_share(b).collect()}
    total = {}
    for _, m, _, _ in rows:
        total[m] = total.get(m, 0) + 1
    run, want = {}, {}
    for i, m, d, ok in rows:
        if ok:
            run[(m, d)] = run.get((m, d), 0) + 1
            want[i] = run[(m, d)] / total[m]
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k]) for k in want)


def _tree(draw, depth):
    if depth == 0 or draw(st.booleans()) and depth < 3:
        return {"GroupName": draw(st.sampled_from(["A", "B", "C", "D", "E"]))}
    field = draw(st.integers(0, 2))
    keys = draw(st.lists(st.sampled_from(["0", "1", "2"]), min_size=1, max_size=3))  # duplicates allowed
    return {"Field": str(field), "Table": [{"Key": k, "Rule": _tree(draw, depth - 1)} for k in keys]}


@st.composite
def rule_trees(draw):
    return {"Field": "0", "Table": [{"Key": k, "Rule": _tree(draw, 2)}
                                    for k in draw(st.lists(st.sampled_from(["0", "1", "2"]), min_size=1,
                                                           max_size=3))]}


def run_rules(node, feats, out):
    """Nested ifs in document order; the last executed assignment wins."""
    if "Field" in node:
        for e in node["Table"]:
            if feats[int(node["Field"])] == e["Key"]:
                out = run_rules(e["Rule"], feats, out)
        return out
    return node["GroupName"]


@SETTINGS
@given(rule_trees())
def test_rule_matching_matches_nested_ifs(spark, tree):
    import itertools
    import json
    from qoeflow.operators.rules import flatten_rules, match_groups
    leaves = flatten_rules(spark.createDataFrame([(1, json.dumps(tree))], "doc_id long, rules string"))
    combos = list(itertools.product("012", repeat=3))
    req = spark.createDataFrame([(i, list(c)) for i, c in enumerate(combos)],
                                "req_id long, features array<string>")
    got = {r.req_id: r.group_id for r in match_groups(req, leaves, F.lit("dflt")).collect()}
    for i, c in enumerate(combos):
        assert got[i] == (run_rules(tree, c, None) or "dflt")


@SETTINGS
@given(st.lists(st.lists(st.tuples(st.sampled_from("ghij"), st.sampled_from(["c1", "c2", "c3"])),
                         min_size=0, max_size=4), min_size=1, max_size=4))
def test_group_assignment_matches_map_puts(spark, msgs):
    import json
    from qoeflow.sources.feed import group_assignment
    feed = spark.createDataFrame(
        [(i, json.dumps({"GroupAssignment": [{"GroupName": g, "Cluster": c} for g, c in m]}))
         for i, m in enumerate(msgs)], "seq long, value string")
    want = {"null": "c0"}
    for m in msgs:
        for g, c in m:
            want[g] = c
    got = {r.group_id: r.cluster_id for r in group_assignment(feed, "c0").collect()}
    assert got == want


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 99)), min_size=1, max_size=6),
       st.lists(st.tuples(st.sampled_from("abc"),
                          st.lists(st.tuples(st.integers(1, 9), st.integers(1, 9)), min_size=1, max_size=3)),
                min_size=1, max_size=4))
def test_trace_parse_matches_dict_semantics(spark, dmap, lmap):
    from qoeflow.sources.traces import read_traces
    dtxt = "\t".join(f"{k},{v}" for k, v in dmap)
    ltxt = "\t".join(f"{k}," + ";".join(f"{t / 10};{f}" for t, f in ps) for k, ps in lmap)
    line = f"12345\tfeat\tDecisionMap\t{dtxt}\tLoadMap\t{ltxt}\n"
    t = read_traces(spark.createDataFrame([(0, line)], "line_no long, value string")).first()
    assert t.decision_map == {k: float(v) for k, v in dict(dmap).items()}
    want = {k: [(x / 10, float(f)) for x, f in ps] for k, ps in dict(lmap).items()}
    assert {k: [(p.threshold, p.factor) for p in v] for k, v in t.load_map.items()} == want
    assert t.ts_s == 12


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 10**6)), min_size=1, max_size=300,
                unique_by=lambda x: x[1]), st.sampled_from([1, 7, 1 << 16]))
def test_ordinal_by_number_equals_row_number(spark, rows, bucket):
    from pyspark.sql import Window
    from qoeflow.operators.ordinals import ordinal_by_number
    df = spark.createDataFrame(rows, "src int, line_no long")
    got = {r.line_no: r.ord for r in ordinal_by_number(df, ["src"], "line_no", bucket=bucket).collect()}
    want = {r.line_no: r.o for r in df.select("line_no", F.row_number().over(
        Window.partitionBy("src").orderBy("line_no")).alias("o")).collect()}
    assert got == want
