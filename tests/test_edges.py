"""Hand-made edge fixtures (reject paths, thresholds, blocks, sorting, draws)."""

import pytest
from pyspark.sql import functions as F

from qoeflow.functions import is_empty, strip_chars
from qoeflow.operators import assign as A
from qoeflow.operators import failover as FO
from qoeflow.operators import records as R
from qoeflow.operators import replay as RP
from qoeflow.operators.rules import flatten_rules, match_groups
from qoeflow.sources.feed import group_assignment
from qoeflow.sources.traces import read_traces, sort_traces

LABELS = ["Id", "decision", "socre"]


def test_parse_rejects(spark):
    rows = [(1, '{"update":"1\\tcdn:a;b\\t3.5","group_id":"g:1;x"}'),
            (2, '{"update":"2\\t\\t3.5","group_id":"g"}'),
            (3, '{"update":"3\\tcdn\\tabc","group_id":"g"}'),
            (4, '{"update":"4\\tcdn'),
            (5, '  {"update":"5\\tcdn\\t2","group_id":"g"}  ')]
    df = spark.createDataFrame(rows, "seq long, value string")
    good, bad = R.parse_updates(df, LABELS)
    g = {r.seq: r for r in good.collect()}
    assert set(g) == {1, 5}
    assert g[1].group_id == "g:1;x" and g[1].decision == "cdn:a;b" and g[1].score == -3.5
    assert g[5].score == -2.0
    assert {r.seq for r in bad.collect()} == {2, 3, 4}


def test_unknown_label_rejected_up_front():
    with pytest.raises(ValueError):
        R.label_indexes(LABELS, ["decision", "nope"])


def test_empty_and_trim(spark):
    df = spark.createDataFrame([("",), ("0",), (None,), ("00",), ("x",)], "v string")
    assert [r.e for r in df.select(is_empty("v").alias("e")).collect()] == [True, True, True, False, False]
    s = spark.createDataFrame([(":\ta:b:\n",)], "v string").select(strip_chars("v").alias("s")).first().s
    assert s == "a:b"


def test_cluster_lookup_defaults(spark):
    msgs = spark.createDataFrame([(1, '{"update":"1\\tx\\t1","group_id":"null"}'),
                                  (2, '{"update":"2\\tx\\t1","group_id":"7"}'),
                                  (3, '{"update":"3\\tx\\t1","group_id":"8"}')], "seq long, value string")
    assign = spark.createDataFrame([("8", "c2"), ("null", "c9")], "group_id string, cluster_id string")
    r = {x.seq: x for x in R.route(msgs, assign, "c0", LABELS, ["decision", "socre"]).collect()}
    assert r[1].cluster_id == "c9" and r[1].topic == "external_groups"     # assigned like any group
    assert r[2].cluster_id == "c0"
    assert r[3].cluster_id == "c2" and r[3].topic == "external_groups"
    assert r[3].reduced == "x\t1"
    clusters = spark.createDataFrame([("c1", "a:1")], "cluster_id string, address string")
    routed = R.route(msgs, assign, "c0", LABELS, ["decision", "socre"])
    fwd, rej = R.forward(routed, clusters, "c0")
    assert fwd.count() == 0 and rej.count() == 2        # unknown clusters -> reject table
    ours = R.lookup_cluster(R.parse_messages(msgs), assign.where("group_id <> 'null'"), "c0").where("seq = 1").first()
    assert ours.cluster_id == "c0"                      # group "null" is ours unless assigned


def test_unreadable_messages_reach_no_topic(spark):
    msgs = spark.createDataFrame([(1, '{"update":"1\\tx\\t1","group_id":"7"}'), (2, '{"update":"1'), (3, None), (4, ""),
                                  (5, '{"group_id":"7"}'), (6, '{"update":"1\\tx\\t1"}')], "seq long, value string")
    assign = spark.createDataFrame([("8", "c2")], "group_id string, cluster_id string")
    good, bad = R.split_messages(msgs)
    assert [r.seq for r in good.collect()] == [1] and bad.columns == msgs.columns
    assert sorted(r.seq for r in bad.collect()) == [2, 3, 4, 5, 6]
    assert [r.seq for r in R.route(msgs, assign, "c0", LABELS, ["decision"]).collect()] == [1]


def test_reject_frames_of_the_readers(spark):
    from qoeflow.operators.exchange import parse_subscriptions, subscription_rejects
    from qoeflow.sources.feed import feed_rejects
    from qoeflow.sources.result_log import parse_result_log, result_log_rejects
    lines = spark.createDataFrame([(1, "0,online,2.5"), (2, "x"), (3, ""), (4, None), (5, "1,local,")],
                                  "line_no long, value string")
    assert [r.line_no for r in parse_result_log(lines).collect()] == [1]
    assert sorted(r.line_no for r in result_log_rejects(lines).collect()) == [2, 3, 4, 5]
    subs = spark.createDataFrame([(1, "g;c1"), (2, "g"), (3, None), (4, "")], "seq long, value string")
    assert parse_subscriptions(subs).count() == 1
    assert sorted(r.seq for r in subscription_rejects(subs).collect()) == [2, 3, 4]
    feed = spark.createDataFrame([(1, '{"GroupAssignment":[]}'), (2, '{"GroupingRules":{"GroupName":"x"}}'),
                                  (3, "{"), (4, '{"other":1}'), (5, None)], "seq long, value string")
    assert sorted(r.seq for r in feed_rejects(feed).collect()) == [3, 4, 5]
    w = spark.createDataFrame([("g", 1, "a;0.125"), ("g", 2, "b;0.004"), ("g", 3, "bad"), ("g", 4, "c;x")],
                              "group_id string, pos int, line string")
    assert [float(r.p) for r in A.parse_weights(w).orderBy("pos").collect()] == [0.125, 0.004]
    assert sorted(r.pos for r in A.weight_rejects(w).collect()) == [3, 4]


def test_rule_matching_keeps_repeated_requests_and_needs_no_shuffle(spark):
    leaves = flatten_rules(spark.createDataFrame([(1, RULES)], "doc_id long, rules string"))
    req = spark.createDataFrame([(1, ["a", "x", "d"]), (1, ["a", "x", "d"]), (1, ["b", "x", "d"]), (None, None)],
                                "req_id long, features array<string>")
    out = match_groups(req, leaves, F.lit("dflt"))
    assert sorted(r.group_id for r in out.collect()) == ["ax2", "ax2", "b", "dflt"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    head = plan[:plan.index("BroadcastExchange")] if "BroadcastExchange" in plan else ""
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in head


def test_three_frontends_in_the_report(spark):
    rows = [(i, i % 3, float(i % 3)) for i in range(900)]
    log = FO.two_series(spark.createDataFrame(rows, "line_no long, url_idx int, cost double"))
    m = FO.block_means(log, 100)
    assert FO.block_gap(m).first().gap == 3             # 3 blocks of frontend 0, 6 of the others
    assert FO.block_zip(m).count() == 3


RULES = ('{"Field":"0","Table":['
         '{"Key":"a","Rule":{"Field":"1","Table":[{"Key":"x","Rule":{"GroupName":"ax"}},'
         '{"Key":"y","Rule":{"GroupName":"ay"}},{"Key":"x","Rule":{"GroupName":"ax2"}}]}},'
         '{"Key":"b","Rule":{"GroupName":"b"}},'
         '{"Key":"01","Rule":{"GroupName":"zero-one"}}]}')


def test_rules_last_wins_and_default(spark):
    leaves = flatten_rules(spark.createDataFrame([(1, RULES)], "doc_id long, rules string"))
    assert leaves.count() == 5
    req = spark.createDataFrame([(1, ["a", "x", "d1"]), (2, ["a", "y", "d2"]), (3, ["a", "q", "d3"]),
                                 (4, ["b", "x", "d4"]), (5, ["1", "x", "d5"])],
                                "req_id long, features array<string>")
    out = {r.req_id: (r.group_id, r.matched) for r in
           match_groups(req, leaves, F.get("features", 2)).collect()}
    assert out[1] == ("ax2", True)          # duplicate key: the later one wins
    assert out[2] == ("ay", True)
    assert out[3] == ("d3", False)          # missing inner key -> default
    assert out[4] == ("b", True)            # leaf at level 1
    assert out[5] == ("d5", False)          # string equality, not numeric ("01" != "1")


def _plain_rules(node, features):
    """The group the compiled document assigns last."""
    found = None
    if "GroupName" in node:
        return node["GroupName"]
    for e in node.get("Table", []):
        f = int(node["Field"])
        if f < len(features) and features[f] is not None and features[f] == e["Key"]:
            found = _plain_rules(e["Rule"], features) or found
    return found


def test_deep_and_wide_rules_take_one_join_a_level(spark):
    """500 condition-field signatures; equal prefixes that go on with other fields."""
    import json
    import random
    r = random.Random(11)
    fields = list(range(1, 12))

    def node(left, name):
        if not left:
            return {"GroupName": name}
        return {"Field": str(left[0]), "Table": [
            {"Key": k, "Rule": node(left[1:], f"{name}-{k}")} for k in r.choices("pqr", k=2)]}
    sets = set()
    while len(sets) < 500:
        sets.add(tuple(sorted(r.sample(fields, r.randint(1, 4)))))
    doc = {"Field": "0", "Table": [{"Key": r.choice("uvw"), "Rule": node(list(x), f"g{i}")} for i, x in enumerate(sorted(sets))]}
    leaves = flatten_rules(spark.createDataFrame([(1, json.dumps(doc))], "doc_id long, rules string"))
    req = [(i, [r.choice("uvwx"), *(r.choice(["p", "q", "r", "s", None]) for _ in range(r.randint(3, 11)))]) for i in range(60)]
    out = match_groups(spark.createDataFrame(req, "req_id long, features array<string>"), leaves, F.lit("dflt"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 12                      # two for each of the five levels, where a signature a join gave 500
    got = {x.req_id: x.group_id for x in out.collect()}
    assert got == {i: _plain_rules(doc, f) or "dflt" for i, f in req}
    assert len(set(got.values())) > 20


def test_root_leaf_matches_everything(spark):
    leaves = flatten_rules(spark.createDataFrame([(1, '{"GroupName":"all"}')], "doc_id long, rules string"))
    req = spark.createDataFrame([(1, ["a"])], "req_id long, features array<string>")
    assert match_groups(req, leaves, F.lit("dflt")).first().group_id == "all"


def test_assignment_last_write_wins(spark):
    feed = spark.createDataFrame([
        (1, '{"GroupAssignment":[{"GroupName":"g","Cluster":"c1"},{"GroupName":"g","Cluster":"c2"}]}'),
        (2, '{"GroupingRules":{"GroupName":"x"}}'),
        (3, '{"GroupAssignment":[{"GroupName":"h","Cluster":"c3"}]}')], "seq long, value string")
    out = {r.group_id: r.cluster_id for r in group_assignment(feed, "c0").collect()}
    assert out == {"g": "c2", "h": "c3", "null": "c0"}


def test_load_factor_strict_and_numeric(spark):
    thr = "array(named_struct('threshold', 0.1D, 'factor', 1.5D), named_struct('threshold', 9D, 'factor', 2D)," \
          " named_struct('threshold', 10D, 'factor', 4D))"
    df = spark.createDataFrame([(0.1,), (0.05,), (9.5,), (10.0,), (10.5,)], "load double")
    got = [r.f for r in df.select(RP.load_factor(F.col("load"), F.expr(thr)).alias("f")).collect()]
    assert got == [1.0, 1.0, 2.0, 2.0, 4.0]


def test_blocks_tail_and_zip(spark):
    rows = [(i, 0, 1.0) for i in range(101)] + [(1000 + i, 1, 2.0) for i in range(250)]
    log = spark.createDataFrame(rows, "line_no long, url_idx int, cost double")
    m = FO.block_means(log, 100)
    assert sorted((r.url_idx, r.block) for r in m.collect()) == [(0, 0), (1, 0), (1, 1)]
    assert FO.block_zip(m).count() == 1
    assert FO.block_gap(m).first().gap == 1


def test_trace_sort_text_vs_numeric(spark):
    lines = spark.createDataFrame([(0, "1000\ta"), (1, "999\tb"), (2, "999\tc")], "line_no long, value string")
    txt = {r.line_no: r.sort_pos for r in sort_traces(lines).collect()}
    num = {r.line_no: r.sort_pos for r in sort_traces(lines, numeric=True).collect()}
    assert txt == {0: 1, 1: 2, 2: 3}
    assert num == {1: 1, 2: 2, 0: 3}


def test_trace_parse_duplicates_last_win(spark):
    line = "5000\tf1\tDecisionMap\ta,1.5\tb,2\ta,3\tLoadMap\ta,0.1;2;0.5;3\tb,0.2;4"
    t = read_traces(spark.createDataFrame([(0, line)], "line_no long, value string")).first()
    assert t.ts_s == 5 and t.decision_map == {"a": 3.0, "b": 2.0}
    assert [(x.threshold, x.factor) for x in t.load_map["a"]] == [(0.1, 2.0), (0.5, 3.0)]


def test_dense_grid_zero_fills(spark):
    b = spark.createDataFrame([(0, True), (0, False), (3, True)], "second long, ok boolean")
    rps = {r.second: (r.sent, r.succeeded) for r in RP.requests_per_second(b).collect()}
    assert rps == {0: (2, 1), 1: (0, 0), 2: (0, 0), 3: (1, 1)}


def test_weighted_draw_bounds(spark):
    w = spark.createDataFrame([("g", 1, "a", "0.30"), ("g", 2, "b", "0.30"),     # sums to 0.6 < 1
                               ("h", 1, "a", "0.70"), ("h", 2, "b", "0.70"),     # sums to 1.4 > 1
                               ("k", 1, "only", "0.10")],
                              "group_id string, pos int, decision string, p string") \
        .withColumn("p", F.col("p").cast("decimal(5,2)"))
    req = spark.range(300).select(F.col("id").alias("req_id"),
                                  F.element_at(F.array(*map(F.lit, "ghk")), (F.col("id") % 3 + 1).cast("int"))
                                  .alias("group_id"))
    out = A.assign_weighted(req, w, "s").collect()
    assert all(r.decision in ("a", "b") for r in out if r.group_id in ("g", "h"))
    assert all(r.decision == "only" for r in out if r.group_id == "k")
    # draw v in [0,100]: g picks 'a' iff v <= 30, else 'b' (also past the end -> last)
    assert {r.decision for r in out if r.group_id == "g"} == {"a", "b"}


def test_fallback_when_unavailable(spark):
    req = spark.createDataFrame([(1, "g", ["x", "y"]), (2, "h", ["x"]), (3, "none", ["x"])],
                                "req_id long, group_id string, candidates array<string>")
    latest = spark.createDataFrame([("g", "x:x:x:"), ("h", "z:z:")], "group_id string, slots string")
    out = {r.req_id: (r.decision, r.source) for r in A.assign_slots(req, latest, "s").collect()}
    assert out[1] == ("x", "policy")
    assert out[2] == ("x", "fallback")       # decided 'z' is not a candidate
    assert out[3] == ("x", "fallback")       # no decision for the group


def test_round4_agrees_with_duckdb_on_halves(spark):
    import duckdb
    vals = [14 / 320, 3 / 800, 0.00625, -2.34565, 1.00005, 123456.78905, 0.1 + 0.2, 2.5e-5]
    got = [r.x for r in spark.createDataFrame([(v,) for v in vals], "v double")
           .select(__import__("qoeflow.functions", fromlist=["round4"]).round4("v").alias("x")).collect()]
    con = duckdb.connect()
    want = [con.execute("SELECT CAST(round(CAST(?::DOUBLE AS DECIMAL(38,12)), 4) AS DOUBLE)", [v]).fetchone()[0]
            for v in vals]
    assert got == want


def test_single_decision_single_tick(spark):
    from qoeflow.operators import stats as S
    from qoeflow.operators.policy import DiscountedUCB
    st = spark.createDataFrame([("g", "only", 7, -4.0, 2)],
                               "group_id string, decision string, tick bigint, score_sum double, n bigint")
    d = S.discounted_state(st, 0.8).first()
    assert (d.score_sum, d.n, d.last_tick) == (-4.0, 2.0, 7)
    assert DiscountedUCB(0.8, 10, 1000.0).decide(S.discounted_state(st, 0.8)).first().slots == ["only"] * 10


def test_blocks_99_and_100(spark):
    rows = [(i, 0, 1.0) for i in range(99)] + [(500 + i, 1, 3.0) for i in range(100)]
    m = FO.block_means(spark.createDataFrame(rows, "line_no long, url_idx int, cost double"), 100)
    assert [(r.url_idx, r.block, r.mean_cost) for r in m.collect()] == [(1, 0, 3.0)]
    assert FO.block_zip(m).count() == 0
    g = FO.block_gap(m).first()
    assert (g.n_blocks_a, g.n_blocks_b, g.gap) == (0, 1, 1)


def test_cost_per_second_null_without_success(spark):
    b = spark.createDataFrame([(0, True), (0, False), (1, False), (3, True)], "second long, ok boolean")
    costed = spark.createDataFrame([(0, 2.5), (3, 1.0)], "second long, cost double")
    out = {r.second: (r.sent, r.succeeded, r.avg_cost) for r in RP.cost_per_second(b, costed).collect()}
    assert out == {0: (2, 1, 2.5), 1: (1, 0, None), 2: (0, 0, None), 3: (1, 1, 1.0)}


def test_watermark_drops_late_rows(spark):
    from qoeflow.streaming.jobs import late_rows_job
    # slice 0 (event ids 0-19) is on Jan 6, slice 1 (20-39) on Jan 1: late by days
    rows = [(i, "2024-01-06 00:00:00" if i < 20 else "2024-01-01 00:00:00", "click") for i in range(40)]
    df = (spark.createDataFrame(rows, "event_id long, ts string, decision string")
          .withColumn("ts", F.to_timestamp("ts")))
    out = late_rows_job(spark, df, "6 hours", "1 hour", n_files=2, order="event_id")
    # the Jan 1 rows come after the watermark (Jan 5 23:00); the Jan 6 window
    # is still open
    assert [(r.window_start, r.n) for r in out.collect()] in ([], [(1704067200, 20)])


def test_epsilon_message_roundtrip(spark):
    dec = spark.createDataFrame([("g", "a", ["b", "c"], 0.9), ("h", "x", [], 0.5)],
                                "group_id string, best string, rest array<string>, epsilon double")
    msgs = R.format_epsilon(dec, "From: c0")
    assert msgs.where("group_id = 'g'").first().message == \
        'g;{"random":["b","c"],"best":"a","epsilon":0.9};From: c0'
    back = {r.group_id: (r.best, r.rest, r.epsilon) for r in R.parse_epsilon(msgs).collect()}
    assert back == {"g": ("a", ["b", "c"], 0.9), "h": ("x", [], 0.5)}


def test_no_candidates_gives_null_not_error(spark):
    req = spark.createDataFrame([(1, "g", [])], "req_id long, group_id string, candidates array<string>")
    latest = spark.createDataFrame([("g", "a:")], "group_id string, slots string")
    r = A.assign_slots(req, latest, "s").first()
    assert r.decision is None and r.source == "fallback"


def test_ansi_safe_edges(spark):
    from qoeflow.sources.traces import read_traces, sort_traces
    # empty decision map: the local fallback is null, not an index error
    s = spark.createDataFrame([(0, "x", False, {})], "line_no long, decision string, ok boolean, "
                              "decision_map map<string,double>")
    r = FO.round_robin(s, 2).first()
    assert r.chosen is None and r.mode == "local"
    # non-numeric trace time: null time, and the numeric sort still runs
    lines = spark.createDataFrame([(0, "abc\tDecisionMap\ta,1\tLoadMap\ta,0.1;2"), (1, "5\tx")],
                                  "line_no long, value string")
    assert read_traces(lines).orderBy("line_no").first().ts_s is None
    assert sort_traces(lines, numeric=True).count() == 2
    # epsilon decision without a rest list
    eg = spark.createDataFrame([("g", "a", None, 0.9)],
                               "group_id string, best string, rest array<string>, epsilon double")
    req = spark.createDataFrame([(1, "g", ["a"])], "req_id long, group_id string, candidates array<string>")
    assert A.assign_epsilon(req, eg, "s").first().decision == "a"
