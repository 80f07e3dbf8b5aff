"""The registered queries: name -> f(spark, sf_dir) -> DataFrame.

Each query binds a library operator to the fixture views (``views``) and
rounds computed doubles to 4 places so results compare exactly with the
DuckDB oracle in ``oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qoeflow.functions import hash_u32, round4
from qoeflow.operators import stats as S
from qoeflow.operators.assign import (
    assign_epsilon, assign_slots, assign_weighted, draw_slots, format_weights, parse_weights,
)
from qoeflow.operators.exchange import (
    auto_subscribe, fan_out, feature_histogram, heartbeats, parse_subscriptions,
    subscriber_sets,
)
from qoeflow.operators.failover import (
    block_gap, block_means, block_zip, cost_by_mode, round_robin, two_series,
)
from qoeflow.operators.policy import DiscountedUCB, EpsilonGreedy, Policy, StatePolicy
from qoeflow.operators.records import (
    available, decode_decision, drop_managed, format_decision, format_epsilon, forward,
    parse_epsilon, parse_messages, parse_updates, project_labels, read_label_config, route, split_request,
)
from qoeflow.operators.replay import (
    adjusted_cost, cost_per_second, load_factor_table, load_share, narrow, replay_policy, requests_per_second,
    sessions_per_minute, with_buckets,
)
from qoeflow.operators.rules import flatten_rules, match_groups
from qoeflow.plans import params as P
from qoeflow.plans import views as V
from qoeflow.session import scratch_path, write_once
from qoeflow.sources.feed import group_assignment, latest_rules
from qoeflow.sources.lines import read_lines
from qoeflow.sources.result_log import parse_result_log, read_result_log
from qoeflow.sources.sinks import export_epsilon, latest_decision, write_series
from qoeflow.sources.traces import read_trace_files, read_traces, sort_traces, trace_text
from qoeflow.streaming.exchange import (
    epsilon_lines_job, exchange_job, forward_job, group_table_job, latest_decision_job, newest_update_job, window_ring_job,
)
from qoeflow.streaming.jobs import (
    decision_state_job, ingest_job, multi_sink_job, topic_roundtrip_job,
)
from qoeflow.streaming.state import decay_to


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(f):
        REGISTRY[name] = f
        return f
    return deco


def ducb() -> DiscountedUCB:
    return DiscountedUCB(P.GAMMA, P.SLOTS, P.BONUS)


def egreedy() -> EpsilonGreedy:
    return EpsilonGreedy(P.EPSILON, P.EG_WINDOW_TICKS)


def _stats(spark, sf_dir):
    return S.tick_stats(V.updates(spark, sf_dir))


def _last_tick(spark, sf_dir):
    """Latest tick, computed once as a literal: max(ts) is one aggregate over
    one column (answered from parquet footers when aggregate pushdown is
    on).  A scalar subquery referenced in several expressions is executed
    once per reference (Spark does not reuse it here)."""
    from qoeflow.functions import tick_of
    mx = V.table(spark, sf_dir, "events").agg(F.max("ts").alias("m"))
    return F.lit(mx.select(tick_of("m", P.TICK_S)).first()[0]).cast("bigint")


def _window_sums(spark, sf_dir, by=None):
    """Sums of the epsilon-greedy window ending at the last tick: only these
    ticks are read."""
    from qoeflow.functions import in_ticks, tick_of
    ev = V.table(spark, sf_dir, "events")
    top = ev.agg(F.max("ts").alias("m")).select(tick_of("m", P.TICK_S)).first()[0]
    u = V.updates_of(in_ticks(ev, "ts", P.TICK_S, top - P.EG_WINDOW_TICKS + 1, top))
    return S.window_sums(u if by is None else u.withColumn("group_id", by), P.EG_WINDOW_TICKS, top)


def _trace_start(spark, sf_dir):
    """First second of the trace, once, as a literal (same reasoning)."""
    mn = V.table(spark, sf_dir, "events").agg(F.min("ts").alias("m"))
    return F.lit(mn.select(F.unix_timestamp("m")).first()[0]).cast("bigint")


# ---------------------------------------------------------------- policies
@query("tick_stats")
def q_tick_stats(spark, sf_dir):
    s = _stats(spark, sf_dir)
    return s.select("group_id", "decision", "tick", round4("score_sum").alias("score_sum"), "n")


@query("score_lists")
def q_score_lists(spark, sf_dir):
    s = S.score_lists(V.updates(spark, sf_dir))
    return s.select("group_id", "decision", "tick", F.array_join(F.transform("scores", lambda x: F.round(x * 100).cast(
        "bigint").cast("string")), ",").alias("cents"))


@query("discounted_state")
def q_discounted_state(spark, sf_dir):
    st = _dstate(spark, sf_dir)
    return st.select("group_id", "decision", round4("score_sum").alias("score_sum"),
                     round4("n").alias("n"), round4(S.mean_col()).alias("mean"), "last_tick")


@query("ucb_slots")
def q_ucb_slots(spark, sf_dir):
    pol = ducb()
    dec = pol.decide(pol.state(_stats(spark, sf_dir), at_tick=_last_tick(spark, sf_dir)))
    return dec.select("group_id", F.array_join("slots", ":").alias("slots"))


@query("decision_map")
def q_decision_map(spark, sf_dir):
    dm = S.decision_map(_stats(spark, sf_dir))
    vals = F.map_values("dmap")
    return dm.select(
        "group_id",
        F.array_join(F.array_sort(F.map_keys("dmap")), ",").alias("decisions"),
        F.aggregate(vals, F.lit(0.0), lambda a, v: a + v["n"]).cast("bigint").alias("n_total"),
        round4(F.aggregate(vals, F.lit(0.0), lambda a, v: a + v["score_sum"])).alias("score_total"))


def _dstate(spark, sf_dir):
    return S.discounted_state(_stats(spark, sf_dir), P.GAMMA, at_tick=_last_tick(spark, sf_dir))


@query("group_means")
def q_group_means(spark, sf_dir):
    m = S.means(_dstate(spark, sf_dir))
    return m.select("group_id", "decision", round4("mean").alias("mean"), round4("N").alias("N"))


@query("state_merge")
def q_state_merge(spark, sf_dir):
    """Fold the last tick into the state at the tick before; equals A5 at T."""
    st = _stats(spark, sf_dir)
    T = _last_tick(spark, sf_dir)
    old = S.discounted_state(st, P.GAMMA, at_tick=T - 1)
    new = st.where(F.col("tick") == T)
    m = S.merge_state(new, old, P.GAMMA)
    return m.select("group_id", "decision", round4("score_sum").alias("score_sum"),
                    round4("n").alias("n"))


@query("ucb_index")
def q_ucb_index(spark, sf_dir):
    idx = ducb().index(_dstate(spark, sf_dir))
    return idx.select("group_id", "decision", round4("mean").alias("mean"), round4("N").alias("N"),
                      round4("ucb").alias("ucb"), F.col("rnk").cast("bigint").alias("rnk"))


def eg_decisions(spark, sf_dir):
    return egreedy().decide(_window_sums(spark, sf_dir))


@query("best_decision")
def q_best_decision(spark, sf_dir):
    d = eg_decisions(spark, sf_dir)
    return d.select("group_id", "best", F.array_join("rest", ",").alias("rest"), "epsilon")


@query("sliding_stats")
def q_sliding_stats(spark, sf_dir):
    w = S.windowed_stats(_stats(spark, sf_dir), P.EG_WINDOW_TICKS)
    return w.select("group_id", "decision", "tick", round4("score_sum").alias("score_sum"),
                    F.col("n").cast("bigint").alias("n"))


@query("epsilon_export_lines")
def q_epsilon_export(spark, sf_dir):
    """S8 after the D8 message round trip: decisions -> JSON messages ->
    parsed -> ordered lines (epsilon, best, random...)."""
    msgs = format_epsilon(eg_decisions(spark, sf_dir), P.ORIGIN)
    lines = export_epsilon(parse_epsilon(msgs))
    return lines.select("group_id", F.col("pos").cast("bigint").alias("pos"), "line")


class GreedyMean(Policy):
    """A user policy: discounted state, pure exploitation, in pandas over
    batches of groups (ties to the smallest decision name, as lists are
    sorted)."""
    decision_schema = "group_id string, decision string"

    def decide_batch(self, pdf):
        best = []
        for names, sums, ns in zip(pdf["decisions"], pdf["score_sums"], pdf["ns"]):
            ns = np.asarray(ns)
            best.append(names[int(np.argmax(np.where(ns > 0, np.asarray(sums) / np.where(ns > 0, ns, 1), 0.0)))])
        return pdf[["group_id"]].assign(decision=best)


@query("custom_policy")
def q_custom_policy(spark, sf_dir):
    pol = GreedyMean(P.GAMMA)
    return pol.decide(pol.state(_stats(spark, sf_dir), at_tick=_last_tick(spark, sf_dir)))


class BetaCounts(StatePolicy):
    """A user policy with a state of its own: faded counts of updates in good
    and in bad ticks of a decision (mean cost at most ``limit`` or above); the
    decision with the best share of good ones, by the posterior mean."""
    fields = "good double, bad double"

    def __init__(self, gamma: float, limit: float):
        super().__init__(gamma)
        self.limit = limit

    def merge(self, old, score_sum, n, idle):
        fine = score_sum >= -self.limit * n
        fade = self.gamma ** idle
        kept = {c: np.nan_to_num(x) * fade for c, x in old.items()}
        return {"good": kept["good"] + np.where(fine, n, 0.0), "bad": kept["bad"] + np.where(fine, 0.0, n)}

    def read(self, state, idle):
        return {c: x * self.gamma ** idle for c, x in state.items()}

    def decide(self, state, keys=None):
        share = (F.col("good") + 1) / (F.col("good") + F.col("bad") + 2)
        return (state.groupBy(*(keys or ["group_id"]))
                .agg(F.min_by("decision", F.struct(-F.round(share, 9), F.col("decision"))).alias("decision")))


def _beta_columns(state):
    best = BetaCounts(P.GAMMA, P.BETA_LIMIT).decide(state).withColumnRenamed("decision", "best")
    return state.join(best, "group_id").select("group_id", "decision", round4("good").alias("good"),
                                               round4("bad").alias("bad"), "best")


@query("state_policy")
def q_state_policy(spark, sf_dir):
    """A policy with its own state, merge and choice, over all ticks."""
    from qoeflow.functions import tick_of
    top = V.table(spark, sf_dir, "events").agg(F.max("ts").alias("m")).select(tick_of("m", P.TICK_S)).first()[0]
    return _beta_columns(BetaCounts(P.GAMMA, P.BETA_LIMIT).state(_stats(spark, sf_dir), top))


@query("state_policy_stream")
def q_state_policy_stream(spark, sf_dir):
    """The same policy in the state store, fed by closed event-time ticks."""
    from qoeflow.streaming.jobs import chained_state_job
    policy = BetaCounts(P.GAMMA, P.BETA_LIMIT)
    u = V.updates(spark, sf_dir).withColumn("arrival", F.unix_timestamp("ts"))
    rows = chained_state_job(spark, u, policy, P.TICK_S, 1, "arrival")
    newest = F.max_by(F.struct(*policy.names, "tick"), "tick")
    state = rows.groupBy("group_id", "decision").agg(newest.alias("x")).select("group_id", "decision", "x.*")
    return _beta_columns(policy.current(state, rows.agg(F.max("tick")).first()[0]))


def ucb_decisions(spark, sf_dir) -> DataFrame:
    """V.decisions: UCB slot lists at a few snapshot ticks before the last,
    in one pass: the snapshot ticks are exploded onto the tick rows and
    become an extra partition key (no per-snapshot rescans)."""
    T = _last_tick(spark, sf_dir)
    st = _stats(spark, sf_dir).withColumn(
        "snap", F.explode(F.array(*[(T - k).cast("bigint") for k in P.SNAPSHOT_BACK])))
    pol = ducb()
    state = S.discounted_state(st, pol.gamma, at_tick=F.col("snap"), keys=["snap", "group_id"])
    return pol.decide(state, keys=["snap", "group_id"]).withColumnRenamed("snap", "tick")


@query("latest_decision")
def q_latest_decision(spark, sf_dir):
    d = ucb_decisions(spark, sf_dir).withColumn("slots", F.array_join("slots", ":"))
    return latest_decision(d, "tick", ["slots"])


@query("format_decisions")
def q_format_decisions(spark, sf_dir):
    d = ucb_decisions(spark, sf_dir)
    msg = format_decision(d, P.ORIGIN)
    dec = decode_decision(msg)
    return dec.select("group_id", "tick", "message", "decoded_group",
                      F.size("decoded_slots").cast("bigint").alias("n_slots"))


# ----------------------------------------------------------- record plumbing
def _parsed(spark, sf_dir):
    good, _ = parse_updates(V.messages(spark, sf_dir), P.UPDATE_LABELS)
    return good


@query("parse_updates")
def q_parse_updates(spark, sf_dir):
    p = _parsed(spark, sf_dir)
    return p.select(F.get("fields", 0).try_cast("bigint").alias("event_id"), "group_id", "decision",
                    round4("score").alias("score"))


@query("project_labels")
def q_project_labels(spark, sf_dir):
    # The labels from their two-line configuration file
    path = scratch_path(spark, "labels")
    config = ["\t".join(P.UPDATE_LABELS), "\t".join(P.REDUCED_LABELS)]
    spark.createDataFrame([("\n".join(config),)], "value string").coalesce(1).write.text(path)
    labels, keep = read_label_config(spark, path)
    p = parse_messages(V.messages(spark, sf_dir))
    return p.select(F.col("seq").alias("event_id"), "group_id", project_labels(p, labels, keep).alias("update"))


def _routed(spark, sf_dir):
    return route(V.messages(spark, sf_dir), V.assign(spark, sf_dir), P.ME,
                 P.UPDATE_LABELS, P.REDUCED_LABELS)


@query("route_topics")
def q_route_topics(spark, sf_dir):
    r = _routed(spark, sf_dir)
    fwd, rej = forward(r, V.clusters(spark, sf_dir), P.ME)
    internal = r.where(F.col("topic") == "internal_groups").withColumn("address", F.lit(None).cast("string"))
    out = internal.unionByName(fwd.select(*internal.columns))
    return out.select(F.col("seq").alias("event_id"), "group_id", "cluster_id", "topic", "message", "address")


@query("auto_subscribe")
def q_auto_subscribe(spark, sf_dir):
    r = _routed(spark, sf_dir)
    return auto_subscribe(r.where(F.col("topic") == "external_groups"), P.ME)


@query("feature_histogram")
def q_feature_histogram(spark, sf_dir):
    p = parse_messages(V.messages(spark, sf_dir))
    h = feature_histogram(p, P.SAMPLE_FRACTION, P.MANAGED_LABELS, P.SEED, key="seq")
    return h.select(F.col("feature_idx").cast("bigint").alias("feature_idx"), "value", "n")


@query("heartbeats")
def q_heartbeats(spark, sf_dir):
    r = _routed(spark, sf_dir).withColumn("tick", F.floor(F.unix_timestamp("ts") / P.TICK_S).cast("bigint"))
    return heartbeats(r, "tick")


@query("subscriber_sets")
def q_subscriber_sets(spark, sf_dir):
    s = subscriber_sets(parse_subscriptions(V.subs(spark, sf_dir)))
    return s.select("group_id", F.array_join("clusters", ",").alias("clusters"),
                    F.size("clusters").cast("bigint").alias("n_clusters"))


@query("decision_fanout")
def q_decision_fanout(spark, sf_dir):
    d = ucb_decisions(spark, sf_dir)
    latest = format_decision(latest_decision(d, "tick", ["slots"]), P.ORIGIN)
    f = fan_out(latest, parse_subscriptions(V.subs(spark, sf_dir)), P.ME)
    return f.select("group_id", "cluster_id", "message")


# ------------------------------------------------------- grouping and serving
def _requests(spark, sf_dir):
    return split_request(V.requests(spark, sf_dir), V.N_REQUEST_FEATURES)


@query("request_candidates")
def q_request_candidates(spark, sf_dir):
    r = _requests(spark, sf_dir)
    return r.select("req_id",
                    F.get("features", V.ASN_INDEX).alias("asn"),
                    F.array_join(drop_managed(F.col("features"), P.MANAGED_LABELS), "\t").alias("head"),
                    F.array_join("candidates", ",").alias("candidates"),
                    F.size("candidates").cast("bigint").alias("n_candidates"),
                    available(F.lit("view"), F.col("candidates")).alias("has_view"))


def _leaves(spark, sf_dir):
    return flatten_rules(V.rules(spark, sf_dir))


@query("rule_flatten")
def q_rule_flatten(spark, sf_dir):
    lv = _leaves(spark, sf_dir)
    return lv.select(
        F.array_join(F.transform("path", lambda x: F.lpad(x.cast("string"), 3, "0")), ".").alias("path"),
        F.array_join(F.transform("conds", lambda c: F.concat(c["f"].cast("string"), F.lit("="), c["k"])),
                     ";").alias("conds"),
        F.size("conds").cast("bigint").alias("n_conds"), "group_id")


def _grouped_requests(spark, sf_dir, mode: str = "rules"):
    r = _requests(spark, sf_dir)
    asn = F.get("features", V.ASN_INDEX)
    if mode == "asn":
        return r.withColumn("group_id", asn).withColumn("matched", F.lit(False))
    return match_groups(r, _leaves(spark, sf_dir), asn)


@query("rule_match")
def q_rule_match(spark, sf_dir):
    return _grouped_requests(spark, sf_dir).select("req_id", "group_id", "matched")


def _latest_slots(spark, sf_dir):
    d = ucb_decisions(spark, sf_dir).withColumn(
        "slots", F.concat(F.array_join("slots", ":"), F.lit(":")))
    return latest_decision(d, "tick", ["slots"])


@query("assign_slots")
def q_assign_slots(spark, sf_dir):
    a = assign_slots(_grouped_requests(spark, sf_dir), _latest_slots(spark, sf_dir), P.SEED)
    return a.select("req_id", "group_id", "decision", "source")


@query("assign_epsilon")
def q_assign_epsilon(spark, sf_dir):
    a = assign_epsilon(_grouped_requests(spark, sf_dir, "asn"), eg_decisions(spark, sf_dir), P.SEED)
    return a.select("req_id", "group_id", "decision", "source")


def weights(spark, sf_dir) -> DataFrame:
    """D9 from the data: each decision's share of its group's updates."""
    st = _stats(spark, sf_dir).groupBy("group_id", "decision").agg(F.sum("n").alias("n"))
    tot = F.sum("n").over(Window.partitionBy("group_id"))
    pos = F.row_number().over(Window.partitionBy("group_id").orderBy("decision"))
    # percent rounded half-up with integer arithmetic (exact in every engine)
    pct = F.expr("(200 * n + tot) div (2 * tot)")
    return (st.withColumn("tot", tot)
            .select("group_id", "decision", pos.alias("pos"),
                    (pct.cast("decimal(5,0)") / 100).cast("decimal(5,2)").alias("p")))


@query("weight_lines")
def q_weight_lines(spark, sf_dir):
    """D9 with probabilities of many decimals: text and back without loss."""
    st = _stats(spark, sf_dir).groupBy("group_id", "decision").agg(F.sum("n").alias("n"))
    w = st.select("group_id", "decision", F.row_number().over(Window.partitionBy("group_id").orderBy("decision"))
                  .alias("pos"), (F.expr("1000000000 div (n + 7)").cast("decimal(15,0)") / 1000000000)
                  .cast("decimal(15,12)").alias("p"))
    back = parse_weights(format_weights(w))
    return back.select("group_id", F.col("pos").cast("bigint").alias("pos"), "decision",
                       (F.col("p") * 1000000000).cast("bigint").alias("p9"))


@query("assign_epsilon_null")
def q_assign_epsilon_null(spark, sf_dir):
    """P4, epsilon-greedy variant: a request no rule matches belongs to the
    group "null", which has decisions of its own (from all updates) beside the groups'."""
    eg = egreedy().decide(_window_sums(spark, sf_dir, F.explode(F.array(F.col("group_id"), F.lit("null")))))
    r = match_groups(_requests(spark, sf_dir), _leaves(spark, sf_dir), F.lit("null"))
    return assign_epsilon(r, eg, P.SEED).select("req_id", "group_id", "decision", "source")


@query("assign_weighted")
def q_assign_weighted(spark, sf_dir):
    # through the D9 text form: decision files as 'decision;probability' lines
    w = parse_weights(format_weights(weights(spark, sf_dir)))
    a = assign_weighted(_grouped_requests(spark, sf_dir, "asn"), w, P.SEED)
    return a.select("req_id", "group_id", "decision", "source")


# ------------------------------------------------------------ replay analytics
TRACE_FEATURES = ["ts_ms", "line_no", "group_id", "decision"]


def _trace_lines(spark, sf_dir):
    return trace_text(V.sessions(spark, sf_dir), TRACE_FEATURES)


@query("trace_parse")
def q_trace_parse(spark, sf_dir):
    t = read_traces(_trace_lines(spark, sf_dir))
    d = F.get("features", 3)
    thr = F.element_at("load_map", d)
    return t.select("line_no", "ts_s", d.alias("decision"),
                    F.size("decision_map").cast("bigint").alias("n_decisions"),
                    round4(F.element_at("decision_map", d)).alias("cost"),
                    F.size(thr).cast("bigint").alias("n_thresholds"),
                    F.array_max(F.transform(thr, lambda x: x["factor"])).alias("top_factor"))


@query("trace_files")
def q_trace_files(spark, sf_dir):
    """S3 from files: the trace written as text, read back with line numbers."""
    path = scratch_path(spark, "traces")
    _trace_lines(spark, sf_dir).select("value").write.text(path)
    t = read_trace_files(spark, path)
    d = F.get("features", 3)
    return t.select(F.get("features", 1).cast("bigint").alias("line_no"), "ts_s", d.alias("decision"),
                    F.size("decision_map").cast("bigint").alias("n_decisions"),
                    round4(F.element_at("decision_map", d)).alias("cost"),
                    F.size(F.element_at("load_map", d)).cast("bigint").alias("n_thresholds"),
                    F.array_max(F.transform(F.element_at("load_map", d), lambda x: x["factor"])).alias("top_factor"))


@query("trace_sort")
def q_trace_sort(spark, sf_dir):
    return sort_traces(_trace_lines(spark, sf_dir)).select("line_no", "sort_pos", "value")


def _buckets(spark, sf_dir):
    return with_buckets(V.sessions(spark, sf_dir), P.SECOND_S, P.MINUTE_S,
                        start=_trace_start(spark, sf_dir))


@query("requests_dense")
def q_requests_dense(spark, sf_dir):
    return requests_per_second(_buckets(spark, sf_dir))


@query("sessions_per_minute")
def q_sessions_per_minute(spark, sf_dir):
    return sessions_per_minute(_buckets(spark, sf_dir))


def _costed(b):
    return adjusted_cost(load_share(narrow(b)))


@query("load_share")
def q_load_share(spark, sf_dir):
    ls = load_share(_buckets(spark, sf_dir).select("minute", "ts_s", "line_no", "ok", "decision"))
    return ls.select("line_no", "minute", "decision", round4("load").alias("load"))


@query("load_adjusted_cost")
def q_load_adjusted_cost(spark, sf_dir):
    c = _costed(_buckets(spark, sf_dir))
    return c.select("line_no", "decision", round4("load").alias("load"), "factor",
                    round4("cost").alias("cost"))


@query("load_factor_table")
def q_load_factor_table(spark, sf_dir):
    """J8 with the thresholds as a table: the distinct entries of the sessions'
    load maps, looked up by an as-of join on the load."""
    b = _buckets(spark, sf_dir)
    costed = load_share(b.select("minute", "ts_s", "line_no", "ok", "decision",
                                 F.element_at("decision_map", F.col("decision")).alias("base")))
    table = (b.select(F.explode("load_map").alias("decision", "t")).select("decision", F.explode("t").alias("t"))
             .select("decision", "t.threshold", "t.factor").distinct())
    out = load_factor_table(costed, table, width=1 / 64)
    return out.select("line_no", "decision", round4("load").alias("load"), "factor",
                      round4(F.col("factor") * F.col("base")).alias("cost"))


@query("avg_cost_per_second")
def q_avg_cost_per_second(spark, sf_dir):
    b = _buckets(spark, sf_dir)
    costed = _costed(b)
    return cost_per_second(b, costed).select("second", "sent", "succeeded", "avg_cost")


@query("series_text")
def q_series_text(spark, sf_dir):
    """The requests-per-second series written as ordered text and read back."""
    path = scratch_path(spark, "series")
    write_series(requests_per_second(_buckets(spark, sf_dir)), "second", "sent", path)
    return read_lines(spark, path).select("line_no", F.col("value").cast("bigint").alias("sent"))


@query("round_robin")
def q_round_robin(spark, sf_dir):
    r = round_robin(V.sessions(spark, sf_dir), P.N_FRONTENDS)
    return r.select("line_no", F.col("url_idx").cast("bigint").alias("url_idx"), "mode", "chosen",
                    round4("cost").alias("cost"))


def _result_log(spark, sf_dir):
    return parse_result_log(V.result_log(spark, sf_dir))


@query("cost_by_mode")
def q_cost_by_mode(spark, sf_dir):
    """S5 + A18: the log as text files, read and summed by outcome."""
    path = scratch_path(spark, "result-log")
    V.result_log(spark, sf_dir).select("value").write.text(path)
    c = cost_by_mode(read_result_log(spark, path))
    return c.select(F.col("url_idx").cast("bigint").alias("url_idx"), "mode", "n", "avg_cost")


def _block_means(spark, sf_dir):
    return block_means(_result_log(spark, sf_dir), P.BLOCK)


@query("block_means")
def q_block_means(spark, sf_dir):
    m = _block_means(spark, sf_dir)
    return m.select(F.col("url_idx").cast("bigint").alias("url_idx"), "block",
                    round4("mean_cost").alias("mean_cost"))


@query("block_zip")
def q_block_zip(spark, sf_dir):
    z = block_zip(_block_means(spark, sf_dir))
    return z.select("block", round4("mean_a").alias("mean_a"), round4("mean_b").alias("mean_b"))


@query("block_gap")
def q_block_gap(spark, sf_dir):
    return block_gap(_block_means(spark, sf_dir))


def _three_way(spark, sf_dir):
    """The log as three frontends would have written it: frontend 0 against
    all others."""
    log = _result_log(spark, sf_dir).withColumn("url_idx", F.pmod("line_no", F.lit(3)).cast("int"))
    return block_means(two_series(log), P.BLOCK)


@query("block_zip_three")
def q_block_zip_three(spark, sf_dir):
    z = block_zip(_three_way(spark, sf_dir))
    return z.select("block", round4("mean_a").alias("mean_a"), round4("mean_b").alias("mean_b"))


@query("block_gap_three")
def q_block_gap_three(spark, sf_dir):
    return block_gap(_three_way(spark, sf_dir))


@query("group_assignment_latest")
def q_group_assignment_latest(spark, sf_dir):
    return group_assignment(V.assign_feed(spark, sf_dir), P.ME)


@query("feed_rules_match")
def q_feed_rules_match(spark, sf_dir):
    """Rules taken from the mixed feed (not the direct view), then matched."""
    leaves = flatten_rules(latest_rules(V.assign_feed(spark, sf_dir)))
    r = _requests(spark, sf_dir)
    return match_groups(r, leaves, F.get("features", V.ASN_INDEX)).select("req_id", "group_id", "matched")


# ------------------------------------------------------------------ streaming
@query("stream_state")
def q_stream_state(spark, sf_dir):
    """T1 streamed from files, read at the last tick (lazy decay); must
    equal the batch closed form (discounted_state)."""
    st = decision_state_job(spark, V.updates(spark, sf_dir), P.GAMMA)
    d = decay_to(st, P.GAMMA, st.select(F.max("group_tick")).scalar())
    return d.select("group_id", "decision", round4("score_sum").alias("score_sum"),
                    round4("n").alias("n"), round4(S.mean_col()).alias("mean"), "last_tick")


@query("ingest_routing")
def q_ingest_routing(spark, sf_dir):
    t = ingest_job(spark, V.messages(spark, sf_dir), V.assign(spark, sf_dir), P.ME,
                   P.UPDATE_LABELS, P.REDUCED_LABELS)
    return t.select("topic", "group_id", "cluster_id", "update")


@query("topic_roundtrip")
def q_topic_roundtrip(spark, sf_dir):
    t = topic_roundtrip_job(spark, V.messages(spark, sf_dir), V.assign(spark, sf_dir), P.ME)
    good, _ = parse_updates(t, P.UPDATE_LABELS)
    return good.select(F.get("fields", 0).try_cast("bigint").alias("event_id"), "topic", "group_id",
                       "decision", round4("score").alias("score"))


@query("multi_sink_counts")
def q_multi_sink_counts(spark, sf_dir):
    return multi_sink_job(spark, V.messages(spark, sf_dir), V.assign(spark, sf_dir), P.ME,
                          P.UPDATE_LABELS, P.REDUCED_LABELS, P.SAMPLE_FRACTION, P.SEED,
                          managed=P.MANAGED_LABELS)


@query("late_rows")
def q_late_rows(spark, sf_dir):
    """The decision stream with its updates out of order (slices by an md5
    draw): a late update counts in its group's current tick, none is lost."""
    u = V.updates(spark, sf_dir).withColumn("draw", hash_u32(F.lit("late"), F.col("event_id")))
    st = decision_state_job(spark, u, P.GAMMA, P.LATE_SLICES, order="draw")
    late = F.max("late").over(Window.partitionBy("group_id"))
    d = decay_to(st.withColumn("late", late), P.GAMMA, st.select(F.max("group_tick")).scalar())
    return d.select("group_id", "decision", round4("score_sum").alias("score_sum"), round4("n").alias("n"),
                    "last_tick", "late")


@query("stream_rejects")
def q_stream_rejects(spark, sf_dir):
    """Messages that cannot be read go to the rejects of every stream,
    and to no topic: rows per job and sink over a spool with broken messages."""
    m = V.broken_messages(spark, sf_dir)
    args = (V.assign(spark, sf_dir), P.ME, P.UPDATE_LABELS, P.REDUCED_LABELS)
    ingest = (ingest_job(spark, m, *args).groupBy(F.col("topic").alias("sink")).agg(F.count(F.lit(1)).alias("n"))
              .withColumn("job", F.lit("ingest")))
    multi = (multi_sink_job(spark, m, *args, P.SAMPLE_FRACTION, P.SEED, managed=P.MANAGED_LABELS)
             .where("sink <> 'sample'").withColumn("job", F.lit("multi_sink")))
    return ingest.unionByName(multi).select("job", "sink", "n")


@query("policy_replay")
def q_policy_replay(spark, sf_dir):
    """M2: replay the logged sessions under per-tick DUCB decisions (made
    from the updates up to the tick before), load-adjusted cost per second."""
    b = _buckets(spark, sf_dir).withColumn("tick", F.floor(F.col("ts_s") / P.TICK_S).cast("bigint"))
    return _replayed_cost(spark, b, _stats(spark, sf_dir), ducb())


def _replayed_cost(spark, b, stats, policy):
    # served sessions feed two branches (all sessions, successful ones):
    # written once, without the maps but for the assigned decision's entries
    served = replay_policy(b, stats, policy, P.SEED)
    served = write_once(narrow(served, "assigned", "source"), "served")
    costed = adjusted_cost(load_share(served, decision="assigned"), decision="assigned")
    c = cost_per_second(served, costed, [F.count_if(F.col("source") == "policy").alias("n_policy")])
    return c.select("second", "sent", "succeeded", F.coalesce("n_policy", F.lit(0)).cast("bigint").alias("n_policy"),
                    "avg_cost")


@query("policy_replay_eg")
def q_policy_replay_eg(spark, sf_dir):
    """The replay under per-tick epsilon-greedy decisions."""
    b = _buckets(spark, sf_dir).withColumn("tick", F.floor(F.col("ts_s") / P.TICK_S).cast("bigint"))
    served = replay_policy(b, _stats(spark, sf_dir), egreedy(), P.SEED)
    return served.select("line_no", "group_id", "tick", "assigned", "source")


@query("policy_replay_custom")
def q_policy_replay_custom(spark, sf_dir):
    """The replay under a user policy."""
    b = V.sessions(spark, sf_dir).withColumn("tick", F.floor(F.col("ts_s") / P.TICK_S).cast("bigint"))
    served = replay_policy(b, _stats(spark, sf_dir), GreedyMean(P.GAMMA), P.SEED)
    return served.select("line_no", "group_id", "tick", "assigned", "source")


@query("replay_assignments")
def q_replay_assignments(spark, sf_dir):
    """M2 detail: the decision each logged session gets under the policy."""
    b = V.sessions(spark, sf_dir).withColumn("tick", F.floor(F.col("ts_s") / P.TICK_S).cast("bigint"))
    served = replay_policy(b, _stats(spark, sf_dir), ducb(), P.SEED)
    return served.select("line_no", "group_id", "tick", "assigned", "source")


@query("exchange_fanout_stream")
def q_exchange_fanout_stream(spark, sf_dir):
    """M5/J3/T5 streamed: subscriptions into a table, every decision
    (all snapshots) fanned out to its group's subscribers but us."""
    dec = format_decision(ucb_decisions(spark, sf_dir), P.ORIGIN).select("group_id", "tick", "message")
    out = exchange_job(spark, V.subs(spark, sf_dir), dec, P.ME)
    return out.select("group_id", "cluster_id", "tick", "message")


@query("group_table_stream")
def q_group_table_stream(spark, sf_dir):
    """T6/A15 streamed: the feed folded into a versioned assignment table."""
    t = group_table_job(spark, V.assign_feed(spark, sf_dir), P.ME)
    return t.select("group_id", "cluster_id")


@query("latest_decision_stream")
def q_latest_decision_stream(spark, sf_dir):
    """S7 streamed: decisions merged into the latest-decision table."""
    d = ucb_decisions(spark, sf_dir).withColumn("slots", F.array_join("slots", ":"))
    return latest_decision_job(spark, d).select("group_id", "slots", "tick")


@query("newest_update_stream")
def q_newest_update_stream(spark, sf_dir):
    """The newest update of every group over 21 micro-batches, in a
    table to which each batch adds its rows only."""
    t = newest_update_job(spark, V.updates(spark, sf_dir))
    return t.select("group_id", "event_id", "decision", round4("cost").alias("cost"), "tick")


@query("sliding_stream")
def q_sliding_stream(spark, sf_dir):
    """T3 streamed: the tick ring per group, read at the last tick, then
    the epsilon-greedy choice; equals best_decision."""
    ring = window_ring_job(spark, V.updates(spark, sf_dir), P.EG_WINDOW_TICKS)
    T = ring.select(F.max("tick")).scalar()
    st = (ring.where(F.col("tick") > T - P.EG_WINDOW_TICKS)
          .groupBy("group_id", "decision").agg(F.sum("score_sum").alias("score_sum"), F.sum("n").alias("n")))
    d = egreedy().decide(st)
    return d.select("group_id", "best", F.array_join("rest", ",").alias("rest"), "epsilon")


@query("decision_loop_stream")
def q_decision_loop_stream(spark, sf_dir):
    """The reference's decision loop: each micro-batch is a tick; state
    merged per batch, every group's slot list written per batch."""
    from qoeflow.streaming.loop import decision_loop_job
    d = decision_loop_job(spark, V.messages(spark, sf_dir), P.UPDATE_LABELS, ducb(), P.ORIGIN)
    return d.select("group_id", F.array_join("slots", ":").alias("slots"), "message", "tick")


@query("decision_loop_eg_stream")
def q_decision_loop_eg_stream(spark, sf_dir):
    """U3 in the loop: epsilon-greedy over the last ticks' window, D8 messages."""
    from qoeflow.streaming.loop import decision_loop_job
    d = decision_loop_job(spark, V.messages(spark, sf_dir), P.UPDATE_LABELS, egreedy(), P.ORIGIN)
    return d.select("group_id", "best", F.array_join("rest", ",").alias("rest"), "message", "tick")


@query("decision_loop_custom_stream")
def q_decision_loop_custom_stream(spark, sf_dir):
    """U1 in the loop: a user policy, same state as the discounted one."""
    from qoeflow.streaming.loop import decision_loop_job
    d = decision_loop_job(spark, V.messages(spark, sf_dir), P.UPDATE_LABELS, GreedyMean(P.GAMMA), P.ORIGIN)
    return d.select("group_id", "decision", "message", "tick")


@query("exchange_forward_stream")
def q_exchange_forward_stream(spark, sf_dir):
    """Updates of other clusters' groups forwarded and their groups
    subscribed to, in the same batches; rows per kind, group and cluster."""
    base = forward_job(spark, V.messages(spark, sf_dir), V.assign(spark, sf_dir), V.clusters(spark, sf_dir), P.ME,
                       P.UPDATE_LABELS, P.REDUCED_LABELS)
    sent = (spark.read.parquet(f"{base}/forwarded").groupBy("group_id", "cluster_id", "address")
            .agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("forwarded")))
    subs = (spark.read.parquet(f"{base}/subscriptions").groupBy("group_id", "cluster_id", "message")
            .agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("message", "address")
            .withColumn("kind", F.lit("subscribed")))
    return sent.unionByName(subs).select("kind", "group_id", "cluster_id", "address", "n")


@query("epsilon_lines_stream")
def q_epsilon_lines_stream(spark, sf_dir):
    """S8 streamed: each batch of new epsilon-greedy decisions as ordered lines."""
    msgs = EpsilonGreedy(P.EPSILON, P.EG_WINDOW_TICKS).message(eg_decisions(spark, sf_dir), P.ORIGIN)
    msgs = msgs.select(hash_u32(F.lit("eg"), F.col("group_id")).alias("seq"), "message")
    lines = epsilon_lines_job(spark, msgs)
    return lines.select("group_id", F.col("pos").cast("bigint").alias("pos"), "line")


@query("stream_state_lazy")
def q_stream_state_lazy(spark, sf_dir):
    """T1 on transformWithStateInPandas with per-decision map state and
    lazy idle decay; read at the last tick it equals the closed form."""
    from qoeflow.streaming.jobs import decision_state_lazy_job
    from qoeflow.streaming.keyed_state import read_state
    rows = decision_state_lazy_job(spark, V.updates(spark, sf_dir), P.GAMMA)
    st = read_state(rows, P.GAMMA, rows.select(F.max("group_tick")).scalar())
    return st.select("group_id", "decision", round4("score_sum").alias("score_sum"),
                     round4("n").alias("n"), round4(S.mean_col()).alias("mean"), "last_tick")


def _state_columns(st):
    return st.select("group_id", "decision", round4("score_sum").alias("score_sum"),
                     round4("n").alias("n"), round4(S.mean_col()).alias("mean"), "last_tick")


@query("stream_state_chained")
def q_stream_state_chained(spark, sf_dir):
    """T2 -> T1: event-time ticks closed by the watermark feed the state; the
    updates arrive up to three ticks out of order, the result is the closed form."""
    from qoeflow.streaming.jobs import chained_state_job
    from qoeflow.streaming.keyed_state import read_state
    delay = F.pmod(hash_u32(F.lit("arrive"), F.col("event_id")), F.lit(3 * P.TICK_S))
    u = V.updates(spark, sf_dir).withColumn("arrival", F.unix_timestamp("ts") + delay)
    rows = chained_state_job(spark, u, P.GAMMA, P.TICK_S, 4, "arrival")
    return _state_columns(read_state(rows, P.GAMMA, rows.select(F.max("group_tick")).scalar()))


@query("stream_state_bootstrap")
def q_stream_state_bootstrap(spark, sf_dir):
    """The first half of the ticks as a batch, the second streamed from
    its state, all groups read from the state store; equals the closed form."""
    from qoeflow.functions import tick_of
    from qoeflow.streaming.jobs import bootstrapped_state_job
    ts = V.table(spark, sf_dir, "events").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    lo, hi = ts.select(tick_of("lo", P.TICK_S), tick_of("hi", P.TICK_S)).first()
    return _state_columns(bootstrapped_state_job(spark, V.updates(spark, sf_dir), P.GAMMA, (lo + hi) // 2, hi))


@query("assign_stream")
def q_assign_stream(spark, sf_dir):
    """M1 online: requests as a stream, served per micro-batch against the
    newest decision table; equals the batch assignment."""
    from qoeflow.streaming.exchange import serve_job
    out = serve_job(spark, V.requests(spark, sf_dir), _latest_slots(spark, sf_dir), _leaves(spark, sf_dir),
                    V.ASN_INDEX, V.N_REQUEST_FEATURES, P.SEED)
    return out.select("req_id", "group_id", "decision", "source")


def _timed_decisions(spark, sf_dir):
    """Slot decisions of the snapshot ticks, valid from the end of their tick."""
    d = ucb_decisions(spark, sf_dir)
    return d.select("group_id", "tick", F.concat(F.array_join("slots", ":"), F.lit(":")).alias("slots"),
                    ((F.col("tick") + 1) * P.TICK_S).alias("from_s"))


def _timed_requests(spark, sf_dir):
    """The grouped requests, spread over the time before and between the snapshots."""
    span = P.REQUEST_TICKS * P.TICK_S
    start = (_last_tick(spark, sf_dir) - P.REQUEST_BACK) * P.TICK_S
    return _grouped_requests(spark, sf_dir, "asn").withColumn(
        "at", start + F.pmod(F.col("req_id") * F.lit(7919 * 37), F.lit(span)))


@query("assign_asof_stream")
def q_assign_asof_stream(spark, sf_dir):
    """M1/J6 online: requests between decisions that change, each served by the
    decision valid at its own time, though requests come up to three ticks late."""
    from qoeflow.streaming.serving import decision_events, request_events, serve_asof_job
    dec = write_once(_timed_decisions(spark, sf_dir), "timed-decisions")
    events = (decision_events(dec, "tick", "slots", F.col("from_s"))
              .withColumn("arrival", F.unix_timestamp("valid_from")))
    late = F.pmod(hash_u32(F.lit("delay"), F.col("req_id")), F.lit(3 * P.TICK_S))
    req = request_events(_timed_requests(spark, sf_dir), F.col("at"), F.array_join("candidates", "\t"))
    out = serve_asof_job(spark, events, req.withColumn("arrival", F.col("at") + late), P.TICK_S,
                         n_files=4, salts=4)
    served = draw_slots(out.withColumn("candidates", F.split("body", "\t")).withColumnRenamed("payload", "slots"), P.SEED)
    return served.select("req_id", "group_id", F.coalesce("version", F.lit(-1)).cast("bigint").alias("tick"), "decision",
                         "source")


@query("expiring_fanout_stream")
def q_expiring_fanout_stream(spark, sf_dir):
    """Decisions to the clusters whose subscription is still alive at the
    decision's time; messages come up to a tick out of order."""
    from qoeflow.streaming.subscriptions import expiring_fanout_job
    span = P.REQUEST_TICKS * P.TICK_S
    start = (_last_tick(spark, sf_dir) - P.REQUEST_BACK) * P.TICK_S
    subs = V.subs(spark, sf_dir).withColumn("at", start + F.pmod(F.col("seq") * F.lit(7919 * 37), F.lit(span)))
    delay = F.pmod(hash_u32(F.lit("sub"), F.col("seq")), F.lit(P.TICK_S))
    subs = parse_subscriptions(subs.withColumn("arrival", F.col("at") + delay), keep=["at", "arrival"])
    dec = write_once(_timed_decisions(spark, sf_dir), "timed-decisions")
    dec = dec.select("group_id", F.col("from_s").alias("at"), F.col("slots").alias("message"), F.col("from_s").alias("arrival"))
    return expiring_fanout_job(spark, subs, dec, P.ME, P.SUB_TTL_S, P.TICK_S)


@query("run_metrics")
def q_run_metrics(spark, sf_dir):
    """The run's own counts: rows read, rows by sink, rows that the
    watermark dropped; all that was read is accounted for."""
    from qoeflow.streaming.metrics import deduplicated_job
    m = V.messages(spark, sf_dir).withColumn("at", F.unix_timestamp("ts"))
    m = m.withColumn("arrival", F.col("at") + F.pmod(hash_u32(F.lit("metric"), F.col("seq")), F.lit(8 * P.TICK_S)))
    ours = F.get_json_object("value", "$.group_id").cast("int") < 25
    t = deduplicated_job(spark, m, P.METRIC_LATENESS_S, {"assigned": ours, "other": ~ours}, "qoe_run_metrics", "arrival")
    n = F.sum("n").alias("n")
    read = t.where("measure = 'in'").agg(n).select(F.lit("read").alias("measure"), "n")
    met = t.where("measure in ('assigned', 'other', 'dropped')").agg(n).select(F.lit("accounted").alias("measure"), "n")
    lost = t.where("measure = 'dropped'").agg((F.sum("n") > 0).cast("bigint").alias("n"))
    return read.unionByName(met).unionByName(lost.select(F.lit("some_dropped").alias("measure"), "n"))


@query("ingest_decide_stream")
def q_ingest_decide_stream(spark, sf_dir):
    """M4 -> T1: spool -> topic routing -> decision loop on this cluster's
    topic -> newest slot list per owned group."""
    from qoeflow.streaming.loop import ingest_then_decide_job
    d = ingest_then_decide_job(spark, V.messages(spark, sf_dir), V.assign(spark, sf_dir), P.ME,
                               P.UPDATE_LABELS, P.REDUCED_LABELS, ducb(), P.ORIGIN)
    return d.select("group_id", F.array_join("slots", ":").alias("slots"), "message")


@query("stream_slots")
def q_stream_slots(spark, sf_dir):
    """Snapshot of every group at the last tick from the streamed state
    (idle groups decayed on read), then the slot decisions; equals ucb_slots."""
    st = decision_state_job(spark, V.updates(spark, sf_dir), P.GAMMA)
    snap = decay_to(st, P.GAMMA, st.select(F.max("group_tick")).scalar())
    dec = ducb().decide(snap.select("group_id", "decision", "score_sum", "n"))
    return dec.select("group_id", F.array_join("slots", ":").alias("slots"))


@query("stream_state_timed")
def q_stream_state_timed(spark, sf_dir):
    """T1 + T8 with event-time timers: idle groups are re-emitted, decayed, as
    the watermark advances; read at the last tick it equals the closed form."""
    from qoeflow.streaming.jobs import decision_state_lazy_job
    from qoeflow.streaming.keyed_state import read_state
    rows = decision_state_lazy_job(spark, V.updates(spark, sf_dir), P.GAMMA, timed_tick_s=P.TICK_S)
    st = read_state(rows, P.GAMMA, rows.select(F.max("group_tick")).scalar())
    return st.select("group_id", "decision", round4("score_sum").alias("score_sum"),
                     round4("n").alias("n"), round4(S.mean_col()).alias("mean"), "last_tick")
