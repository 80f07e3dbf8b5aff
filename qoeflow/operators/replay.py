"""M2: offline replay analytics over logged sessions.

The reference replays a trace in real time against a web server and
counts, per second, requests sent / succeeded and cost; per minute, the
load each decision carries, which scales its cost through a threshold
table.  Here the same quantities are computed as DataFrame jobs over
the whole trace: buckets relative to the trace start (a scalar
subquery, not an unpartitioned window), dense zero-filled grids
generated in parallel, and the running load share through the skew-safe
ordinal of ``ordinals``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qoeflow.functions import exact_mean4, scaled_units
from qoeflow.operators.asof import asof_join
from qoeflow.operators.ordinals import ordinal_within
from qoeflow.operators.stats import BLOCK_TICKS, active_ranks, group_ranks
from qoeflow.session import write_once


def with_buckets(sessions: DataFrame, second_s: int = 1, minute_s: int = 60,
                 ts_s: str = "ts_s", start: Column | None = None) -> DataFrame:
    """P10: 'second' and 'minute' since the trace start (a scalar subquery
    unless ``start`` is given)."""
    if start is None:
        start = sessions.select(F.min(ts_s)).scalar()
    rel = F.col(ts_s) - start
    return (sessions.withColumn("second", F.floor(rel / second_s).cast("bigint"))
                    .withColumn("minute", F.floor(rel / minute_s).cast("bigint")))


def dense_grid(bounds: DataFrame, lo: str, hi: str, name: str, block: int = 4096) -> DataFrame:
    """Every integer in [lo, hi] of a one-row frame, generated in parallel:
    coarse blocks first, repartitioned, then the values of each block."""
    b = bounds.select(F.col(lo).alias("_lo"), F.col(hi).alias("_hi"))
    coarse = b.select("_lo", "_hi", F.explode(F.sequence(F.floor(F.col("_lo") / block).cast("bigint"),
                                                          F.floor(F.col("_hi") / block).cast("bigint")))
                      .alias("_blk"))
    coarse = coarse.repartition("_blk")
    return coarse.select(F.explode(F.sequence(
        F.greatest(F.col("_blk") * block, F.col("_lo")),
        F.least(F.col("_blk") * block + block - 1, F.col("_hi")))).alias(name))


def requests_per_second(b: DataFrame, ok: str = "ok") -> DataFrame:
    """Sent and succeeded per second, dense and zero-filled."""
    counts = b.groupBy("second").agg(F.count(F.lit(1)).alias("sent"),
                                     F.count_if(F.col(ok)).alias("succeeded"))
    grid = dense_grid(b.agg(F.min("second").alias("lo"), F.max("second").alias("hi")), "lo", "hi", "second")
    return (grid.join(counts, "second", "left")
                .select("second", F.coalesce("sent", F.lit(0)).cast("bigint").alias("sent"),
                        F.coalesce("succeeded", F.lit(0)).cast("bigint").alias("succeeded")))


def sessions_per_minute(b: DataFrame) -> DataFrame:
    """All sessions per minute (the load denominator)."""
    return b.groupBy("minute").agg(F.count(F.lit(1)).alias("n_sessions"))


def narrow(b: DataFrame, decision: str = "decision", *more: str) -> DataFrame:
    """What costing a session needs: its buckets and order, and of the two maps
    the entries of ``decision`` only (numbering rows writes them once)."""
    d = F.array(F.col(decision))
    one = lambda m: F.when(F.col(decision).isNotNull(), F.map_from_arrays(
        d, F.array(F.element_at(m, F.col(decision))))).alias(m)
    cols = [c for c in ("second", "minute", "ts_s", "line_no", "ok") if c in b.columns]
    return b.select(*cols, decision, *more, one("decision_map"), one("load_map"))


def load_share(b: DataFrame, decision: str = "decision", ok: str = "ok",
               order: list[str] | None = None) -> DataFrame:
    """At each successful request, that decision's count so far in
    the minute divided by the minute's full session count."""
    order = order or ["ts_s", "line_no"]
    succ = b.where(F.col(ok))
    run = ordinal_within(succ, ["minute", decision], order, "_run")
    tot = sessions_per_minute(b)
    return (run.join(tot, "minute", "inner")
               .withColumn("load", F.col("_run") / F.col("n_sessions")).drop("_run"))


def load_factor(load: Column, thresholds: Column) -> Column:
    """Factor of the highest threshold strictly below the load, else 1."""
    below = F.filter(thresholds, lambda t: t["threshold"] < load)
    return F.when(F.size(below) > 0, F.array_max(below)["factor"]).otherwise(F.lit(1.0))


def load_factor_table(df: DataFrame, thresholds: DataFrame, decision: str = "decision", load: str = "load",
                      width: float | None = None) -> DataFrame:
    """J8, table form: ``df`` with ``factor``, that of the decision's highest
    threshold strictly below the load in ``thresholds`` (decision, threshold,
    factor), else 1; a strict as-of join on the load."""
    t = thresholds.select(F.col("decision").alias(decision), "threshold", "factor")
    j = asof_join(df, t, [decision], load, "threshold", ["factor"], "_hit", strict=True, width=width)
    return j.withColumn("factor", F.coalesce(F.col("_hit.factor"), F.lit(1.0))).drop("_hit")


def adjusted_cost(df: DataFrame, decision: str = "decision", use_load: bool = True) -> DataFrame:
    """J7 + J8: cost of the chosen decision in the session's own map times
    the load factor.  ``use_load=False`` gives factor 1, which is what the
    reference's string-vs-float comparison produced in practice."""
    base = F.element_at("decision_map", F.col(decision))
    fac = load_factor(F.col("load"), F.element_at("load_map", F.col(decision))) if use_load else F.lit(1.0)
    return df.withColumn("factor", fac).withColumn("cost", F.col("factor") * base)


def cost_per_second(b: DataFrame, costed: DataFrame, extra: list[Column] | None = None) -> DataFrame:
    """Cost sum / succeeded per second on the dense grid (null when a
    second had no success).  Costs count in units of 10^-4, so the mean is
    exact to four places; ``extra`` aggregates of ``costed`` come along."""
    per = costed.groupBy("second").agg(F.sum(scaled_units("cost", 4)).alias("_u"), *(extra or []))
    rps = requests_per_second(b)
    return (rps.join(per, "second", "left").withColumn("_u", F.coalesce("_u", F.lit(0)))
               .withColumn("avg_cost", exact_mean4("_u", "succeeded", 4)).drop("_u"))


# ------------------------------------------------------------ policy replay
FOLD_OUT = "array<struct<i:bigint,t:bigint,e:bigint,a:bigint,s:double,c:double>>"


def _fold_expr(gamma: float, all_states: bool) -> Column:
    """Fold S_i = s_i + gamma^(E_i - E_(i-1)) * S_(i-1) over the sorted array
    ``h`` of (i, t, e, a, s, c), starting from the carry (_pe, _ps, _pc): every
    state, or the last (e, s, c) only."""
    g = repr(float(gamma))
    f = f"coalesce(pow({g}, x.e - acc.e), 0D)"
    start = "'e', _pe, 's', coalesce(_ps, 0D), 'c', coalesce(_pc, 0D)"
    if not all_states:
        return F.expr(f"aggregate(h, named_struct({start}), (acc, x) -> named_struct('e', CAST(x.e AS BIGINT), "
                      f"'s', x.s + {f} * acc.s, 'c', x.c + {f} * acc.c))")
    return F.expr(f"""
      aggregate(h, named_struct({start}, 'out', CAST(array() AS {FOLD_OUT})),
        (acc, x) -> aggregate(array(named_struct('s', x.s + {f} * acc.s, 'c', x.c + {f} * acc.c)),
          acc, (acc, v) -> named_struct(
            'e', CAST(x.e AS BIGINT), 's', v.s, 'c', v.c,
            'out', concat(acc.out, array(named_struct('i', CAST(x.i AS BIGINT), 't', CAST(x.t AS BIGINT),
                                                      'e', CAST(x.e AS BIGINT), 'a', CAST(x.a AS BIGINT),
                                                      's', v.s, 'c', v.c))))),
        acc -> acc.out)""")


def _prefix_states(rows: DataFrame, gamma: float, chunk: int, longest: int) -> DataFrame:
    """State after every row of each (group, decision): rows (i = 1, 2, ...,
    t, e, a, s, c) are cut into arrays of at most ``chunk``; the arrays' ends
    are themselves folded this way, level by level, into the carry that each
    array starts from."""
    key = ["group_id", "decision", "_k"]
    chunks = (rows.withColumn("_k", F.floor((F.col("i") - 1) / chunk).cast("bigint")).groupBy(*key)
              .agg(F.array_sort(F.collect_list(F.struct("i", "t", "e", "a", "s", "c"))).alias("h")))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("_pe", "bigint"), ("_ps", "double"), ("_pc", "double"))]
    if longest <= chunk:
        chunks = chunks.select("*", *none)
    else:
        ends = chunks.select("*", *none).select(
            "group_id", "decision", (F.col("_k") + 1).alias("i"), F.lit(0).cast("bigint").alias("t"),
            F.lit(0).cast("bigint").alias("a"), _fold_expr(gamma, False).alias("x"))
        ends = ends.select("group_id", "decision", "i", "t", "x.e", "a", "x.s", "x.c")
        carry = _prefix_states(ends, gamma, chunk, -(-longest // chunk))
        # the state after chunk k - 1 (i = k) starts chunk k
        carry = carry.select("group_id", "decision", F.col("i").alias("_k"), F.col("e").alias("_pe"),
                             F.col("s").alias("_ps"), F.col("c").alias("_pc"))
        chunks = chunks.join(carry, key, "left")
    return (chunks.select("group_id", "decision", F.explode(_fold_expr(gamma, True)).alias("x"))
            .select("group_id", "decision", "x.*"))


def state_history(stats: DataFrame, gamma: float, tick: str = "tick", chunk: int = 128) -> DataFrame:
    """A5 at every active tick of each (group, decision).

    Between consecutive active ticks b' < b of a decision the state is
    multiplied by gamma^(E(b) - E(b')), E = A + tick - G (see
    ``stats.discounted_state``), then the tick's own sums are added.  The
    recurrence is folded exactly with ``aggregate``, in as many levels as the
    longest history needs (see ``_prefix_states``), so no array has more than
    ``chunk`` entries.  ``stats`` is read several times: pass a written table.
    """
    longest = (stats.groupBy("group_id", "decision").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]) or 0
    rows = active_ranks(stats, tick).select(
        "group_id", "decision", F.col("_A").cast("bigint").alias("i"), F.col(tick).cast("bigint").alias("t"),
        (F.col("_A") + F.col(tick) - F.col("_G")).cast("bigint").alias("e"), F.col("_A").cast("bigint").alias("a"),
        F.col("score_sum").cast("double").alias("s"), F.col("n").cast("double").alias("c"))
    return _prefix_states(rows, gamma, max(chunk, 2), longest).select(
        "group_id", "decision", F.col("t").alias(tick), "e", "a", F.col("s").alias("score_sum"), F.col("c").alias("n"))


def state_asof(history: DataFrame, stats: DataFrame, asks: DataFrame, gamma: float,
               tick: str = "tick") -> DataFrame:
    """State of every known decision of a group at tick T for each asked
    (group_id, at): an as-of join of the asks with each decision's last active
    tick <= T, then the lazy decay gamma^(E(T) - E(b)) with
    E(T) = A(b) + T - G(T); G(T), the group's active ticks up to T, is a second
    as-of join."""
    decs = stats.select("group_id", "decision").distinct()   # cheap: not the fold
    last = asof_join(asks.join(decs, "group_id").select("group_id", "decision", "at"), history, ["group_id", "decision"],
                     "at", tick, ["e", "a", "score_sum", "n"], "_last", width=BLOCK_TICKS).where("_last is not null")
    ranks = group_ranks(stats, tick)
    active = asof_join(asks, ranks, ["group_id"], "at", tick, ["_G"], "_active", width=BLOCK_TICKS)
    j = last.join(active.select("group_id", "at", F.col("_active._G").alias("_G")), ["group_id", "at"])
    x = F.col("_last.a") + F.col("at") - F.col("_G") - F.col("_last.e")
    f = F.pow(F.lit(gamma), x)
    return j.select("group_id", "at", "decision", (F.col("_last.score_sum") * f).alias("score_sum"),
                    (F.col("_last.n") * f).alias("n"))


def replay_policy(sessions: DataFrame, stats: DataFrame, policy, seed: str,
                  tick: str = "tick") -> DataFrame:
    """M2: each logged session is served the decision the policy had made
    from the data up to the tick before (feedback at tick grain): the
    group's decision at T = tick - 1, the policy's reproducible pick, the
    availability check against the session's decision map and the
    fallback draw.  Returns the sessions with ``assigned`` and ``source``."""
    from qoeflow.functions import hash_u32, pick
    stats = write_once(stats, "tick-stats")       # small against the updates, read several times
    asks = sessions.select("group_id", (F.col(tick) - 1).alias("at")).distinct()
    dec = policy.decide(policy.state_at(stats, asks, tick), keys=["group_id", "at"])
    dec = dec.select("group_id", "at", F.struct(*[c for c in dec.columns if c not in ("group_id", "at")]).alias("_dec"))
    s = sessions.withColumn("at", F.col(tick) - 1).join(dec, ["group_id", "at"], "left")
    cands = F.array_sort(F.map_keys("decision_map"))
    s = s.withColumn("_pick", policy.pick(F.col("_dec"), seed, "line_no"))
    ok = F.col("_pick").isNotNull() & F.coalesce(F.array_contains(cands, F.col("_pick")), F.lit(False))
    fb = pick(cands, hash_u32(F.lit(seed), F.lit("fallback"), F.col("line_no")))
    return (s.withColumn("assigned", F.when(ok, F.col("_pick")).otherwise(fb))
             .withColumn("source", F.when(ok, F.lit("policy")).otherwise(F.lit("fallback")))
             .drop("_dec", "at", "_pick"))
