"""Per-group decision statistics: tick aggregates, means, discounted state.

Scale notes.  Everything after ``tick_stats`` works on rows pre-aggregated
to (group, decision, tick): their count is bounded by the number of ticks
times the decision catalogue per group, not by the raw rows, so a group
holding a third of all updates is still a small partition for the window
functions below.  ``tick_stats`` itself is a partial + final hash
aggregate (map-side combine), so a hot group is combined before the
shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

G, D = "group_id", "decision"


def tick_stats(updates: DataFrame, tick: str = "tick") -> DataFrame:
    """A2: score sum and count per (group, decision, tick); score = -cost."""
    return (updates.groupBy(G, D, tick)
            .agg(F.sum(-F.col("cost")).alias("score_sum"),
                 F.count(F.lit(1)).alias("n")))


def score_lists(updates: DataFrame, tick: str = "tick") -> DataFrame:
    """A1, list form: the scores of each (group, decision) of a tick, ascending.
    For inspection: a list is as long as the key has updates in the tick;
    everything else works on ``tick_stats``."""
    return updates.groupBy(G, D, tick).agg(F.array_sort(F.collect_list(-F.col("cost"))).alias("scores"))


def decision_map(stats: DataFrame) -> DataFrame:
    """A1/A3: one row per group with a map decision -> (score_sum, n)."""
    per_d = stats.groupBy(G, D).agg(F.sum("score_sum").alias("score_sum"),
                                    F.sum("n").alias("n"))
    return (per_d.groupBy(G)
            .agg(F.map_from_entries(F.collect_list(
                F.struct(F.col(D), F.struct("score_sum", F.col("n").cast("double").alias("n")))))
                .alias("dmap")))


def mean_col(score_sum="score_sum", n="n") -> Column:
    """A4: mean with the zero guard."""
    return F.when(F.col(n) > 0, F.col(score_sum) / F.col(n)).otherwise(F.lit(0.0))


def means(state: DataFrame) -> DataFrame:
    """A4: mean per (group, decision) and the group total N."""
    w = Window.partitionBy(G)
    return state.select(G, D, mean_col().alias("mean"),
                        F.sum("n").over(w).alias("N"))


def last_tick(stats: DataFrame, tick: str = "tick") -> Column:
    """Scalar subquery: the latest tick in ``stats`` (no join needed)."""
    return stats.select(F.max(tick)).scalar()


#: Ticks whose ranks one window call sees: a longer history is many blocks.
BLOCK_TICKS = 4096


def discounted_state(stats: DataFrame, gamma: float, at_tick=None,
                     tick: str = "tick", keys: list[str] | None = None,
                     block: int = BLOCK_TICKS) -> DataFrame:
    """Gamma-discounted (score_sum, n) per (group, decision) at tick T.

    Per tick the reference applies: decision active -> new + gamma*old;
    group active but decision not -> old; group idle -> gamma*old.  A tick-b
    contribution is therefore worth gamma^x at T with
    x = (A(T)-A(b)) + (T-b) - (G(T)-G(b)), A = active ticks of the
    decision, G = active ticks of the group.  No iteration and no dense tick
    grid.  x is a sum over blocks of ticks: within a block the ranks come from
    a window over (group, block) and the rows are summed to the block's end;
    what later blocks add is the same for a (group, decision, block), so the
    window over a group's whole history sees one row for each of these.
    ``at_tick`` defaults to the latest tick of the input (every group is
    reported, idle ones decayed to T).  It may also be a column of the rows
    (with ``keys`` naming the extra key, e.g. several snapshot ticks at
    once: ``keys=["snap", "group_id"]``, ``at_tick=F.col("snap")``).
    """
    keys = keys or [G]
    T = last_tick(stats, tick) if at_tick is None else (
        at_tick if isinstance(at_tick, Column) else F.lit(at_tick))
    s = stats.where(F.col(tick) <= T).withColumn("_T", T).withColumn("_b", F.floor(F.col(tick) / block))
    end = F.least((F.col("_b") + 1) * block - 1, F.col("_T"))
    kb = [*keys, "_b"]
    s = (s.withColumn("_G", F.dense_rank().over(Window.partitionBy(*kb).orderBy(tick)))
          .withColumn("_GB", F.max("_G").over(Window.partitionBy(*kb)))
          .withColumn("_A", F.row_number().over(Window.partitionBy(*kb, D).orderBy(tick)))
          .withColumn("_AB", F.count(F.lit(1)).over(Window.partitionBy(*kb, D))))
    x = (F.col("_AB") - F.col("_A")) + (end - F.col(tick)) - (F.col("_GB") - F.col("_G"))
    w = F.pow(F.lit(gamma), x)
    part = (s.groupBy(*kb, D, "_T", "_GB", "_AB")
            .agg(F.sum(F.col("score_sum") * w).alias("_s"), F.sum(F.col("n") * w).alias("_n"),
                 F.max(tick).alias("_last")))
    # one row of each (group, block) carries its active ticks
    one = F.row_number().over(Window.partitionBy(*kb).orderBy(D)) == 1
    part = part.withColumn("_g", F.when(one, F.col("_GB")).otherwise(0))
    later = Window.partitionBy(*keys).orderBy(F.col("_b").desc()).rangeBetween(Window.unboundedPreceding, -1)
    later_d = Window.partitionBy(*keys, D).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    part = (part.withColumn("_lg", F.coalesce(F.sum("_g").over(later), F.lit(0)))
            .withColumn("_la", F.coalesce(F.sum("_AB").over(later_d), F.lit(0))))
    f = F.pow(F.lit(gamma), F.col("_la") + (F.col("_T") - end) - F.col("_lg"))
    return (part.groupBy(*keys, D)
            .agg(F.sum(F.col("_s") * f).alias("score_sum"), F.sum(F.col("_n") * f).alias("n"),
                 F.max("_last").alias("last_tick")))


def active_ranks(stats: DataFrame, tick: str = "tick", block: int = BLOCK_TICKS) -> DataFrame:
    """Adds ``_G`` and ``_A``: how many active ticks the group, and the
    decision in it, has had up to each row.  Ranks within blocks of ticks plus
    the counts of earlier blocks, which are a small table."""
    s = stats.withColumn("_b", F.floor(F.col(tick) / block))
    before = lambda part: Window.partitionBy(*part).orderBy("_b")
    d = s.groupBy(G, D, "_b").agg(F.count(F.lit(1)).alias("_ac"))
    d = d.select(G, D, "_b", (F.sum("_ac").over(before([G, D])) - F.col("_ac")).alias("_a0"))
    g = s.groupBy(G, "_b", tick).agg(F.lit(1).alias("_1")).groupBy(G, "_b").agg(F.count(F.lit(1)).alias("_gc"))
    g = g.select(G, "_b", (F.sum("_gc").over(before([G])) - F.col("_gc")).alias("_g0"))
    return (s.withColumn("_gl", F.dense_rank().over(Window.partitionBy(G, "_b").orderBy(tick)))
            .withColumn("_al", F.row_number().over(Window.partitionBy(G, "_b", D).orderBy(tick)))
            .join(d, [G, D, "_b"]).join(g, [G, "_b"])
            .withColumn("_G", F.col("_g0") + F.col("_gl")).withColumn("_A", F.col("_a0") + F.col("_al"))
            .drop("_b", "_gl", "_al", "_g0", "_a0"))


def group_ranks(stats: DataFrame, tick: str = "tick", block: int = BLOCK_TICKS) -> DataFrame:
    """group_id, tick and ``_G``: the group's active ticks up to each of them."""
    s = stats.select(G, tick).distinct().withColumn("_b", F.floor(F.col(tick) / block))
    g = s.groupBy(G, "_b").agg(F.count(F.lit(1)).alias("_gc"))
    g = g.select(G, "_b", (F.sum("_gc").over(Window.partitionBy(G).orderBy("_b")) - F.col("_gc")).alias("_g0"))
    own = F.row_number().over(Window.partitionBy(G, "_b").orderBy(tick))
    return s.withColumn("_r", own).join(g, [G, "_b"]).select(G, tick, (F.col("_g0") + F.col("_r")).alias("_G"))


def merge_state(new: DataFrame, old: DataFrame, gamma: float) -> DataFrame:
    """Fold one tick of new stats into the state of the tick before.

    Full outer join on (group, decision) plus a group-activity flag.  Both
    sides are per-(group, decision) aggregates, so they are partitioned by
    group once and the join and the flag window share that partitioning.
    """
    n = new.select(G, D, F.col("score_sum").alias("_ns"), F.col("n").cast("double").alias("_nn"))
    o = old.select(G, D, F.col("score_sum").alias("_os"), F.col("n").cast("double").alias("_on"))
    j = n.repartition(G).join(o.repartition(G), [G, D], "full")
    active = F.max(F.col("_nn").isNotNull().cast("int")).over(Window.partitionBy(G)) == 1
    g = F.lit(gamma)
    ns = F.when(F.col("_nn").isNotNull(), F.col("_ns") + g * F.coalesce("_os", F.lit(0.0))) \
          .when(active, F.col("_os")).otherwise(g * F.col("_os"))
    nn = F.when(F.col("_nn").isNotNull(), F.col("_nn") + g * F.coalesce("_on", F.lit(0.0))) \
          .when(active, F.col("_on")).otherwise(g * F.col("_on"))
    return j.select(G, D, ns.alias("score_sum"), nn.alias("n"))


def advance_state(new: DataFrame, old: DataFrame, gamma: float, tick: int) -> DataFrame:
    """J4 with lazy decay: ``old`` (.., tick: the tick its group was last
    active in) -> the rows of the groups that ``new`` touches, at ``tick``.
    Other groups keep their rows; ``decay_lazily`` reads them."""
    idle = F.pow(F.lit(gamma), F.lit(tick - 1) - F.col("tick"))
    o = (old.join(new.select(G).distinct(), G, "left_semi")
         .select(G, D, (F.col("score_sum") * idle).alias("score_sum"), (F.col("n") * idle).alias("n")))
    return merge_state(new, o, gamma).withColumn("tick", F.lit(tick).cast("bigint"))


def decay_lazily(state: DataFrame, gamma: float, tick: int) -> DataFrame:
    """The state of ``advance_state`` as of ``tick``."""
    f = F.pow(F.lit(gamma), F.lit(tick) - F.col("tick"))
    return state.select(G, D, (F.col("score_sum") * f).alias("score_sum"), (F.col("n") * f).alias("n"))


def sums_in_window(stats: DataFrame, asked: DataFrame, length_ticks: int, tick: str = "tick") -> DataFrame:
    """``asked`` (group_id, decision, at) with score_sum and n over the ticks
    [at-length+1, at]; null where the window holds no row.

    Ticks are cut into blocks of the window's length, so a window is the end of
    one block and the beginning of the next.  A row of ``stats`` is put into its
    own block and into the next one; there, a running sum forwards over the
    block's own rows and one backwards over the rows of the block before give
    the two parts.  Nothing is subtracted, a row is added twice whatever the
    length, and a busy (group, decision) is spread over its blocks.
    """
    length = int(length_ticks)
    block = F.floor(F.col("_t") / length).cast("bigint")
    s = stats.select(G, D, F.col(tick).cast("bigint").alias("_t"), "score_sum", "n")
    own = s.select("*", block.alias("_b"), F.lit("own").alias("_role"), F.col("_t").alias("_from"))
    before = s.select("*", (block + 1).alias("_b"), F.lit("before").alias("_role"), F.col("_t").alias("_from"))
    ask = asked.select(G, D, F.col("at").cast("bigint").alias("_t"))
    ask = ask.select("*", block.alias("_b"), F.lit("z").alias("_role"), (F.col("_t") - (length - 1)).alias("_from"))
    rows = own.unionByName(before).unionByName(ask, allowMissingColumns=True)
    part = Window.partitionBy(G, D, "_b")
    is_ask = F.col("_role") == "z"

    def run(role: str, c: str, order: list) -> Column:
        # at equal ticks rows come before what is asked
        return F.sum(F.when(F.col("_role") == role, F.col(c))).over(part.orderBy(*order, is_ask))

    forth, back = [F.col("_t")], [F.col("_from").desc()]
    rows = rows.select("*", *[run(role, c, order).alias(f"_{role}_{c}") for role, order in (("own", forth), ("before", back))
                              for c in ("score_sum", "n")])

    def both(c: str) -> Column:
        x, y = F.col(f"_own_{c}"), F.col(f"_before_{c}")
        return F.coalesce(x + y, x, y).alias(c)

    return rows.where(is_ask).select(G, D, F.col("_t").alias("at"), both("score_sum"), both("n"))


def windowed_stats(stats: DataFrame, length_ticks: int, tick: str = "tick") -> DataFrame:
    """Sliding-window sums per (group, decision) at each active tick;
    the cost does not depend on the window's length (``sums_in_window``)."""
    return (sums_in_window(stats, stats.select(G, D, F.col(tick).alias("at")), length_ticks, tick)
            .withColumnRenamed("at", tick))


def window_state(stats: DataFrame, length_ticks: int, at_tick=None,
                 tick: str = "tick") -> DataFrame:
    """Sliding-window totals ending at tick T (epsilon-greedy state)."""
    T = last_tick(stats, tick) if at_tick is None else (
        at_tick if isinstance(at_tick, Column) else F.lit(at_tick))
    return (stats.where((F.col(tick) <= T) & (F.col(tick) > T - F.lit(length_ticks)))
            .groupBy(G, D).agg(F.sum("score_sum").alias("score_sum"),
                               F.sum("n").alias("n")))


def window_sums(updates: DataFrame, length_ticks: int, at_tick: int, tick: str = "tick") -> DataFrame:
    """``window_state`` straight from updates, one aggregation, for a tick that
    is known: filter ``updates`` on its time column first (``functions.
    in_ticks``) so that only the window is read."""
    return (updates.where((F.col(tick) <= at_tick) & (F.col(tick) > at_tick - length_ticks))
            .groupBy(G, D).agg(F.sum(-F.col("cost")).alias("score_sum"), F.count(F.lit(1)).alias("n")))
