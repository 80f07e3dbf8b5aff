"""The policy plug-in.

A policy is all that the decision loop and the replay know of deciding:

* ``state(stats)``: tick statistics -> state per (group, decision);
* ``advance(new, old, tick)``: the loop's merge of one tick's sums into the
  kept state -- only the rows that change; ``current(state, tick)``: what to
  decide on from it; ``state_schema``, ``state_keys`` and ``alive`` describe the
  kept table (``streaming.tables.MergeTable``, in buckets by group);
* ``state_at(stats, asks)``: the state at every asked (group, tick) of a replay;
* ``decide(state, keys)``: one decision per group (or per ``keys``);
* ``message(decisions, origin)``: decisions as published text;
* ``pick(decision, seed, key)``: what a request or session gets from one.

Built-in policies implement ``decide`` as DataFrame expressions.  A custom
policy may instead implement

* ``decide_pandas(pdf) -> pdf`` on one group's state rows (bounded by the
  decision catalogue), run through ``applyInPandas``; or
* ``decide_batch(pdf) -> pdf`` on a batch of groups, one row per group
  with list columns ``decisions``, ``score_sums``, ``ns``, returning one row
  for each in the same order -- run through ``mapInPandas`` over Arrow
  batches, so millions of groups cost a few calls per partition instead of
  one call per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qoeflow.operators import stats as S


class Policy:
    window_ticks: int | None = None     # None = discounted state, else sliding window
    decision_schema: str = "group_id string, decision string"
    state_schema: str = "group_id string, decision string, score_sum double, n double, tick bigint"

    def __init__(self, gamma: float = 0.8):
        self.gamma = gamma

    def state(self, stats: DataFrame, at_tick=None) -> DataFrame:
        if self.window_ticks:
            return S.window_state(stats, self.window_ticks, at_tick)
        return S.discounted_state(stats, self.gamma, at_tick)

    def advance(self, new: DataFrame, old: DataFrame | None, tick: int) -> DataFrame:
        """Rows of the kept state that the sums ``new`` (group_id, decision,
        score_sum, n) of one more tick change: the discounted sums of the groups
        they touch (of ``old``, at least those groups' rows are needed), or the
        sums themselves as the window's newest tick."""
        new = new.select("group_id", "decision", F.col("score_sum").cast("double").alias("score_sum"),
                         F.col("n").cast("double").alias("n"))
        if self.window_ticks:
            return new.withColumn("tick", F.lit(tick).cast("bigint"))
        return S.advance_state(new, old, self.gamma, tick)

    def current(self, state: DataFrame, tick: int) -> DataFrame:
        """(group_id, decision, score_sum, n) of the kept state as of ``tick``."""
        if not self.window_ticks:
            return S.decay_lazily(state, self.gamma, tick)
        return (state.where(self.alive(tick)).groupBy("group_id", "decision")
                .agg(F.sum("score_sum").alias("score_sum"), F.sum("n").alias("n")))

    @property
    def state_keys(self) -> list[str]:
        return ["group_id", "decision", "tick"] if self.window_ticks else ["group_id", "decision"]

    def alive(self, tick: int) -> Column:
        """Whether a row of the kept state still counts at ``tick``."""
        return F.col("tick") > tick - self.window_ticks if self.window_ticks else F.lit(True)

    def state_at(self, stats: DataFrame, asks: DataFrame, tick: str = "tick") -> DataFrame:
        """State at every asked (group_id, at), with the column ``at``."""
        if self.window_ticks:
            asked = asks.join(stats.select("group_id", "decision").distinct(), "group_id")
            return S.sums_in_window(stats, asked, self.window_ticks, tick).where("n is not null")
        from qoeflow.operators.replay import state_asof, state_history
        return state_asof(state_history(stats, self.gamma, tick), stats, asks, self.gamma, tick)

    def decide(self, state: DataFrame, keys: list[str] | None = None) -> DataFrame:
        keys = keys or ["group_id"]
        extra = [k for k in keys if k != "group_id"]
        schema = self.decision_schema + "".join(f", {k} {state.schema[k].dataType.simpleString()}" for k in extra)
        if type(self).decide_batch is not Policy.decide_batch:
            lists = (state.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
                "decision", F.col("score_sum").cast("double").alias("s"),
                F.col("n").cast("double").alias("n")))).alias("_x"))
                .select(*keys, F.col("_x.decision").alias("decisions"),
                        F.col("_x.s").alias("score_sums"), F.col("_x.n").alias("ns")))
            fb = self.decide_batch

            def batches(it):
                for pdf in it:
                    yield fb(pdf.drop(columns=extra)).assign(**{k: pdf[k].to_numpy() for k in extra})
            return lists.mapInPandas(batches, schema)
        fn = self.decide_pandas

        def per_group(pdf):
            return fn(pdf.drop(columns=extra)).assign(**{k: pdf[k].iloc[0] for k in extra})

        return (state.select(*keys, "decision", "score_sum", "n").groupBy(*keys)
                .applyInPandas(per_group, schema))

    def message(self, decisions: DataFrame, origin: str) -> DataFrame:
        """``message``: 'group;decision;origin'."""
        return decisions.withColumn("message", F.concat_ws(";", "group_id", "decision", F.lit(origin)))

    def pick(self, decision: Column, seed: str, key: str) -> Column:
        """The choice for one row (identified by column ``key``) from a struct
        of the decision's columns."""
        return decision["decision"]

    def decide_pandas(self, pdf):  # pragma: no cover - abstract
        raise NotImplementedError

    def decide_batch(self, pdf):  # pragma: no cover - optional
        raise NotImplementedError
