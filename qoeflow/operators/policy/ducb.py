"""Discounted UCB.

Per group, ``slots`` greedy picks; the index of a decision is
mean + bonus*sqrt(2 ln N)/sqrt(n) (no bonus when N <= 1, index 0 when
n = 0).  After each pick the chosen n grows by one, N by one, then N and
every n are multiplied by gamma; means stay fixed.  Ties go to the
smallest decision name.  The loop is an ``aggregate`` over
``sequence(1, slots)`` on the group's decision array -- a Catalyst
expression, no UDF.  The array holds one entry per decision of the
group (the decision catalogue), never raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qoeflow.functions import hash_u32
from qoeflow.functions import pick as pick_of
from qoeflow.operators import stats as S
from qoeflow.operators.policy.base import Policy


class DiscountedUCB(Policy):
    decision_schema = "group_id string, slots array<string>"

    def __init__(self, gamma: float = 0.8, slots: int = 10, bonus: float = 1000.0):
        super().__init__(gamma)
        self.slots = slots
        self.bonus = bonus

    def _index_sql(self, mean: str, n: str, N: str) -> str:
        b = f"CASE WHEN {N} > 1 THEN {self.bonus!r} * sqrt(2 * ln({N})) ELSE 0D END"
        return f"CASE WHEN {n} > 0 THEN {mean} + ({b}) / sqrt({n}) ELSE 0D END"

    def index(self, state: DataFrame) -> DataFrame:
        """K4: first-step index per (group, decision) and its rank."""
        m = state.select("group_id", "decision", F.col("n").cast("double").alias("n_d"),
                         S.mean_col().alias("mean"),
                         F.sum(F.col("n").cast("double")).over(Window.partitionBy("group_id")).alias("N"))
        idx = F.expr(self._index_sql("mean", "n_d", "N"))
        w = Window.partitionBy("group_id").orderBy(F.col("ucb").desc(), F.col("decision"))
        return (m.select("group_id", "decision", "mean", "N", idx.alias("ucb"))
                .withColumn("rnk", F.rank().over(w)))

    def decide(self, state: DataFrame, keys: list[str] | None = None,
               engine: str | None = None) -> DataFrame:
        """K3: the slot list per group (or per ``keys``, e.g. group and tick).

        ``engine='catalyst'`` runs the loop as one higher-order-function
        expression (no Python); ``engine='arrow'`` runs the same arithmetic
        vectorised with numpy over whole Arrow batches of keys -- for
        millions of keys (decisions per group and tick in a replay, where it
        is the default) interpreted lambdas cost hundreds of microseconds
        per key.
        """
        keys = keys or ["group_id"]
        engine = engine or ("arrow" if "at" in keys else "catalyst")
        if engine == "arrow":
            return self._decide_arrow(state, keys)
        per_group = state.groupBy(*keys).agg(
            F.collect_list(F.struct(
                F.col("decision").alias("d"),
                S.mean_col().alias("mean"),
                F.col("n").cast("double").alias("n"))).alias("items"),
            F.sum(F.col("n").cast("double")).alias("N0"))
        g = repr(float(self.gamma))
        bonus = f"CASE WHEN a.N > 1 THEN {self.bonus!r} * sqrt(2 * ln(a.N)) ELSE 0D END"
        # Higher-order functions are interpreted, so every value is bound
        # once per step: aggregate(array(v), acc, (acc, name) -> ...) is a
        # 'let name = v'.  argmax is one pass: higher index, then smaller name.
        expr = f"""
          aggregate(sequence(1, {int(self.slots)}),
            named_struct('items', items, 'N', N0, 'picks', CAST(array() AS array<string>)),
            (a, i) -> aggregate(array({bonus}), a, (a, b) ->
              aggregate(array(transform(a.items, e -> named_struct(
                          'd', e.d, 's', CASE WHEN e.n > 0 THEN e.mean + b / sqrt(e.n) ELSE 0D END))),
                a, (a, sc) ->
                aggregate(array(aggregate(sc, sc[0], (m, x) ->
                            CASE WHEN x.s > m.s OR (x.s = m.s AND x.d < m.d) THEN x ELSE m END).d),
                  a, (a, best) -> named_struct(
                    'items', transform(a.items, e -> named_struct(
                        'd', e.d, 'mean', e.mean,
                        'n', (e.n + CASE WHEN e.d = best THEN 1D ELSE 0D END) * {g})),
                    'N', (a.N + 1D) * {g},
                    'picks', concat(a.picks, array(best)))))),
            a -> a.picks)"""
        return per_group.select(*keys, F.expr(expr).alias("slots"))

    def _decide_arrow(self, state: DataFrame, keys: list[str]) -> DataFrame:
        items = state.groupBy(*keys).agg(
            F.array_sort(F.collect_list(F.struct(
                F.col("decision").alias("d"), S.mean_col().alias("m"),
                F.col("n").cast("double").alias("n")))).alias("_it"),
            F.sum(F.col("n").cast("double")).alias("N0"))
        items = items.select(*keys, "N0", F.col("_it.d").alias("_d"), F.col("_it.m").alias("_m"),
                             F.col("_it.n").alias("_n"))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields
                           if f.name in keys) + ", slots array<string>"
        gamma, slots, bonus = float(self.gamma), int(self.slots), float(self.bonus)

        def run(batches):
            import numpy as np
            for pdf in batches:
                b = len(pdf)
                if b == 0:
                    continue
                lens = pdf["_d"].map(len).to_numpy()
                k = int(lens.max())
                rows = np.repeat(np.arange(b), lens)
                cols = np.concatenate([np.arange(x) for x in lens])
                names = np.full((b, k), None, dtype=object)
                mean = np.zeros((b, k))
                n = np.full((b, k), np.nan)
                names[rows, cols] = np.concatenate(pdf["_d"].to_numpy())
                mean[rows, cols] = np.concatenate(pdf["_m"].to_numpy()).astype(float)
                n[rows, cols] = np.concatenate(pdf["_n"].to_numpy()).astype(float)
                pad = np.isnan(n)
                N = pdf["N0"].to_numpy(dtype=float).copy()
                picks = np.zeros((b, slots), dtype=np.int64)
                ar = np.arange(b)
                with np.errstate(invalid="ignore", divide="ignore"):
                    for j in range(slots):
                        big = N > 1
                        bon = np.where(big, bonus * np.sqrt(2 * np.log(np.where(big, N, 2.0))), 0.0)
                        pos = n > 0
                        sc = np.where(pos, mean + bon[:, None] / np.sqrt(np.where(pos, n, 1.0)), 0.0)
                        sc[pad] = -np.inf
                        best = np.argmax(sc, axis=1)    # first max = smallest name (sorted)
                        picks[:, j] = best
                        n[ar, best] += 1.0
                        N = (N + 1.0) * gamma
                        n *= gamma
                out = pdf[keys].copy()
                out["slots"] = list(names[ar[:, None], picks])
                yield out

        return items.mapInPandas(run, schema)

    def message(self, decisions: DataFrame, origin: str) -> DataFrame:
        from qoeflow.operators.records import format_decision
        return format_decision(decisions, origin)

    def pick(self, decision: Column, seed: str, key: str) -> Column:
        """K5: a uniform pick of the slots."""
        return pick_of(decision["slots"], hash_u32(F.lit(seed), F.lit("slot"), F.col(key)))
