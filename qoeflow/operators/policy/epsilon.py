"""Epsilon-greedy over a sliding window.

Best = highest mean in the window (ties: smallest decision name); the
rest are kept, sorted by name, for the explore draw.  Epsilon is the
explore probability.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qoeflow.functions import hash_u32
from qoeflow.functions import pick as pick_of
from qoeflow.operators.policy.base import Policy


class EpsilonGreedy(Policy):
    decision_schema = "group_id string, best string, rest array<string>, epsilon double"

    def __init__(self, epsilon: float = 0.9, window_ticks: int = 4):
        super().__init__()
        self.epsilon = epsilon
        self.window_ticks = window_ticks

    def decide(self, state: DataFrame, keys: list[str] | None = None) -> DataFrame:
        keys = keys or ["group_id"]
        xs = state.groupBy(*keys).agg(
            F.collect_list(F.struct(F.col("decision").alias("d"),
                                    (F.col("score_sum") / F.col("n")).alias("m"))).alias("xs"))
        # values used inside lambdas are projected first: an outer expression
        # in a lambda body is re-evaluated on every call
        xs = xs.select(*keys, "xs", F.array_max(F.transform("xs", lambda x: x["m"])).alias("_top"))
        xs = xs.select(*keys, "xs", F.array_min(F.transform(
            F.filter("xs", lambda x: x["m"] == F.col("_top")), lambda x: x["d"])).alias("best"))
        return xs.select(
            *keys, "best",
            F.array_sort(F.filter(F.transform("xs", lambda x: x["d"]), lambda d: d != F.col("best")))
            .alias("rest"),
            F.lit(float(self.epsilon)).alias("epsilon"))

    def message(self, decisions: DataFrame, origin: str) -> DataFrame:
        from qoeflow.operators.records import format_epsilon
        return format_epsilon(decisions, origin)

    def pick(self, decision: Column, seed: str, key: str) -> Column:
        """K6: explore among ``rest`` with probability epsilon (a draw of 101
        outcomes), else ``best``; no ``rest`` always gives ``best``."""
        r = F.pmod(hash_u32(F.lit(seed), F.lit("eps"), F.col(key)), F.lit(101))
        explore = pick_of(decision["rest"], hash_u32(F.lit(seed), F.lit("explore"), F.col(key)))
        return (F.when(decision["best"].isNull(), F.lit(None))
                 .when(F.coalesce(F.size(decision["rest"]), F.lit(0)) <= 0, decision["best"])
                 .when(r < decision["epsilon"] * 100, explore)
                 .otherwise(decision["best"]))
