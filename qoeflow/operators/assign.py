"""M1: serve decisions to requests (re-aimed from the per-request web path).

requests -> group (rules or ASN default) -> latest decision of the group
(left join) -> reproducible draw -> availability check -> fallback draw
among the request's candidates.  Draws are md5-based (R1), so a rerun, a
retried task, or the SQL oracle gets the same answer.

Scale: the decision tables hold one row per group whose payload is
bounded by the decision catalogue; the request side is the big one.  A
group holding a third of all requests is a skewed equi-join key: AQE's
skew-join splitting handles it for the shuffled plan, and the broadcast
plan (chosen when the decision table's estimate is under the threshold)
has no skew at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qoeflow.functions import hash_u32, pick, strip_chars
from qoeflow.operators.records import available


def _fallback(df: DataFrame, seed: str, key: str) -> Column:
    """Uniform pick among the candidates; null when there are none."""
    return pick("candidates", hash_u32(F.lit(seed), F.lit("fallback"), F.col(key)))


def _finish(df: DataFrame, picked: Column, seed: str, key: str) -> DataFrame:
    ok = available(F.col("_picked"), F.col("candidates"))
    return (df.withColumn("_picked", picked)
              .withColumn("source", F.when(ok, F.lit("policy")).otherwise(F.lit("fallback")))
              .withColumn("decision", F.when(ok, F.col("_picked")).otherwise(_fallback(df, seed, key)))
              .drop("_picked"))


def assign_slots(requests: DataFrame, latest: DataFrame, seed: str, key: str = "req_id") -> DataFrame:
    """K5 + K8: uniform pick from the group's slot string 'd1:...:dk:'."""
    return draw_slots(requests.join(latest.select("group_id", "slots"), "group_id", "left"), seed, key).drop("slots")


def draw_slots(joined: DataFrame, seed: str, key: str = "req_id") -> DataFrame:
    """The draw of ``assign_slots`` for requests that have their decision
    (``slots``, null without one) beside them."""
    slots = F.split(strip_chars(F.col("slots")), ":")
    return _finish(joined, pick(slots, hash_u32(F.lit(seed), F.lit("slot"), F.col(key))), seed, key)


def assign_epsilon(requests: DataFrame, eg: DataFrame, seed: str, key: str = "req_id") -> DataFrame:
    """K6 + K8: explore with probability epsilon among ``rest``, else ``best``.

    The explore test is ``rand(0,100) < epsilon*100`` (101 outcomes).  A
    decision with no ``rest`` always gives ``best``."""
    j = requests.join(eg.select("group_id", "best", "rest", "epsilon"), "group_id", "left")
    r = F.pmod(hash_u32(F.lit(seed), F.lit("eps"), F.col(key)), F.lit(101))
    explore = pick("rest", hash_u32(F.lit(seed), F.lit("explore"), F.col(key)))
    choice = (F.when(F.col("best").isNull(), F.lit(None))
               .when(F.coalesce(F.size("rest"), F.lit(0)) <= 0, F.col("best"))
               .when(r < F.col("epsilon") * 100, explore)
               .otherwise(F.col("best")))
    return _finish(j, choice, seed, key).drop("best", "rest", "epsilon")


def format_weights(weights: DataFrame) -> DataFrame:
    """The weighted decision file of each group as ordered lines
    'decision;probability'."""
    return weights.select("group_id", "pos",
                          F.concat_ws(";", "decision", F.col("p").cast("string")).alias("line"))


def parse_weights(lines: DataFrame) -> DataFrame:
    """D9 lines back to (group_id, pos, decision, p); ``weight_rejects`` has the
    other lines.  Probabilities keep up to 12 decimals, as an exact DECIMAL, so
    running sums do not depend on their order."""
    parts = F.split(F.col("line"), ";")
    return (lines.select("group_id", "pos", F.get(parts, 0).alias("decision"),
                         F.get(parts, 1).try_cast("decimal(15,12)").alias("p"))
                 .where(F.col("decision").isNotNull() & F.col("p").isNotNull()))


def weight_rejects(lines: DataFrame) -> DataFrame:
    """Lines without a decision and a probability, as they came."""
    p = F.get(F.split(F.col("line"), ";"), 1).try_cast("decimal(15,12)")
    return lines.where(p.isNull())


def weighted_lists(weights: DataFrame) -> DataFrame:
    """D9 -> per group the ordered list with cumulative percentages.

    ``weights``: (group_id, pos, decision, p) with p a DECIMAL so the
    running sum is exact.  The window is per group over at most the
    decision catalogue."""
    w = Window.partitionBy("group_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    c = weights.withColumn("cum100", F.sum(F.col("p") * 100).over(w))
    return c.groupBy("group_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "decision", "cum100"))).alias("_w"))


def assign_weighted(requests: DataFrame, weights: DataFrame, seed: str, key: str = "req_id") -> DataFrame:
    """K7: walk the list subtracting p*100 from rand(0,100) until <= 0; else last."""
    lists = weighted_lists(weights)
    j = requests.join(lists, "group_id", "left").withColumn(
        "_v", F.pmod(hash_u32(F.lit(seed), F.lit("weighted"), F.col(key)), F.lit(101)))
    hit = F.filter("_w", lambda e: e["cum100"] >= F.col("_v"))
    pick = F.when(F.size(hit) > 0, F.get(hit, 0)["decision"]) \
            .otherwise(F.get("_w", F.size("_w") - 1)["decision"])
    return (j.withColumn("decision", F.when(F.col("_w").isNotNull(), pick))
             .withColumn("source", F.when(F.col("_w").isNotNull(), F.lit("weighted")).otherwise(F.lit("none")))
             .drop("_w", "_v"))
