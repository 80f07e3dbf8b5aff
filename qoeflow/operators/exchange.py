"""Cluster exchange (M5): subscriptions, fan-out, forwarding, sampling.

Subscriptions are a table of distinct (group, cluster) pairs instead of
a driver-held map; fan-out is an equi-join on group, so nothing is
collected to the driver.  Per-group sets are bounded by the number of
clusters, and ``collect_set`` de-duplicates map-side before the shuffle,
so a group with a third of all messages sends at most one copy of each
cluster per partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qoeflow.functions import hash_u32
from qoeflow.operators.records import drop_managed


def parse_subscriptions(df: DataFrame, value: str = "value", keep: list[str] | None = None) -> DataFrame:
    """P7: 'group;cluster' -> (group_id, cluster_id and the columns ``keep``);
    ``subscription_rejects`` has the other messages."""
    parts = F.split(F.col(value), ";")
    return (df.where(F.size(parts) > 1)
              .select(F.get(parts, 0).alias("group_id"), F.get(parts, 1).alias("cluster_id"), *(keep or [])))


def subscription_rejects(df: DataFrame, value: str = "value") -> DataFrame:
    """Messages that name no cluster, as they came."""
    return df.where(F.coalesce(F.size(F.split(F.col(value), ";")) <= 1, F.lit(True)))


def subscriber_sets(subs: DataFrame) -> DataFrame:
    """Group -> sorted set of subscribed clusters."""
    return subs.groupBy("group_id").agg(F.array_sort(F.collect_set("cluster_id")).alias("clusters"))


def fan_out(decisions: DataFrame, subs: DataFrame, me: str) -> DataFrame:
    """Every decision to every subscriber of its group but us."""
    s = subs.dropDuplicates(["group_id", "cluster_id"]).where(F.col("cluster_id") != F.lit(me))
    return decisions.join(s, "group_id", "inner")


def auto_subscribe(forwards: DataFrame, me: str, order: str = "seq") -> DataFrame:
    """First cluster each forwarded group went to; ask it for the
    group's decisions with a 'group;me' subscription."""
    first = forwards.groupBy("group_id").agg(F.min_by("cluster_id", order).alias("cluster_id"))
    return first.withColumn("message", F.concat_ws(";", F.col("group_id"), F.lit(me)))


def sample_filter(fraction: float, seed: str, key: str):
    """R2: reproducible Bernoulli sample (works in streaming, where
    ``DataFrame.sample`` is rejected): keep rows whose md5 draw is below
    fraction * 2^32."""
    return hash_u32(F.lit(seed), F.col(key)) < F.lit(fraction * 4294967296.0)


def feature_histogram(parsed: DataFrame, fraction: float, managed: int, seed: str,
                      key: str = "seq", fields: str = "fields") -> DataFrame:
    """Count per (feature index, value) over a sample of the updates."""
    s = parsed.where(sample_filter(fraction, seed, key))
    ex = s.select(F.posexplode(drop_managed(F.col(fields), managed)).alias("feature_idx", "value"))
    return ex.groupBy("feature_idx", "value").agg(F.count(F.lit(1)).alias("n"))


def heartbeats(routed: DataFrame, tick: str = "tick") -> DataFrame:
    """Liveness per (tick, cluster) and the tick's message count."""
    hb = routed.groupBy(tick, "cluster_id").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.max(F.unix_timestamp("ts")).alias("last_ts"))
    return hb.withColumn("n_batch", F.sum("n_records").over(Window.partitionBy(tick)))
