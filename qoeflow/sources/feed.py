"""The group-table feed.

Messages are JSON objects; those with ``GroupAssignment`` carry
(GroupName, Cluster) pairs and those with ``GroupingRules`` carry a rule
document.  Later messages win (message sequence, then position inside
the message).  Group "null" always maps to this cluster unless assigned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEED_SCHEMA = T.StructType([
    T.StructField("GroupAssignment", T.ArrayType(T.StructType([
        T.StructField("GroupName", T.StringType()),
        T.StructField("Cluster", T.StringType())]))),
    # kept as raw JSON text; flattened by qoeflow.operators.rules
    T.StructField("GroupingRules", T.StringType()),
])


def parse_feed(feed: DataFrame, value: str = "value") -> DataFrame:
    return feed.withColumn("_m", F.from_json(F.col(value), FEED_SCHEMA))


def feed_rejects(feed: DataFrame) -> DataFrame:
    """Messages that are neither an assignment nor a rule document (broken
    JSON included), as they came."""
    p = parse_feed(feed)
    return p.where(F.col("_m").isNull() | (F.col("_m.GroupAssignment").isNull() & F.col("_m.GroupingRules").isNull())
                   ).drop("_m")


def assignments(feed: DataFrame, seq: str = "seq") -> DataFrame:
    """Every (group, cluster) pair with its (seq, pos) order."""
    p = parse_feed(feed).where(F.col("_m.GroupAssignment").isNotNull())
    return p.select(seq, F.posexplode("_m.GroupAssignment").alias("pos", "a")) \
            .select(seq, "pos", F.col("a.GroupName").alias("group_id"), F.col("a.Cluster").alias("cluster_id"))


def group_assignment(feed: DataFrame, me: str, seq: str = "seq") -> DataFrame:
    """Newest cluster per group (last write wins), plus the 'null'
    default of this cluster."""
    # the default is a row before every message, so one aggregate reads the feed once
    a = assignments(feed, seq).select("group_id", "cluster_id", F.struct(
        F.col(seq).cast("bigint").alias("seq"), F.col("pos").cast("int").alias("pos")).alias("o"))
    none = F.struct(F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast("int").alias("pos"))
    seed = a.sparkSession.range(1).select(F.lit("null").alias("group_id"), F.lit(me).alias("cluster_id"),
                                          none.alias("o"))
    return a.unionByName(seed).groupBy("group_id").agg(F.max_by("cluster_id", "o").alias("cluster_id"))


def latest_rules(feed: DataFrame, seq: str = "seq") -> DataFrame:
    """The newest rule document of the feed as (doc_id, rules)."""
    p = parse_feed(feed).where(F.col("_m.GroupingRules").isNotNull())
    return p.agg(F.max_by(F.col("_m.GroupingRules"), F.col(seq)).alias("rules"),
                 F.max(seq).alias("doc_id")).where(F.col("rules").isNotNull())
