"""Record plumbing: parse, project, route, format and decode messages.

All row-local expressions (no shuffle) except the cluster lookups, which
are joins against a small assignment table.  Rows that cannot be parsed
go to a reject frame instead of failing the batch (reference quirks: an
id holding ':' or ';' was cut, an empty decision threw, one bad line
dropped the rest of the file).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qoeflow.functions import is_empty, strip_chars

UPDATE_SCHEMA = T.StructType([
    T.StructField("update", T.StringType()),
    T.StructField("group_id", T.StringType()),
    T.StructField("cluster_id", T.StringType()),
])


def label_indexes(labels: list[str], keep: list[str]) -> list[int]:
    """Positions of ``keep`` in ``labels``; unknown labels are an error
    raised up front (the reference silently used index -1)."""
    missing = [k for k in keep if k not in labels]
    if missing:
        raise ValueError(f"unknown labels {missing}; known: {labels}")
    return [labels.index(k) for k in keep]


def read_label_config(spark, path: str) -> tuple[list[str], list[str]]:
    """The two-line tab-separated label file (tiny config)."""
    lines = [r.value for r in spark.read.text(path).take(2)]
    return lines[0].split("\t"), lines[1].split("\t")


def parse_messages(df: DataFrame, value: str = "value") -> DataFrame:
    """Trim + JSON + split of the tab-separated update text."""
    j = F.from_json(F.trim(F.col(value)), UPDATE_SCHEMA)
    return (df.withColumn("_j", j)
            .withColumn("group_id", F.col("_j.group_id"))
            .withColumn("cluster_id", F.col("_j.cluster_id"))
            .withColumn("fields", F.split(F.col("_j.update"), "\t"))
            .drop("_j"))


def parse_updates(df: DataFrame, labels: list[str], value: str = "value",
                  decision_label: str = "decision", cost_label: str = "socre") -> tuple[DataFrame, DataFrame]:
    """Messages -> (group_id, decision, cost, score); second frame = rejects.

    score = 0 - cost.  A row is rejected when the JSON is broken, the group
    or decision is empty, or the cost is not a number.
    """
    di, ci = label_indexes(labels, [decision_label, cost_label])
    p = parse_messages(df, value)
    dec = F.get(F.col("fields"), di)
    cost = F.get(F.col("fields"), ci).try_cast("double")
    p = p.withColumn("decision", dec).withColumn("cost", cost).withColumn("score", -cost)
    bad = (F.col("group_id").isNull() | (F.col("group_id") == "") | F.col("decision").isNull()
           | (F.col("decision") == "") | F.col("cost").isNull())
    return p.where(~bad), p.where(bad)


def project_labels(df: DataFrame, labels: list[str], keep: list[str],
                   fields: str = "fields") -> Column:
    """Keep the chosen labels in the chosen order, re-joined with tabs."""
    idx = label_indexes(labels, keep)
    return F.array_join(F.array(*[F.get(F.col(fields), i) for i in idx]), "\t")


def split_messages(df: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Messages that can be routed, and the rejects: JSON that cannot be read
    or names no group or update."""
    p = parse_messages(df, value)
    bad = F.col("group_id").isNull() | F.col("fields").isNull()
    return p.where(~bad).select(*df.columns), p.where(bad).select(*df.columns)


def lookup_cluster(df: DataFrame, assign: DataFrame, me: str) -> DataFrame:
    """Group -> cluster, absent -> this cluster.  (Group 'null' is ours
    unless assigned, which the same default gives.)

    ``assign`` is one row per group; it is broadcast only when Spark's
    size estimate is under the broadcast threshold (AQE decides), else
    this is a shuffled left join on group_id.
    """
    a = assign.select("group_id", F.col("cluster_id").alias("_assigned"))
    j = df.drop("cluster_id").join(a, "group_id", "left")
    return j.withColumn("cluster_id", F.coalesce("_assigned", F.lit(me))).drop("_assigned")


def route(df: DataFrame, assign: DataFrame, me: str, labels: list[str],
          keep: list[str]) -> DataFrame:
    """Pick the topic and enrich the message for processing.
    Messages that cannot be read belong to no topic: see ``split_messages``."""
    r = lookup_cluster(parse_messages(split_messages(df)[0]), assign, me)
    reduced = project_labels(r, labels, keep)
    topic = F.when(F.col("cluster_id") == F.lit(me), "internal_groups").otherwise("external_groups")
    return (r.withColumn("reduced", reduced).withColumn("topic", topic)
            .withColumn("message", F.to_json(F.struct(F.col("reduced").alias("update"),
                                                      "group_id", "cluster_id"))))


def forward(routed: DataFrame, clusters: DataFrame, me: str) -> tuple[DataFrame, DataFrame]:
    """External rows -> their cluster's address; unknown cluster -> rejects."""
    ext = routed.where(F.col("cluster_id") != F.lit(me))
    j = ext.join(clusters.select("cluster_id", "address"), "cluster_id", "left")
    return j.where(F.col("address").isNotNull()), j.where(F.col("address").isNull())


def format_decision(decisions: DataFrame, origin: str, slots: str = "slots") -> DataFrame:
    """P12: 'group;d1:d2:...:dk:;From: origin'."""
    body = F.concat(F.array_join(F.col(slots), ":"), F.lit(":"))
    return decisions.withColumn("message", F.concat_ws(";", F.col("group_id"), body, F.lit(origin)))


def decode_decision(df: DataFrame, message: str = "message") -> DataFrame:
    """Split a decision message back into group and slot list."""
    parts = F.split(F.col(message), ";")
    slots = F.split(strip_chars(F.get(parts, 1)), ":")
    return df.withColumn("decoded_group", F.get(parts, 0)).withColumn("decoded_slots", slots)


def split_request(df: DataFrame, n_features: int, payload: str = "payload") -> DataFrame:
    """Request text -> features and candidate decisions."""
    arr = F.split(F.col(payload), "\t")
    return (df.withColumn("features", F.slice(arr, 1, n_features))
            .withColumn("candidates", F.slice(arr, n_features + 1, F.greatest(F.size(arr) - n_features, F.lit(0)))))


def drop_managed(features: Column, managed: int) -> Column:
    """All fields but the last ``managed``."""
    return F.slice(features, 1, F.greatest(F.size(features) - managed, F.lit(0)))


def available(decision: Column, candidates: Column) -> Column:
    """The decision is usable and among the candidates."""
    return ~is_empty(decision) & F.coalesce(F.array_contains(candidates, decision), F.lit(False))


EPSILON_SCHEMA = "random array<string>, best string, epsilon double"


def format_epsilon(decisions: DataFrame, origin: str) -> DataFrame:
    """D8: 'group;{"random":[..],"best":..,"epsilon":..};From: origin'."""
    body = F.to_json(F.struct(F.col("rest").alias("random"), "best", "epsilon"))
    return decisions.withColumn("message", F.concat_ws(";", F.col("group_id"), body, F.lit(origin)))


def parse_epsilon(df: DataFrame, message: str = "message") -> DataFrame:
    """D8 back to columns.  The JSON body is the text between the first and
    the last ';' (group ids hold no ';', the origin follows the last one)."""
    m = F.col(message)
    body = F.expr(f"substring({message}, instr({message}, ';') + 1, "
                  f"length({message}) - instr({message}, ';') - length(substring_index({message}, ';', -1)) - 1)")
    j = F.from_json(body, EPSILON_SCHEMA)
    return df.select(F.substring_index(m, ";", 1).alias("group_id"), j["best"].alias("best"),
                     F.coalesce(j["random"], F.array().cast("array<string>")).alias("rest"),
                     j["epsilon"].alias("epsilon"))
