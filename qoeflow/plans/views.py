"""Derived fixture views over the driver tables (Spark side).

Each view has a twin SQL definition in ``sqlviews`` so the DuckDB oracle
computes from exactly the same inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qoeflow.functions import tick_of
from qoeflow.plans import params as P


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def updates(spark, sf_dir) -> DataFrame:
    """V.updates: one measurement per event; group = user."""
    return updates_of(table(spark, sf_dir, "events"))


def updates_of(ev: DataFrame) -> DataFrame:
    return ev.select(
        "event_id", "ts",
        F.col("user_id").cast("string").alias("group_id"),
        F.col("event_type").alias("decision"),
        F.col("value").alias("cost"),
        tick_of("ts", P.TICK_S).alias("tick"))


def cost_text(c) -> F.Column:
    return F.col(c).cast("decimal(12,2)").cast("string")


def messages(spark, sf_dir) -> DataFrame:
    """V.messages: update messages as JSON text, seq = event_id."""
    ev = table(spark, sf_dir, "events")
    upd = F.concat_ws("\t", F.col("event_id").cast("string"),
                      F.get_json_object("props", "$.k"),
                      (F.col("user_id") % 7).cast("string"),
                      F.col("event_type"), cost_text("value"))
    gid = (F.col("user_id") % 40).cast("string")
    return ev.select(
        F.col("event_id").alias("seq"), "ts",
        F.to_json(F.struct(upd.alias("update"), gid.alias("group_id"))).alias("value"))


def broken_messages(spark, sf_dir) -> DataFrame:
    """V.messages with every seventh one cut off (no readable JSON)."""
    m = messages(spark, sf_dir)
    return m.withColumn("value", F.when(F.col("seq") % 7 == 0, F.substring("value", 1, 9)).otherwise(F.col("value")))


def assign(spark, sf_dir) -> DataFrame:
    """V.assign: group -> cluster table (25 of the 40 message groups)."""
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("string").alias("group_id"),
                    F.concat(F.lit("c"), F.col("n_regionkey").cast("string")).alias("cluster_id"))


def clusters(spark, sf_dir) -> DataFrame:
    """Cluster address table (for forward routing)."""
    r = table(spark, sf_dir, "region")
    return r.select(F.concat(F.lit("c"), F.col("r_regionkey").cast("string")).alias("cluster_id"),
                    F.concat(F.lower("r_name"), F.lit(":9092")).alias("address"))


def assign_feed(spark, sf_dir) -> DataFrame:
    """V.assign_feed: group-table messages (seq, value).

    Version 1 and 2 of the assignment, one message per (version, region);
    version 2 moves even keys to the next region's cluster.  A rules
    message at seq 0 is mixed in and must be ignored by the reader.
    """
    n = table(spark, sf_dir, "nation")
    v = F.explode(F.array(F.lit(1), F.lit(2))).alias("version")
    rows = n.select(v, "n_nationkey", "n_regionkey")
    cl = F.when((F.col("version") == 2) & (F.col("n_nationkey") % 2 == 0),
                F.pmod(F.col("n_regionkey") + 1, F.lit(5))).otherwise(F.col("n_regionkey"))
    rows = rows.select("version", "n_regionkey", "n_nationkey",
                       F.struct(F.col("n_nationkey").cast("string").alias("GroupName"),
                                F.concat(F.lit("c"), cl.cast("string")).alias("Cluster")).alias("a"))
    msgs = (rows.groupBy("version", "n_regionkey")
            .agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "a"))).alias("xs"))
            .select((F.col("version") * 10 + F.col("n_regionkey") + 1).cast("bigint").alias("seq"),
                    F.to_json(F.struct(F.transform("xs", lambda x: x["a"]).alias("GroupAssignment")))
                    .alias("value")))
    rules_msg = rules(spark, sf_dir).select(
        F.lit(0).cast("bigint").alias("seq"),
        F.concat(F.lit('{"GroupingRules":'), F.col("rules"), F.lit("}")).alias("value"))
    return msgs.unionByName(rules_msg)


def requests(spark, sf_dir) -> DataFrame:
    """V.requests: one request per order; features then candidates, tab-joined."""
    o = table(spark, sf_dir, "orders")
    cands = F.when(F.col("o_orderkey") % 2 == 0, F.lit("\t".join(P.DECISION_TYPES[:4]))) \
             .otherwise(F.lit("\t".join(P.DECISION_TYPES)))
    payload = F.concat_ws("\t", "o_orderstatus", "o_orderpriority",
                          (F.col("o_custkey") % 7).cast("string"),
                          (F.col("o_custkey") % 150).cast("string"), cands)
    return o.select(F.col("o_orderkey").alias("req_id"), payload.alias("payload"))


N_REQUEST_FEATURES = 4
ASN_INDEX = 3   # feature used as the default group


def rules(spark, sf_dir) -> DataFrame:
    """V.rules: one grouping-rules document derived from the orders table.

    Level 0 splits on feature 0 (status), level 1 on feature 1 (priority),
    level 2 on feature 2 (custkey mod 7).  Status 'P' is a leaf at level 1;
    priorities '1-URGENT' and '2-HIGH' are leaves at level 2; key '3' is
    missing at level 2; '3-MEDIUM' appears twice under 'F' (last wins).
    """
    o = table(spark, sf_dir, "orders")
    combos = o.select("o_orderstatus", "o_orderpriority").distinct()
    leaf = lambda name: F.concat(F.lit('{"GroupName":"'), name, F.lit('"}'))
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    inner = F.concat(
        F.lit('{"Field":"2","Table":['),
        F.concat_ws(",", *[F.concat(F.lit(f'{{"Key":"{m}","Rule":'),
                                     leaf(F.concat(s, F.lit("-"), p, F.lit(f"-{m}"))), F.lit("}"))
                            for m in range(7) if m != 3]),
        F.lit("]}"))
    lvl2 = F.when(p.startswith("1-") | p.startswith("2-"), leaf(F.concat(s, F.lit("-"), p))).otherwise(inner)
    entry = F.concat(F.lit('{"Key":"'), p, F.lit('","Rule":'), lvl2, F.lit("}"))
    dup = F.when((s == "F") & (p == "3-MEDIUM"),
                 F.concat(F.lit(',{"Key":"3-MEDIUM","Rule":'), leaf(F.lit("F-3-MEDIUM-dup")), F.lit("}"))) \
           .otherwise(F.lit(""))
    by_status = (combos.select(s, p, F.concat(entry, dup).alias("e"))
                 .groupBy("o_orderstatus")
                 .agg(F.array_sort(F.collect_list(F.struct(p.alias("k"), F.col("e")))).alias("es")))
    sub = F.when(s == "P", leaf(F.lit("P"))).otherwise(
        F.concat(F.lit('{"Field":"1","Table":['),
                 F.array_join(F.transform("es", lambda x: x["e"]), ","), F.lit("]}")))
    top = by_status.select(F.struct(s.alias("k"),
                                    F.concat(F.lit('{"Key":"'), s, F.lit('","Rule":'), sub, F.lit("}"))
                                    .alias("e")).alias("x"))
    return (top.agg(F.array_sort(F.collect_list("x")).alias("xs"))
            .select(F.lit(1).cast("bigint").alias("doc_id"),
                    F.concat(F.lit('{"Field":"0","Table":['),
                             F.array_join(F.transform("xs", lambda x: x["e"]), ","),
                             F.lit("]}")).alias("rules")))


def subs(spark, sf_dir) -> DataFrame:
    """V.subs: subscription messages 'group;cluster' (many repeats)."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("seq"),
                    F.concat_ws(";", (F.col("o_custkey") % 150).cast("string"),
                                F.concat(F.lit("c"), (F.substring("o_orderpriority", 1, 1).cast("int") % 5)
                                         .cast("string")))
                    .alias("value"))


def sessions(spark, sf_dir) -> DataFrame:
    """V.sessions: one replayed session per event.

    ``decision_map`` gives 5 costs ``value * (1 + i/10)``; ``load_map``
    gives thresholds 0.1/0.2/0.3 with factors 1.5/2/4 for every decision;
    the request succeeds unless the event is an error.
    """
    ev = table(spark, sf_dir, "events")
    # exact decimal products, so both engines hold the same doubles
    base = F.col("value").cast("decimal(12,2)")
    dm = F.map_from_arrays(
        F.array(*[F.lit(d) for d in P.DECISION_TYPES]),
        F.array(*[(base * F.lit(f"1.{i}").cast("decimal(2,1)")).cast("double")
                  for i in range(len(P.DECISION_TYPES))]))
    thr = F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(f).alias("factor"))
                    for t, f in ((0.1, 1.5), (0.2, 2.0), (0.3, 4.0))])
    lm = F.map_from_arrays(F.array(*[F.lit(d) for d in P.DECISION_TYPES]),
                           F.array(*[thr for _ in P.DECISION_TYPES]))
    return ev.select(
        F.col("event_id").alias("line_no"),
        (F.unix_timestamp("ts") * 1000).cast("bigint").alias("ts_ms"),
        F.unix_timestamp("ts").cast("bigint").alias("ts_s"),
        F.col("user_id").cast("string").alias("group_id"),
        F.col("event_type").alias("decision"),
        dm.alias("decision_map"), lm.alias("load_map"),
        (F.col("event_type") != "error").alias("ok"))


def result_log(spark, sf_dir) -> DataFrame:
    """V.result_log: CSV lines 'url_idx,mode,cost' with their line order."""
    ev = table(spark, sf_dir, "events")
    mode = F.when(F.col("event_type") == "error", "local").otherwise("online")
    return ev.select(F.col("event_id").alias("line_no"),
                     F.concat_ws(",", (F.col("event_id") % 2).cast("string"), mode,
                                 cost_text("value")).alias("value"))


__all__ = ["table", "updates", "messages", "assign", "clusters", "assign_feed", "requests",
           "rules", "subs", "sessions", "result_log"]
