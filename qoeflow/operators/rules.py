"""Grouping rules.

The reference compiles a recursive rule document into nested ``if``s; the
last assignment executed wins.  Here the document is flattened (recursive
CTE over VARIANT) into one row per leaf: its tree path (pre-order
position), its (field, key) conditions and its group.  Matching a session
then means: among the leaves whose conditions all hold, take the one with
the greatest path.

Matching walks down the tree, one equi-join per level, however many rules and
condition fields the document has.  Nodes are the distinct condition prefixes of
the leaves; an edge (node, field, key) leads to a child and carries the child's
best leaf.  A session stands at a node and joins on (node, its value at the
field that the node tests); it keeps the greatest path it has met.  While every
node tests one field (the usual document), a session is one row throughout:
neither multiplied nor regrouped.  Only where equal prefixes go on with
different fields is a session several rows, one for each live (node, field),
and regrouped at the end.  Edge tables are written once, so Spark knows their
size and broadcasts the small ones.  No cross join.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLATTEN_SQL = """
WITH RECURSIVE r(doc_id, node, path, conds) AS (
  SELECT doc_id, parse_json({rules}), CAST(array() AS array<int>),
         CAST(array() AS array<struct<f:int,k:string>>)
  FROM {src}
  UNION ALL
  SELECT r.doc_id, variant_get(e.value, '$.Rule'), concat(r.path, array(e.pos)),
         concat(r.conds, array(named_struct('f', variant_get(r.node, '$.Field', 'int'),
                                            'k', variant_get(e.value, '$.Key', 'string'))))
  FROM r, LATERAL variant_explode(variant_get(r.node, '$.Table')) e
  WHERE variant_get(r.node, '$.Field', 'string') IS NOT NULL
)
SELECT doc_id, path, conds, variant_get(node, '$.GroupName', 'string') AS group_id
FROM r WHERE variant_get(node, '$.GroupName', 'string') IS NOT NULL
"""


def flatten_rules(rules: DataFrame, col: str = "rules", materialize: bool = True) -> DataFrame:
    """Rule documents (doc_id, json text) -> one row per leaf.

    A recursive CTE re-runs its iterations every time the plan executes;
    the leaf table is small and read several times by ``match_groups``,
    so it is written once below the shared folder (unless
    ``materialize=False``), which also gives Spark its size.  Spark's own
    recursion limits (``spark.sql.cteRecursionLevelLimit`` and
    ``...RowLimit``) raise on documents that are deeper or larger.
    """
    from qoeflow.session import scratch_path
    spark = rules.sparkSession
    name = f"_qoe_rules_{uuid.uuid4().hex[:12]}"
    rules.createOrReplaceTempView(name)
    leaves = spark.sql(FLATTEN_SQL.format(rules=col, src=name))
    if materialize:
        path = scratch_path(spark, "rules")
        leaves.write.parquet(path)
        leaves = spark.read.schema(leaves.schema).parquet(path)
    return leaves


def rule_edges(leaves: DataFrame) -> DataFrame:
    """The tree's edges, written once: level, node, f, k, child, leaf (the
    child's best (path, group)) and fields (those that the child tests).  The
    root is the child of an edge at level -1."""
    from qoeflow.session import write_once
    node = lambda n: F.md5(F.to_json(F.slice("conds", 1, n)))
    none = F.struct(F.lit(None).cast("int").alias("f"), F.lit(None).cast("string").alias("k"))
    # the leaves' steps, with one before the first that leads to the root
    steps = leaves.select("path", "group_id", "conds", F.posexplode(F.concat(F.array(none), "conds")).alias("n", "c"))
    steps = steps.select((F.col("n") - 1).alias("level"), F.when(F.col("n") > 0, node(F.col("n") - 1)).alias("node"),
                         F.col("c.f").alias("f"), F.col("c.k").alias("k"), node(F.col("n")).alias("child"),
                         F.when(F.size("conds") == F.col("n"), F.struct("path", F.col("group_id").alias("g"))).alias("leaf"),
                         F.get(F.col("conds"), F.col("n"))["f"].alias("next"))
    return write_once(steps.groupBy("level", "node", "f", "k", "child").agg(
        F.max("leaf").alias("leaf"), F.array_sort(F.collect_set("next")).alias("fields")), "rule-edges")


def match_groups(sessions: DataFrame, leaves: DataFrame, default, features: str = "features") -> DataFrame:
    """Group of each session = leaf with the greatest path among
    those whose conditions all hold; else ``default`` (a Column).

    One equi-join per level of the tree (``rule_edges``).  Repeated sessions
    stay repeated.  Only the tree's depth, the root's fields and the root leaf
    reach the driver.
    """
    edges = rule_edges(leaves)
    at_root = F.when(F.col("level") == -1, F.struct("child", "fields", "leaf"))
    tree = edges.agg(F.max("level").alias("depth"), F.max(F.size("fields")).alias("most"), F.max(at_root).alias("root")).first()
    keep = [c for c in sessions.columns if c not in ("group_id", "matched")]
    root = tree["root"]
    out = sessions.drop("group_id", "matched").withColumn("_best", F.lit(None).cast("struct<path:array<int>,g:string>"))
    if root and root["fields"]:
        walk = _walk_many if tree["most"] > 1 else _walk
        out = walk(out, edges, tree["depth"] + 1, root["child"], root["fields"], features)
    # a path below the root is greater than the root's empty one
    top = root["leaf"]["g"] if root and root["leaf"] else None
    rule = F.coalesce(F.col("_best.g"), F.lit(top).cast("string"))
    return (out.withColumn("matched", rule.isNotNull()).withColumn("group_id", F.coalesce(rule, default))
               .select(*keep, "matched", "group_id"))


def _level(edges: DataFrame, level: int) -> DataFrame:
    return edges.where(F.col("level") == level).select(
        F.col("node").alias("_node"), F.col("f").alias("_f"), F.col("k").alias("_v"), F.col("child").alias("_child"),
        F.col("leaf").alias("_leaf"), F.col("fields").alias("_fields"))


def _step(out: DataFrame, edges: DataFrame, level: int, value) -> DataFrame:
    """Rows at (``_node``, ``_f``) moved to the child that their value leads to;
    without one, to no node."""
    out = out.withColumn("_v", value).join(_level(edges, level), ["_node", "_f", "_v"], "left")
    return out.withColumn("_best", F.greatest("_best", "_leaf")).withColumn("_node", F.col("_child"))


def _walk(sessions: DataFrame, edges: DataFrame, depth: int, root: str, fields: list[int], features: str) -> DataFrame:
    """``sessions`` with ``_best`` found, where every node tests one field."""
    out = sessions.withColumn("_node", F.lit(root)).withColumn("_f", F.lit(fields[0]))
    for level in range(depth):
        out = _step(out, edges, level, F.get(F.col(features), F.col("_f")))
        out = out.withColumn("_f", F.get(F.col("_fields"), F.lit(0))).drop("_v", "_child", "_leaf", "_fields")
    return out


def _walk_many(sessions: DataFrame, edges: DataFrame, depth: int, root: str, fields: list[int],
               features: str) -> DataFrame:
    """``sessions`` with ``_best`` found, a row for each live (node, field) on the way."""
    from qoeflow.session import write_once
    # written once: rows are met again by number
    base = write_once(sessions.withColumn("_row", F.monotonically_increasing_id()), "rule-rows")
    out = base.select("_row", F.col(features).alias("_x"), "_best", F.lit(root).alias("_node"),
                      F.explode(F.array(*map(F.lit, fields))).alias("_f"))
    for level in range(depth):
        out = _step(out, edges, level, F.get("_x", F.col("_f"))).select(
            "_row", "_x", "_best", "_node", F.explode_outer("_fields").alias("_f"))
    return base.drop("_best").join(out.groupBy("_row").agg(F.max("_best").alias("_best")), "_row")
