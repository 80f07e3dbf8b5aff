"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of every path is content-addressed: a blob is the SHA-256 of its
text.  The ledger holds one row per (blob, rule, rule version) that has been
scanned, with the spans found (possibly none).  ``update_ledger`` scans only
pairs the ledger does not have, one copy per blob however many paths share it,
and appends them; ``findings`` joins the ledger back to all paths.

Spans are code-point offsets, end exclusive, of the leftmost non-overlapping
matches of a rule, found with one ``regexp_extract_all`` (the matches) and, only
where there is a match, one ``split`` (the text between them).

Defined results: null text is the empty text (a blob without spans); rows with
null ids keep a row each; repeated rows share a blob; an empty table gives an
empty ledger; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qoeflow.llm.common import fresh

#: Copies of a hot blob are spread over so many keys when findings are joined back.
SALTS = 32


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches count if ``keep`` (a group of the match, at
    least so many characters) holds."""

    kind: str
    version: str
    pattern: str
    group: int = 0
    least: int = 1


#: A hex or access run is maximal, so a minimum length inside the pattern finds
#: what filtering every run by length would; the assign rule must skip what a
#: short value covers and is therefore filtered afterwards.
RULES = (
    Rule("assign", "1", "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
         2, 6),
    Rule("access", "1", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "1", "[0-9a-f]{24,}"),
)

LEDGER = "blob string, kind string, version string, spans array<struct<start:bigint,stop:bigint>>"


def blob_id(text_col: str) -> Column:
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)


def _spans(text: Column, matches: Column, rule: Rule) -> Column:
    """Offsets of ``matches`` in ``text``: lengths of the gaps and matches
    before each of them."""
    gaps = F.split(text, rule.pattern, -1)
    ends = F.aggregate(
        F.arrays_zip(F.slice(gaps, 1, F.size(matches)).alias("gap"), matches.alias("hit")),
        F.struct(F.lit(0).cast("bigint").alias("at"),
                 F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("at"),
            F.when(F.length(F.regexp_extract(x["hit"], rule.pattern, rule.group)) >= rule.least,
                   F.concat(acc["out"], F.array(F.struct(
                       (acc["at"] + F.length(x["gap"])).alias("start"),
                       (acc["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("stop")))))
            .otherwise(acc["out"]).alias("out")))
    return ends["out"]


def scan(blobs: DataFrame, rules=RULES, text_col: str = "text") -> DataFrame:
    """Ledger rows of every (blob, rule) pair of ``blobs`` (blob, text, and
    ``known``: the kinds that need no scan)."""
    unseen = lambda r: ~F.array_contains("known", r.kind)
    found = blobs.select("blob", "known", F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                         *[F.when(unseen(r), F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")),
                                                                  F.lit(r.pattern), 0))
                           .alias(f"m{i}") for i, r in enumerate(rules)])
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    rows = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"),
                              F.when(F.size(f"m{i}") > 0, _spans(F.col("text"), F.col(f"m{i}"), r))
                              .otherwise(none).alias("spans"), unseen(r).alias("new")) for i, r in enumerate(rules)])
    return (found.select("blob", F.explode(rows).alias("x")).filter("x.new")
            .select("blob", "x.kind", "x.version", "x.spans"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(path)


def update_ledger(spark: SparkSession, versions: DataFrame, path: str, id_col: str = "doc_id",
                  text_col: str = "text", rules=RULES, new: bool = False) -> DataFrame:
    """Scan what the ledger at ``path`` has not seen (all, if it is ``new``)
    and append it; returns the ledger."""
    v = versions.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), blob_id(text_col).alias("blob"))
    todo = v.groupBy("blob").agg(F.min(F.xxhash64("id")).alias("pick"))
    if new:
        todo = todo.withColumn("known", F.array().cast("array<string>"))
    else:
        # pairs the ledger has: a blob all of whose rules are known goes, of the
        # others only the rules that are not are scanned
        current = None
        for r in rules:
            ok = (F.col("kind") == r.kind) & (F.col("version") == r.version)
            current = ok if current is None else current | ok
        seen = read_ledger(spark, path).filter(current).select("blob", "kind")
        whole = seen.groupBy("blob").agg(F.collect_set("kind").alias("known"))
        todo = todo.join(whole.filter(F.size("known") == len(rules)), "blob", "left_anti")
        todo = (todo.join(whole, "blob", "left")
                .withColumn("known", F.coalesce("known", F.array().cast("array<string>"))))
    # one copy of each blob: the texts move once, keyed by row and not by
    # blob, so that many copies of a blob are no hot key
    texts = (v.withColumn("pick", F.xxhash64("id")).join(todo, ["blob", "pick"])
             .dropDuplicates(["blob", "pick"]).select("blob", "known", "text"))
    scan(texts, rules).write.mode("append").parquet(path)
    return read_ledger(spark, path)


def findings(versions: DataFrame, ledger: DataFrame, rules=RULES, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """id, blob and spans (kind, start, stop by start, then rule order) of
    every row of ``versions``."""
    order = {r.kind: i for i, r in enumerate(rules)}
    current = None
    for r in rules:
        ok = (F.col("kind") == r.kind) & (F.col("version") == r.version)
        current = ok if current is None else current | ok
    rank = F.create_map(*[x for k, i in order.items() for x in (F.lit(k), F.lit(i))])
    hits = (ledger.filter(current).filter(F.size("spans") > 0)
            .select("blob", "kind", F.explode("spans").alias("s"))
            .groupBy("blob").agg(F.sort_array(F.collect_list(F.struct(
                F.col("s.start").alias("start"), rank[F.col("kind")].alias("rank"), F.col("s.stop").alias("stop"),
                F.col("kind").alias("kind")))).alias("spans")))
    # a blob may be a third of all rows: its copies join salted copies of its one row
    hits = hits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = versions.select(F.col(id_col).alias("id"), blob_id(text_col).alias("blob"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    none = F.array().cast("array<struct<start:bigint,rank:int,stop:bigint,kind:string>>")
    return (rows.join(hits, ["blob", "salt"], "left")
            .select("id", "blob", F.coalesce("spans", none).alias("spans")))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """``text`` with every stretch covered by spans replaced by ``mark``
    (``spans`` sorted by start; touching and nested ones are one stretch)."""
    done = F.aggregate(
        spans, F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] < acc["at"], F.struct(
            F.greatest(acc["at"], s["stop"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(
                s["stop"].alias("at"),
                F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                         F.lit(mark)).alias("out"))))
    return F.when(F.size(spans) > 0, F.concat(done["out"], F.substr(text, (done["at"] + 1).cast("int")))).otherwise(text)


def mask(docs: DataFrame, ledger: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text",
         mark: str = "[secret]") -> DataFrame:
    """``docs`` with what the ledger found in their texts replaced by ``mark``;
    texts without findings and all other columns stay as they are."""
    found = findings(docs, ledger, rules, id_col, text_col).filter(F.size("spans") > 0)
    b, s, salt = (fresh(docs, c) for c in ("blob_key", "spans_found", "blob_salt"))
    spans = found.select(F.col("blob").alias(b), F.col("spans").alias(s)).dropDuplicates([b])
    # as in ``findings``, copies of one blob are spread over salted keys
    spans = spans.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keyed = (docs.withColumn(b, blob_id(text_col))
             .withColumn(salt, F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int")))
    hidden = F.when(F.col(s).isNull(), F.col(text_col)).otherwise(redact(F.col(text_col), F.col(s), mark))
    return keyed.join(spans, [b, salt], "left").withColumn(text_col, hidden).select(*docs.columns)
