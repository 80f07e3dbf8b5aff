"""S3/K1: trace lines.

A trace line is ``features \\t DecisionMap \\t d,cost \\t ... LoadMap \\t
d,thr;factor;thr;factor \\t ...``; the first feature is the time in ms.
Text has no row order, so every reader carries an explicit line number
(``line_no``), taken from the writer or from the file position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qoeflow.operators.ordinals import ordinal_within


def trace_text(sessions: DataFrame, features: list[str]) -> DataFrame:
    """V.sessions -> (line_no, value) trace text (costs as decimal text)."""
    dm = F.map_entries("decision_map")
    dtxt = F.array_join(F.transform(dm, lambda e: F.concat(
        e["key"], F.lit(","), e["value"].cast("decimal(12,3)").cast("string"))), "\t")
    lm = F.map_entries("load_map")
    ltxt = F.array_join(F.transform(lm, lambda e: F.concat(
        e["key"], F.lit(","), F.array_join(F.flatten(F.transform(e["value"], lambda p: F.array(
            p["threshold"].cast("string"), p["factor"].cast("string")))), ";"))), "\t")
    feat = F.concat_ws("\t", *[F.col(c).cast("string") for c in features])
    return sessions.select("line_no", F.concat_ws("\t", feat, F.lit("DecisionMap"), dtxt,
                                                  F.lit("LoadMap"), ltxt).alias("value"))


def _strip(c):
    """Python ``str.strip()``: whitespace, not only spaces."""
    return F.btrim(c, F.lit(" \t\n\r\x0b\x0c"))


def _keys(entries_text):
    """Keys of tab-separated 'key,value' entries (native regex, no lambda)."""
    return F.regexp_extract_all(entries_text, F.lit("(?:^|\t)([^,\t]*),"), 1)


def _values(entries_text):
    return F.regexp_extract_all(entries_text, F.lit(",([^\t]*)"), 1)


# Duplicate keys keep the last value (Python dict semantics; Spark maps
# reject duplicate keys): on the reversed entries the first occurrence is
# the last one, and ``array_distinct`` keeps first occurrences.


PAIR_TYPE = "array<struct<threshold:double,factor:double>>"


def read_traces(lines: DataFrame, value: str = "value") -> DataFrame:
    """S3: parse trace text into features, decision_map and load_map.

    Entry splitting uses native regular-expression and array functions.
    The intermediate arrays are separate projections: an outer expression
    referenced inside a lambda would otherwise be re-evaluated on every
    lambda call."""
    parts = F.split(F.col(value), "DecisionMap", 2)
    feature = F.get(parts, 0)
    info = F.split(_strip(F.get(parts, 1)), "LoadMap", 2)
    step1 = lines.select("*", feature.alias("_f"), _strip(F.get(info, 0)).alias("_d"),
                         _strip(F.get(info, 1)).alias("_l"))
    step2 = step1.select(
        "*", F.reverse(_keys(F.col("_d"))).alias("_dk"),
        F.reverse(_values(F.col("_d"))).try_cast("array<double>").alias("_dv"),
        F.reverse(_keys(F.col("_l"))).alias("_lk"),
        F.reverse(_values(F.col("_l"))).alias("_lv"))
    step3 = step2.select("*", F.array_distinct("_dk").alias("_ddk"), F.array_distinct("_lk").alias("_ldk"))
    pair = lambda v: F.arrays_zip(
        F.regexp_extract_all(v, F.lit("([^;]+);([^;]+)"), 1).try_cast("array<double>"),
        F.regexp_extract_all(v, F.lit("([^;]+);([^;]+)"), 2).try_cast("array<double>")).cast(PAIR_TYPE)
    out = step3.select(
        *[c for c in lines.columns],
        F.split(F.regexp_replace("_f", "\t$", ""), "\t").alias("features"),
        F.floor(F.substring_index("_f", "\t", 1).try_cast("bigint") / 1000).cast("bigint").alias("ts_s"),
        F.map_from_arrays(F.reverse("_ddk"), F.reverse(F.transform(
            "_ddk", lambda k: F.get(F.col("_dv"), F.array_position("_dk", k).cast("int") - 1))))
        .alias("decision_map"),
        F.map_from_arrays(F.reverse("_ldk"), F.reverse(F.transform(
            "_ldk", lambda k: pair(F.get(F.col("_lv"), F.array_position("_lk", k).cast("int") - 1)))))
        .alias("load_map"))
    return out


def sort_traces(lines: DataFrame, value: str = "value", numeric: bool = False,
                line_no: str = "line_no", keep: bool = True) -> DataFrame:
    """K1: order by the first tab field -- as text by default, like the
    reference tool (so '999' sorts after '1000'), numerically on request --
    ties in line order.  Adds ``sort_pos`` (a distributed range sort plus
    offsets, no single-task window).  Numbering writes the rows once: with
    ``keep=False`` only the line numbers come back, and no text is written."""
    key = F.substring_index(F.col(value), "\t", 1)
    key = key.try_cast("bigint") if numeric else key
    k = lines.withColumn("_key", key) if keep else lines.select(line_no, key.alias("_key"))
    return ordinal_within(k, [], ["_key", line_no], "sort_pos").drop("_key")


def read_trace_files(spark, path: str) -> DataFrame:
    """S3 from files: trace lines with their line numbers, parsed."""
    from qoeflow.sources.lines import read_lines
    return read_traces(read_lines(spark, path))
