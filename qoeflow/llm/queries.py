"""The ``opN_<name>`` queries over the tables of a data folder and, where SQL
can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qoeflow.llm import decontaminate, hnsw, quality, secret_scan, warc
from qoeflow.llm.common import materialise, scratch, table
from qoeflow.llm.fim import fill_in_middle
from qoeflow.llm.language_id import language_id
from qoeflow.llm.lexical import search as lexical_search
from qoeflow.llm.packing import pack
from qoeflow.llm.simhash import simhash_components
from qoeflow.llm.substring_dedup import substring_dedup
from qoeflow.llm.token_counts import token_counts
from qoeflow.llm.token_files import token_round_trip

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        REGISTRY[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


@_query("""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'),
                                      lambda x: x <> '') AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS key
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w)),
least AS (SELECT key, min(doc_id) AS lo FROM win GROUP BY key),
hit AS (SELECT doc_id, list(i) AS starts FROM win JOIN least USING (key) WHERE lo < doc_id GROUP BY doc_id),
gone AS (SELECT doc_id, list_distinct(flatten(list_transform(starts, lambda i: range(i, i + 13)))) AS pos FROM hit),
kept AS (SELECT w.doc_id, len(words) AS n_words, coalesce(len(pos), 0) AS n_removed,
                CASE WHEN pos IS NULL THEN words ELSE
                  list_transform(list_filter(list_zip(words, range(1, len(words) + 1)),
                                             lambda z: NOT list_contains(pos, z[2])), lambda z: z[1]) END AS kept
         FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, n_removed::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM kept""")
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


@_query()
def op6_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents")).drop("row_key")


_ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"\']?\\x20*[:=]\\x20*[\"\']?([A-Za-z0-9+/_.=-]+)"


def _sql_spans(kind: str, pattern: str, group: int, least: int) -> str:
    """Spans of one rule: running lengths of the gaps and matches."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS kind, beg, beg + length(hit) AS fin FROM (
      SELECT doc_id, hit, (sum(length(gap)) OVER w + coalesce(sum(length(hit)) OVER (
               PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS beg
      FROM (SELECT doc_id, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS hit,
                   unnest(gaps[1:len(hits)]) AS gap
            FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS hits, regexp_split_to_array(t, '{p}') AS gaps
                  FROM docs)
            WHERE len(hits) > 0)
      WINDOW w AS (PARTITION BY doc_id ORDER BY i))
    WHERE length(regexp_extract(hit, '{p}', {group})) >= {least}"""


@_query(f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({_sql_spans("assign", _ASSIGN, 2, 6)}
      UNION ALL {_sql_spans("access", "AKIA[A-Z0-9]+", 0, 20)}
      UNION ALL {_sql_spans("hex", "[0-9a-f]+", 0, 24)}),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
             count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(kind || ':' || beg || ':' || fin, ',' ORDER BY beg,
                        CASE kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 ELSE 2 END) AS spans
      FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN g USING (doc_id)""")
def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # the ledger grows in steps: half of the documents under an older version of
    # one rule, then all of them; the second step scans what the first has not seen
    path = scratch(spark, "ledger")
    older = [replace(r, version="0") if r.kind == "access" else r for r in secret_scan.RULES]
    half = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    secret_scan.update_ledger(spark, half, path, rules=older, new=True)
    ledger = secret_scan.update_ledger(spark, docs, path)
    found = secret_scan.findings(docs, ledger)

    def n(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    spans = secret_scan.span_list(F.col("spans"))
    return found.select(F.col("id").alias("doc_id"), n("assign"), n("access"), n("hex"),
                        F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def _sql_quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_OUTER = _sql_quoted(decontaminate._OUTER)
_UNITS = ", ".join(_sql_quoted(u) for u in decontaminate.UNITS)
_HOLDERS = "('<num>', '<qty>', '<unit>', '<name>')"


def _sql_templates(name: str, source: str, key: str, out: str) -> str:
    """Rows of ``source`` with words w, bodies b and template words t."""
    num, qty = _sql_quoted(decontaminate._NUMBER), _sql_quoted(decontaminate._QUANTITY)
    plain = (f"CASE WHEN lower(b[i]) IN ({_UNITS}) AND i > 1 AND regexp_matches(b[i - 1], {num}) "
             f"THEN '<unit>' ELSE lower(b[i]) END")
    first = "substr(b[i], 1, 1)"
    return f"""{name}0 AS (SELECT DISTINCT {key} AS id, text FROM {source}),
{name}1 AS (SELECT row_number() OVER () AS {out}, id, list_filter(regexp_split_to_array(coalesce(text, ''),
              '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {name}0),
{name}2 AS (SELECT *, list_transform(w, lambda x: trim(x, {_OUTER})) AS b FROM {name}1),
{name} AS (SELECT *, list_transform(range(1, len(w) + 1), lambda i:
    CASE WHEN b[i] >= 'a' AND b[i] < '{{' THEN {plain}
         WHEN b[i] = '' THEN w[i]
         WHEN regexp_matches(b[i], {num}) THEN '<num>'
         WHEN regexp_matches(b[i], {qty}) THEN '<qty>'
         WHEN upper({first}) = {first} AND lower({first}) <> {first} AND i > 1
              AND NOT regexp_matches(w[i - 1], '[.!?]["''”’)]*$') THEN '<name>'
         ELSE {plain} END) AS t FROM {name}2)"""


_N = decontaminate.N


@_query(f"""
WITH {_sql_templates("d", "documents", "doc_id", "rk")},
{_sql_templates("q", "benchmark", "item_id", "ik")},
dw AS (SELECT rk, pos, array_to_string(t[pos + 1:pos + {_N}], chr(1)) AS win
       FROM (SELECT rk, t, unnest(range(0, len(t) - {_N - 1})) AS pos FROM d)),
qw AS (SELECT ik, pos AS at_pos, array_to_string(t[pos + 1:pos + {_N}], chr(1)) AS win
       FROM (SELECT ik, t, unnest(range(0, len(t) - {_N - 1})) AS pos FROM q)
       WHERE len(list_filter(t[pos + 1:pos + {_N}], lambda x: x NOT IN {_HOLDERS})) >= {decontaminate.LITERALS}),
met AS (SELECT rk, ik, pos - at_pos AS shift,
               list_distinct(flatten(list(range(at_pos, at_pos + {_N})))) AS p
        FROM dw JOIN qw USING (win) GROUP BY ALL),
pair AS (SELECT rk, ik, d.id AS doc_id, q.id AS item_id, len(q.w) AS item_words, len(p) AS covered,
                list_transform(p, lambda x: {{'it': q.t[x + 1], 'dt': d.t[x + shift + 1],
                                              'iv': q.b[x + 1], 'dv': d.b[x + shift + 1]}}) AS slots
         FROM met JOIN d USING (rk) JOIN q USING (ik)),
held AS (SELECT *, list_filter(slots, lambda s: s.it IN {_HOLDERS}) AS h FROM pair
         WHERE len(list_filter(slots, lambda s: s.it <> s.dt)) = 0),
judged AS (SELECT rk, ik, doc_id, item_id, item_words, covered,
                  len(list_filter(h, lambda s: s.iv <> s.dv)) = 0 AS exact
           FROM held
           WHERE len(list_distinct(list_transform(h, lambda s: {{'a': s.iv, 'b': s.dv}})))
                 = len(list_distinct(list_transform(h, lambda s: s.iv)))
             AND (covered >= {decontaminate.COVERAGE} * item_words OR covered >= {decontaminate.LONG_RUN})),
best AS (SELECT rk, ik, doc_id, item_id, item_words, max({{'c': covered, 'e': exact}}) AS x
         FROM judged GROUP BY ALL)
SELECT doc_id, item_id, item_words::INTEGER AS item_words, x.c::INTEGER AS covered, x.c / item_words AS coverage,
       CASE WHEN x.e THEN 'exact' ELSE 'reparameterised' END AS kind FROM best""")
def op7_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_key")


@_query()
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


@_query()
def op9_ranked_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_round_trip(table(spark, sf_dir, "documents"))


@_query()
def op10_byte_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


@_query()
def op1_hnsw_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.search(table(spark, sf_dir, "embeddings"), every=20, k=20)


@_query()
def op5_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scores(docs, quality.train(docs, table(spark, sf_dir, "labels")))


#: The named references that the tables hold, and some common others; the SQL's own list.
_SQL_NAMES = (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", "\""), ("apos", "'"), ("nbsp", "\u00a0"),
              ("copy", "\u00a9"), ("reg", "\u00ae"), ("trade", "\u2122"), ("middot", "\u00b7"), ("bull", "\u2022"),
              ("hellip", "\u2026"), ("ndash", "\u2013"), ("mdash", "\u2014"), ("lsquo", "\u2018"),
              ("rsquo", "\u2019"), ("ldquo", "\u201c"), ("rdquo", "\u201d"), ("euro", "\u20ac"), ("pound", "\u00a3"),
              ("deg", "\u00b0"), ("eacute", "\u00e9"), ("egrave", "\u00e8"), ("agrave", "\u00e0"))


def _sql_unescape(x: str) -> str:
    ref = "regexp_extract(p, '^(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);', 1)"
    named = " ".join(f"WHEN '{name}' THEN {_sql_quoted(to)}" for name, to in _SQL_NAMES)
    char = (f"CASE WHEN {ref} = '' THEN NULL WHEN starts_with(lower({ref}), '#x') "
            f"THEN chr(('0x' || substr({ref}, 3))::INTEGER) WHEN starts_with({ref}, '#') "
            f"THEN chr(substr({ref}, 2)::INTEGER) ELSE CASE {ref} {named} END END")
    return (f"(string_split({x}, '&')[1] || coalesce(array_to_string(list_transform(string_split({x}, '&')[2:], "
            f"lambda p: coalesce({char} || substr(p, length({ref}) + 2), '&' || p)), ''), ''))")


def _sql_attribute(x: str) -> str:
    inner = f"CASE WHEN substr({x}, 1, 1) IN (chr(34), chr(39)) THEN substr({x}, 2, length({x}) - 2) ELSE {x} END"
    return f"trim(regexp_replace({_sql_unescape(inner)}, '[\\x09-\\x0D]', '', 'g'), ' ')"


def _sql_text(html: str) -> str:
    def sub(pattern: str, to: str) -> str:
        p = pattern.replace("'", "''").replace("\n", "\\n")
        return f"regexp_replace({html}, '{p}', {'chr(10)' if to == chr(10) else _sql_quoted(to)}, 'g')"

    for pattern, to in warc.TAG_STEPS:
        html = sub(pattern, to)
    html = _sql_unescape(html)
    for pattern, to in (("[\\x20\\x09\\x0B-\\x0D\\xA0]+", " "), (" ?\n[\\x20\n]*", "\n")):
        html = sub(pattern, to)
    return f"trim({html}, ' ' || chr(10))"


def _sql_urn(*parts: str) -> str:
    h = f"md5(concat_ws('|', {', '.join(parts)}))"
    cut = " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"'<urn:uuid:' || {cut} || '>'"


@_query(f"""
WITH r AS (SELECT page_id, replace(replace(url, chr(13), '%0D'), chr(10), '%0A') AS url, coalesce(html, '') AS p,
                  {_sql_urn("'response'", "coalesce(page_id::VARCHAR, '')", "coalesce(url, '')",
                            "sha256(coalesce(html, ''))")} AS rid FROM pages),
t AS (SELECT *, {_sql_text("p")} AS txt FROM r),
b AS (SELECT page_id, url, p, rid, 'conversion' AS record_type, 'text/plain; charset=utf-8' AS content_type,
             txt AS block FROM t
      UNION ALL
      SELECT page_id, url, p, rid, 'metadata', 'application/warc-fields', array_to_string(list_concat(
          ['title: ' || trim(regexp_replace({_sql_unescape(f"regexp_extract(p, '{warc.TITLE}', 1)")},
                                             '[\\x20\\x09-\\x0D\\xA0]+', ' ', 'g'), ' '),
           'language: ' || {_sql_attribute(f"regexp_extract(p, {_sql_quoted(warc.LANG)}, 1)")}, 'text-length: ' || strlen(txt),
           'text-digest: sha256:' || sha256(txt), 'conversion-record: ' || {_sql_urn("'conversion'", "rid")},
           'source-header: Content-Type: text/html; charset=utf-8', 'source-header: Content-Length: ' || strlen(p)],
          list_transform(regexp_extract_all(p, {_sql_quoted(warc.LINK)}, 1),
                         lambda u: 'outlink: ' || {_sql_attribute("u")})),
          chr(13) || chr(10)) || chr(13) || chr(10) FROM t)
SELECT page_id, record_type, {_sql_urn("record_type", "rid")} AS record_id, rid AS refers_to, url AS target_uri,
       '{warc.EPOCH}' AS date, 'sha256:' || sha256(p) AS source_digest, content_type,
       strlen(block)::BIGINT AS content_length, 'sha256:' || sha256(block) AS block_digest, block
FROM b""")
def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    # written as WARC files and read back; what the query returns is from the files
    folder = scratch(spark, "warc")
    records = warc.derive(warc.responses(table(spark, sf_dir, "pages")))
    files = materialise(warc.write_warc(records, folder), "warc-files")
    h = F.col("headers")
    return warc.read_warc(spark, files, folder).select(
        h["Source-Id"].cast("long").alias("page_id"), "record_type", "record_id", "refers_to", "target_uri",
        h["WARC-Date"].alias("date"), h["WARC-Source-Payload-Digest"].alias("source_digest"),
        h["Content-Type"].alias("content_type"), h["Content-Length"].cast("long").alias("content_length"),
        h["WARC-Block-Digest"].alias("block_digest"), "block")


@_query()
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


@_query("""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS hx FROM documents),
l AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS ls,
             ('0x' || substr(hx, 1, 8))::BIGINT AS h1, ('0x' || substr(hx, 9, 8))::BIGINT AS h2,
             ('0x' || substr(hx, 17, 8))::BIGINT AS h3, ('0x' || substr(hx, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, len(ls) AS n, least(h1 % (len(ls) + 1), h2 % (len(ls) + 1)) AS a,
             greatest(h1 % (len(ls) + 1), h2 % (len(ls) + 1)) AS z,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100
                  THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM l),
p AS (SELECT *, coalesce(array_to_string(ls[1:a], ''), '') AS pre, coalesce(array_to_string(ls[a + 1:z], ''), '') AS mid,
             coalesce(array_to_string(ls[z + 1:n], ''), '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM p""")
def op12_fim_chunk_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(table(spark, sf_dir, "documents"))


_SQL_TERMS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
              "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')")


@_query(f"""
WITH d AS (SELECT doc_id, {_SQL_TERMS} AS ts FROM documents),
size AS (SELECT doc_id, len(ts) AS n FROM d WHERE len(ts) > 0),
total AS (SELECT count(*) AS all_docs, sum(n)::BIGINT AS all_terms FROM size),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM d) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest({_SQL_TERMS}) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * all_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
      FROM tf, total WHERE term IN (SELECT term FROM q) GROUP BY term, all_docs),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * all_docs) // all_terms))))::BIGINT
             AS score
      FROM q JOIN tf USING (term) JOIN w USING (term) JOIN size USING (doc_id), total GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
WHERE rank <= 50""")
def op13_bitsliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
