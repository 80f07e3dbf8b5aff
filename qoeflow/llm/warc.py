"""WARC derivative builder: every response becomes a linked metadata record and
a plain-text conversion record.

A derived record refers to its response by ``WARC-Refers-To``, repeats the
target, date and payload digest of the source, keeps the source's HTTP headers,
and carries the digest and length of its own block.  Record ids are derived
from the source record's id, so running again gives the same ids.

Building is column work only.  ``write_warc`` writes one gzip member a record
to files that a task names after its partition and renames when complete;
``read_warc`` reads them back record by record.

Texts, titles, languages and links have all their named and numeric character
references decoded where these end in ``;`` (no-break spaces of texts and titles
become spaces); attributes may be in double, single or no quotes.

Defined results: null html is an empty payload, a null url gives records
without a target URI (line ends of a url are written %0D and %0A), a null
page_id is kept; repeated rows give repeated
records; an empty table gives no records and no files; other columns are
ignored.
"""

from __future__ import annotations

import gzip
import json
import zlib
from html.entities import html5

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Compression of files, and bytes of blocks that are read back as one batch.
LEVEL = 6
BATCH = 1 << 20
EPOCH = "1970-01-01T00:00:00Z"
CRLF = "\r\n"
#: Bytes taken from a file at once when reading back, and handed to a member:
#: what it leaves of them is copied.
CHUNK = 1 << 20
PIECE = 4 << 10

#: What turns HTML into text, in this order: patterns that mean the same to
#: Java's and RE2's regular expressions (then character references are decoded).
TAG_STEPS = (
    ("(?is)<(?:!--.*?-->|script[^>]*>.*?</script[^>]*>|style[^>]*>.*?</style[^>]*>|"
     "noscript[^>]*>.*?</noscript[^>]*>)", ""),
    ("(?i)</?(p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|tr|table|article|section|header|footer|nav|main|aside|title|head|"
     "body|html|blockquote|pre|td|th|form|figure)([\\x20\\x09-\\x0D/][^>]*)?>", "\n"),
    ("<[A-Za-z/!?][^>]*>", ""),
)
#: Runs of blanks (one x20 alone stays as it is, so that most words cost no
#: replacement; a class in front, no alternatives, is the quickest test of a
#: character); and of line ends once no blank is before one, those at the end of
#: the text without the first (``btrim`` would list every character of a text).
BLANKS = ("[\\x20\\x09\\x0B-\\x0D\\xA0](?:(?<=[\\x09\\x0B-\\x0D\\xA0])|[\\x20\\x09\\x0B-\\x0D\\xA0])"
          "[\\x20\\x09\\x0B-\\x0D\\xA0]*")
LINE_ENDS = "(?=\n)(?:\n[\\x20\n]*\\z|(\n)[\\x20\n]+)"
_WS = "\\x20\\x09-\\x0D"
_VALUE = f"[{_WS}]*=[{_WS}]*(\"[^\"]*\"|'[^']*'|[^{_WS}>\"']+)"
TITLE = "(?is)<title[^>]*>(.*?)</title"
LANG = f"(?i)<html[{_WS}](?:[^>]*?[{_WS}/\"'])??lang{_VALUE}"
LINK = f"(?i)<a[{_WS}](?:[^>]*?[{_WS}/\"'])??href{_VALUE}"


def _names() -> str:
    """The named references of HTML that end in ``;``, by first letter, as JSON."""
    out: dict[str, dict[str, str]] = {}
    for name, to in html5.items():
        if name.endswith(";"):
            out.setdefault(name[0], {})[name[:-1]] = to
    return json.dumps(out)


def _number(digits: Column, base: int, most: int) -> Column:
    """The character of a numeric reference, as HTML defines it: numbers that
    name no character give U+FFFD, 128 to 159 mean Windows-1252."""
    digits = F.ltrim(digits, F.lit("0"))
    code = F.conv(F.when((digits != "") & (F.length(digits) <= most), digits).otherwise("0"), base, 10).cast("int")
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    old = [bytes([c]).decode("cp1252", "ignore") or None for c in range(128, 160)]
    old = F.from_json(F.lit(json.dumps(old)), "array<string>")
    return (F.when((code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), "\ufffd")
            .when(code.between(128, 159), F.coalesce(F.get(old, code - 128), char))
            .when(code == 0xFEFF, "\ufeff").otherwise(char))


def unescape(text: Column) -> Column:
    """``text`` with all character references that end in ``;`` decoded once;
    unknown names stay as they are."""
    names = F.from_json(F.lit(_names()), "map<string,map<string,string>>")

    def char(ref: Column) -> Column:
        return (F.when(~ref.startswith("#"), F.try_element_at(F.try_element_at(names, F.substring(ref, 1, 1)), ref))
                .when(ref.rlike("^#[0-9]+\\z"), _number(F.substring(ref, 2, 1 << 30), 10, 7))
                .when(ref.rlike("^#[xX][0-9a-fA-F]+\\z"), _number(F.substring(ref, 3, 1 << 30), 16, 6)))
    # what follows each "&", and what there is of it before a ";"
    parts = F.transform(F.split(text, "&"), lambda p, i: F.struct(p.alias("p"), i.alias("i"), F.when(
        (i > 0) & F.contains(p, F.lit(";")), F.substring_index(p, ";", 1)).alias("ref")))
    return F.array_join(F.transform(parts, lambda x: F.when(x["i"] == 0, x["p"]).otherwise(F.coalesce(
        F.concat(char(x["ref"]), F.substr(x["p"], F.length(x["ref"]) + 2)), F.concat(F.lit("&"), x["p"])))), "")


def _attribute(value: Column) -> Column:
    """An attribute's value: quotes taken off, references decoded, line ends and
    tabs taken out and outer blanks trimmed (as of a URL)."""
    inner = F.regexp_replace(value, "(?s)^([\"'])(.*)\\1$", "$2")
    inner = F.when(F.contains(value, F.lit("&")), unescape(inner)).otherwise(inner)
    return F.btrim(F.regexp_replace(inner, "[\\x09-\\x0D]", ""))


def html_text(html: Column) -> Column:
    for pattern, to in TAG_STEPS:
        html = F.regexp_replace(html, pattern, to)
    html = F.replace(F.regexp_replace(unescape(html), BLANKS, " "), F.lit(" \n"), F.lit("\n"))
    html = F.regexp_replace(html, LINE_ENDS, "$1")
    return F.ltrim(F.rtrim(html), F.lit(" \n"))


def urn(*parts: Column) -> Column:
    """``<urn:uuid:...>`` of the md5 of some strings."""
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4),
                                                     F.substring(h, 13, 4), F.substring(h, 17, 4),
                                                     F.substring(h, 21, 12)), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of pages kept without their HTTP exchange: source_id,
    record_id, target_uri, date, headers (names and values), payload, payload_digest."""
    pages = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"),
                         F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    pages = pages.withColumn("sha", F.sha2("html", 256))       # once a page
    html = F.col("html")
    header = [F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in (
        ("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", F.octet_length(html).cast("string")))]
    return pages.select(F.col("id").alias("source_id"),
                        urn(F.lit("response"), F.coalesce(F.col("id").cast("string"), F.lit("")),
                            F.coalesce(F.col("url"), F.lit("")), F.col("sha")).alias("record_id"),
                        F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
                        .alias("target_uri"), F.lit(EPOCH).alias("date"),
                        F.array(*header).alias("headers"), html.alias("payload"),
                        F.concat(F.lit("sha256:"), F.col("sha")).alias("payload_digest"))


def derive(source: DataFrame) -> DataFrame:
    """Two rows per response: source_id, record_type, record_id, refers_to,
    target_uri, date, source_digest, content_type, content_length,
    block_digest, block."""
    links = F.regexp_extract_all("payload", F.lit(LINK), 1)
    title = F.btrim(F.regexp_replace(unescape(F.regexp_extract("payload", TITLE, 1)), "[\\x20\\x09-\\x0D\\xA0]+", " "))
    fields = F.concat(
        F.array(F.concat(F.lit("title: "), title),
                F.concat(F.lit("language: "), _attribute(F.regexp_extract("payload", LANG, 1))),
                F.concat(F.lit("text-length: "), F.octet_length("text").cast("string")),
                F.concat(F.lit("text-digest: "), F.col("text_digest")),
                F.concat(F.lit("conversion-record: "), urn(F.lit("conversion"), F.col("record_id")))),
        F.transform("headers", lambda h: F.concat(F.lit("source-header: "), h["name"], F.lit(": "), h["value"])),
        F.transform(links, lambda u: F.concat(F.lit("outlink: "), _attribute(u))))
    meta = F.concat(F.array_join(fields, CRLF), F.lit(CRLF))
    rows = source.withColumn("text", html_text(F.col("payload"))).withColumn("text_digest", digest(F.col("text")))
    rows = rows.withColumn("meta", meta).withColumn("meta_digest", digest(F.col("meta")))
    rows = rows.withColumn("x", F.explode(F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"),
                 F.col("meta").alias("block"), F.col("meta_digest").alias("digest")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"),
                 F.col("text").alias("block"), F.col("text_digest").alias("digest")))))
    return rows.select("source_id", "x.record_type", urn(F.col("x.record_type"), F.col("record_id")).alias("record_id"),
                       F.col("record_id").alias("refers_to"), "target_uri", "date",
                       F.col("payload_digest").alias("source_digest"), "x.content_type",
                       F.octet_length("x.block").cast("long").alias("content_length"),
                       F.col("x.digest").alias("block_digest"), "x.block")


def serialised(records: DataFrame) -> Column:
    """A derived record as WARC/1.1 text."""
    uri = F.when(F.col("target_uri").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), F.col("target_uri")))
    source = F.when(F.col("source_id").isNotNull(), F.concat(F.lit("Source-Id: "), F.col("source_id").cast("string")))
    lines = F.concat_ws(CRLF, F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.col("record_type")),
                        F.concat(F.lit("WARC-Record-ID: "), F.col("record_id")),
                        F.concat(F.lit("WARC-Date: "), F.col("date")), uri, source,
                        F.concat(F.lit("WARC-Refers-To: "), F.col("refers_to")),
                        F.concat(F.lit("WARC-Source-Payload-Digest: "), F.col("source_digest")),
                        F.concat(F.lit("WARC-Block-Digest: "), F.col("block_digest")),
                        F.concat(F.lit("Content-Type: "), F.col("content_type")),
                        F.concat(F.lit("Content-Length: "), F.col("content_length").cast("string")))
    return F.concat(lines, F.lit(CRLF + CRLF), F.col("block"), F.lit(CRLF + CRLF))


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Write ``derive``'s records as .warc.gz files; returns path and records
    of each (evaluate it once: it does the writing)."""
    def run(batches):
        ctx = TaskContext.get()
        fs, base = pafs.FileSystem.from_uri(folder)
        name, out, n = f"{base}/part-{ctx.partitionId():06d}.warc.gz", None, 0
        for b in batches:
            for r in b.column("record"):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{name}.tmp-{ctx.taskAttemptId()}", compression=None)
                out.write(gzip.compress(r.as_py(), LEVEL, mtime=0))
                n += 1
        if out is not None:
            out.close()
            fs.move(f"{name}.tmp-{ctx.taskAttemptId()}", name)
            yield pa.record_batch({"path": [f"{folder}/part-{ctx.partitionId():06d}.warc.gz"], "records": [n]})
    return records.select(serialised(records).cast("binary").alias("record")).mapInArrow(run, "path string, records long")


def _members(stream):
    """Decompressed gzip members of a stream, one after another."""
    d, out = zlib.decompressobj(31), []
    while data := stream.read(CHUNK):
        at = 0
        while at < len(data):
            piece = data[at:at + PIECE]
            out.append(d.decompress(piece))
            at += len(piece) - len(d.unused_data)
            if d.eof:
                yield b"".join(out)
                d, out = zlib.decompressobj(31), []


def read_warc(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """record_type, record_id, refers_to, target_uri, headers and block of
    every record of the files in ``files`` (path)."""
    def batch(rows: list[tuple[dict[str, str], str]]) -> pa.RecordBatch:
        def column(name: str) -> pa.Array:
            return pa.array([h.get(name) for h, _ in rows], pa.string())
        return pa.record_batch({
            "record_type": column("WARC-Type"), "record_id": column("WARC-Record-ID"),
            "refers_to": column("WARC-Refers-To"), "target_uri": column("WARC-Target-URI"),
            "headers": pa.array([list(h.items()) for h, _ in rows], pa.map_(pa.string(), pa.string())),
            "block": pa.array([x for _, x in rows], pa.string())})

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for path in b.column("path").to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{base}/{path.rsplit('/', 1)[1]}", compression=None) as f:
                    for member in _members(f):
                        head, _, rest = member.partition(b"\r\n\r\n")
                        h = dict(x.split(": ", 1) for x in head.decode().split(CRLF)[1:])
                        rows.append((h, rest[:int(h["Content-Length"])].decode()))
                        size += len(rest)
                        if size >= BATCH:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)
    # a range for each file: a given number of partitions is not coalesced, and no two hash alike
    return files.select("path").repartitionByRange(max(1, files.count()), "path").mapInArrow(
        run, "record_type string, record_id string, refers_to string, target_uri string, headers map<string,string>, "
             "block string")
