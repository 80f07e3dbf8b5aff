"""Decontamination, WARC derivatives, the pipeline and the registered queries."""

import os
import re
import sys

import llm_cases as C
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from qoeflow.llm import decontaminate, queries, warc
from qoeflow.llm.common import materialise, scratch

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


QUESTION = ("What is the total cost if Alice buys 12 apples and Bob pays 3 dollars for every pear in town today and "
            "Alice then walks 5 km to the old market")


def leak_pairs(spark, docs, items, **kw):
    df = C.frame(spark, [(i, t, None, None, None) for i, t in docs])
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "text as words", "item_id as at")
    return {(r.doc_id, r.item_id): (r.covered, r.kind) for r in decontaminate.leaks(df, bench, **kw).collect()}


def test_reparameterised_and_plain_copies(spark):
    copy = "Some intro. " + QUESTION.replace("Alice", "Carol").replace("12", "700").replace("Bob", "Dave")
    docs = [(1, "Before this. " + QUESTION + " And after."), (2, copy.replace("5 km", "9 miles")),
            (3, copy.replace("Carol then", "Zed then")),            # one name of the item, two of the document
            (4, "nothing of that kind in these words at all"), (5, None), (6, ""), (None, QUESTION),
            (7, QUESTION.upper()), (8, " ".join(QUESTION.split()[:10])), (9, "pear " * 500), (1, "other text")]
    got = leak_pairs(spark, docs, [(1, QUESTION), (2, "too short"), (3, None), (1, QUESTION)])
    words = len(QUESTION.split())
    assert got[1, 1] == (words, "exact") and got[2, 1] == (words, "reparameterised") and got[None, 1] == (words, "exact")
    assert set(got) == {(1, 1), (2, 1), (None, 1), (7, 1)}          # 7: in other case


def test_copies_in_other_case(spark):
    short = "What does the shop in old Rome sell"               # one window
    docs = [(1, "Before this. " + QUESTION.upper()), (2, "Before this. " + QUESTION.lower()), (3, QUESTION.title()),
            (4, "Question: " + short), (5, "Alice and Bob " + QUESTION.lower()[:60])]
    got = leak_pairs(spark, docs, [(1, QUESTION), (2, short)])
    words = len(QUESTION.split())
    assert {k: kind for k, (_, kind) in got.items()} == dict.fromkeys([(1, 1), (2, 1), (3, 1), (4, 2)], "exact")
    assert got[1, 1][0] == words and got[3, 1][0] == words and got[4, 2][0] == 8


def test_near_copies_in_pieces(spark):
    words = [f"{a}{b}" for a in ("ba", "co", "di", "fe", "gu") for b in "nrstlmkp"][:39]
    spread = [*words[:10], "uh", *words[10:20], "oh", "well", *words[20:30], "so", *words[30:]]
    apart = [*words[:10], *("filler" for _ in range(60)), *words[20:30]]          # no copy: far from one another
    dense = "if Alice gave 12 pears to Bob and 7 figs to Carol then how many"
    other = dense.replace("Alice", "Mary Ann").replace("12", "1 200").replace("Bob", "Rob Roy").replace("Carol", "Jo Lee")
    bad = dense.replace("Alice", "Mary Ann") + " " + " ".join(words[:9])
    docs = [(1, " ".join(spread)), (2, " ".join(apart)), (3, "well: " + other), (4, " ".join(words[:12])), (5, bad)]
    got = leak_pairs(spark, docs, [(1, " ".join(words)), (2, dense)])
    assert got[1, 1] == (39, "exact") and got[3, 2][1] == "reparameterised" and got[3, 2][0] >= 12
    assert set(got) == {(1, 1), (3, 2), (5, 2)}
    twice = "so Alice gave pears to Bob and then the boy told Alice to count all pears"
    got = leak_pairs(spark, [(1, twice.replace("Alice", "Mary Ann", 1).replace("Alice", "Jo Lee"))], [(1, twice)])
    assert got == {} or got[1, 1][0] < len(twice.split())


def test_short_items_and_items_of_placeholders(spark):
    sums = "12 + 30 - 4 = 38 and 7 * 6 = 42"
    names = "so Alice 3 Bob 4 Carol 5 Dave 6 Erin 7"
    items = [(1, "Who wrote Hamlet?"), (2, sums), (3, names), (4, ""), (5, "seven words are one less than eight")]
    docs = [(1, "Tell me, who wrote hamlet and when"), (2, "we know: " + sums + " ."), (3, "x y " + names),
            (4, "who else wrote Hamlet"), (5, sums.replace("12", "13").replace("42", "43").replace("38", "39")),
            (6, "Seven words are one less than eight"), (7, "so Zed 9 Yan 8 Xi 7 Wu 6 Vi 5")]
    got = leak_pairs(spark, docs, items)
    assert set(got) == {(1, 1), (2, 2), (3, 3), (6, 5), (5, 2)}       # 5: the same sums with other numbers
    assert got.pop((5, 2)) == (len(sums.split()), "reparameterised")
    assert {kind for _, kind in got.values()} == {"exact"} and got[1, 1][0] == 3 and got[6, 5][0] == 7


def test_reparameterised_items_of_few_literal_words(spark):
    times = "What is 12 times 30 plus 4 minus 38 over 7 then"
    items = [(1, times), (2, "What is 12 plus 30 ?"), (3, "Who wrote Hamlet?"), (4, "What is 5 km in 3 miles and 5 km"),
             (5, "3 and 4"), (6, "Add 3 apples to 4 pears")]
    docs = [(1, "He asked: What is 99 times 3 plus 1 minus 2 over 6 then"), (2, "so what is 1 plus 2 ?"), (3, "Who wrote Macbeth?"),
            (4, "well, what is 7 km in 9 miles and 7 km"), (5, "what is 7 km in 9 miles and 8 km"),     # one slot, two values
            (6, "1 and 2"), (7, "What is 99 times 3 plus 1 minus 2 over nothing"),                      # two thirds of it
            (8, "Then Add 1 apples to 2 pears ."), (9, "add 7 apples to 7 pears"), (10, "add 7 apples to pears")]
    got = leak_pairs(spark, docs, items)
    assert set(got) == {(1, 1), (7, 1), (2, 2), (4, 4), (8, 6), (9, 6)}
    assert {kind for _, kind in got.values()} == {"reparameterised"}
    assert got[1, 1] == (len(times.split()), "reparameterised") and got[2, 2][0] == 6


def test_leaks_equal_plain_search(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")

    def norm(t):
        return re.findall(r"\w+", t.lower())
    texts = [(r.doc_id, " " + " ".join(norm(r.text)) + " ") for r in docs.collect()]
    want = {(d, b.item_id) for b in bench.collect() for d, t in texts if " " + " ".join(norm(b.text)) + " " in t}
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == want and want
    kept = {r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()}
    assert kept == {d for d, _ in texts} - {d for d, _ in want}


def test_windows_equal_plain_ones_and_no_array_between_is_a_row(spark):
    n, words = 4, decontaminate.words(F.col("text"))
    texts = ["", "one", "he met Ann Lee Poe, 3 km up 4 5 roads; (Next) we saw Bob", "a b c d e f g h", "so 1 2 3 4 5 6 \u2014 7 8"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", words.alias("words"))
    t = decontaminate._templates(rows)
    hashes = decontaminate._hashes(F.col("tpl"), F.col("low"), n, [2], [3])
    got = decontaminate._windows(t, ["id"], hashes, n, [2], [3])
    lists = {r.id: (r.tpl, r.low) for r in t.collect()}
    want, forms = [], {}
    for i, (tpl, low) in lists.items():
        def add(pos, length, kind, form):
            want.append((i, pos, length, kind))
            forms[i, pos, length, kind] = tuple(form)
        for m, k, source in ((n, 0, tpl), (2, 1, low), (3, 0, tpl)):
            for p in range(len(tpl) - m + 1):
                add(p, m, k, source[p:p + m])
        for p in range(len(tpl) - n + 1):
            if tpl[p:p + n] != low[p:p + n]:
                add(p, n, 1, low[p:p + n])
        first = [p for p, x in enumerate(tpl) if not (p and x == tpl[p - 1] and x in decontaminate.RUNS)]
        for k in range(len(first) - n + 1):
            end = [*first, len(tpl)][k + n]
            if end - first[k] > n:
                add(first[k], end - first[k], 2, [tpl[p] for p in first[k:k + n]])
    rows_got = got.collect()
    assert sorted((r.id, r.pos, r.len, r.kind) for r in rows_got) == sorted(want)
    assert {3, 4, 2} < {x[2] for x in want} and {x[3] for x in want} == {0, 1, 2}
    # equal forms have equal hashes, others have others (words alike hash alike, whatever the kind)
    by_form = {}
    for r in rows_got:
        by_form.setdefault(forms[r.id, r.pos, r.len, r.kind], set()).add(r.win)
    assert all(len(x) == 1 for x in by_form.values()) and len({min(x) for x in by_form.values()}) == len(by_form)

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", decontaminate.words(F.col("text")).alias("words"))
    whole = decontaminate._windows(docs, ["doc_id"], decontaminate._text_hashes(F.col("words"), 8, [], []), 8, [], [])
    plan = whole._jdf.queryExecution().executedPlan().toString().split("Generate ")[1]
    assert len(re.findall(r"\bProject \[", plan)) == 1 and plan.count("trim(") == 1


def test_leaks_in_empty_tables(spark):
    assert leak_pairs(spark, [], [(1, QUESTION)]) == {}
    assert leak_pairs(spark, [(1, QUESTION)], []) == {}


PAGES = [(1, "http://a/", "<html lang=\"en\"><head><title>A &amp;\n B</title><script>x<p>y</script></head><body><p>One"
          "<br>two &lt;3&gt;<!-- no <b> --><a class=\"k\" href=\"/u?x=1\">link</a></p><style>p{}</style>  end </body>"),
         (2, None, None), (3, "http://c/", ""), (None, "http://d/", "plain é text"), (1, "http://a/", "<p>x</p>"),
         (5, "http://e/", "<p>" + "long text " * 20_000 + "</p>")]


def pages(spark, data=PAGES):
    return spark.createDataFrame(data, "page_id long, url string, html string").selectExpr(
        "*", "url as block", "url as payload", "url as record_id", "url as x", "url as text").repartition(2)


def test_warc_text_and_links(spark):
    rows = warc.derive(warc.responses(pages(spark, PAGES[:1]))).collect()
    by = {r.record_type: r for r in rows}
    assert by["conversion"].block == "A &\nB\nOne\ntwo <3>link\nend"
    assert "outlink: /u?x=1\r\n" in by["metadata"].block and "title: A & B\r\n" in by["metadata"].block
    assert "source-header: Content-Type: text/html" in by["metadata"].block
    assert by["conversion"].record_id in by["metadata"].block
    assert by["conversion"].refers_to == by["metadata"].refers_to != by["conversion"].record_id


def test_warc_references_and_attributes(spark):
    import html as std
    texts = ["&copy; 2024 &middot; a&amp;copy; &nbsp;b &#233;&#xE9;&#X1F600; &unknown; &amp &#0; &#x110000; &#xD800; "
             "&#128; &#129; &#65279; &#99999999999999999999; &#x00000000041; &NotEqualTilde; & ;&&amp;&", "no reference", ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(warc.unescape(F.col("t"))).collect()]
    # the standard library also decodes names without a semicolon
    assert got == [std.unescape(t.replace("&amp ", "&amp;amp ")) for t in texts]
    page = ("<HTML class=x lang='fr'><title> B&eacute;b&eacute;&nbsp;&copy;\n </title><a  data-href='/no' href='/a?x=1&amp;y=2'>1"
            "</a><a\nid=k href = /b>2</a><a title=\"it's\" href=\"/c'&#x64;\">3</a><a href=\"/e\nf\" href='/no'>4</a><abbr href='/no'>")
    rows = warc.derive(warc.responses(pages(spark, [(1, "http://a/\r\nX: y", page)]))).collect()
    meta = next(r for r in rows if r.record_type == "metadata").block.split("\r\n")
    assert [x for x in meta if x.startswith("outlink")] == [f"outlink: {u}" for u in ("/a?x=1&y=2", "/b", "/c'd", "/ef")]
    assert "title: B\u00e9b\u00e9 \u00a9" in meta and "language: fr" in meta
    assert {r.target_uri for r in rows} == {"http://a/%0D%0AX: y"}


def test_warc_members_are_handed_few_bytes_twice(monkeypatch):
    import gzip
    import io
    import zlib
    from types import SimpleNamespace
    blocks = [f"{i} ".encode() * (1 + 1000 * (i % 50 == 0)) + bytes([i % 256]) for i in range(3000)]
    data, handed = b"".join(gzip.compress(x, mtime=0) for x in blocks), []

    class Counting:
        def __init__(self, wbits):
            self.d = zlib.decompressobj(wbits)

        def decompress(self, x):
            handed.append(len(x) - len(self.d.unused_data))
            out = self.d.decompress(x)
            handed.append(len(self.d.unused_data))
            return out

        unused_data = property(lambda self: self.d.unused_data)
        eof = property(lambda self: self.d.eof)
    monkeypatch.setattr(warc, "zlib", SimpleNamespace(decompressobj=Counting))
    assert list(warc._members(io.BytesIO(data))) == blocks
    # a member's rest of what was read is copied: all of it would be the square of the members in a chunk
    assert sum(handed) < (8 << 10) * len(blocks) + len(data)


def test_warc_blanks_and_line_ends(spark):
    import random
    import re
    rng = random.Random(3)
    parts = [" ", " ", "\n", "\n", "\t", "\x0b", "\r", "\xa0", "a", "b", "\u00e9", "\U0001f600", "$1", "\\", "\x85"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(5000)]
    texts += [" " * 50_000, "x" + " \n" * 50_000, "\xa0" * 50_000 + "\nx"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(warc.html_text(F.col("t"))).collect()]

    def want(t):
        t = re.sub("[\x20\x09\x0b-\x0d\xa0]+", " ", t)
        return re.sub(" ?\n[ \n]*", "\n", t).strip(" \n")
    assert got == [want(t) for t in texts]


def test_warc_query_equals_sql_and_reads_files(spark, tmp_path):
    import oracle_check
    data = [p for p in PAGES if p[0] is not None] + [(6, "http://f/", "&copy;&#38;&#xe9;&hellip;&none; <a href='/q'>x</a>")]
    import pyarrow.parquet as pq
    spark.createDataFrame(data, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "w"))
    pq.write_table(pq.read_table(tmp_path / "w"), tmp_path / "pages.parquet")
    res = oracle_check.compare(spark, str(tmp_path), ["op8_warc_derivatives"])
    assert res["op8_warc_derivatives"] == f"ok {2 * len(data)}"


def test_warc_files_round_trip(spark):
    records = warc.derive(warc.responses(pages(spark)))
    folder = scratch(spark, "t-warc")
    files = materialise(warc.write_warc(records, folder), "t-warc-files")
    got = warc.read_warc(spark, files, folder).collect()
    want = records.collect()
    assert len(got) == len(want) == 2 * len(PAGES)
    assert sorted((r.record_id, r.block) for r in got) == sorted((r.record_id, r.block) for r in want)
    import hashlib
    uris = {r.record_id: r.target_uri for r in want}
    for r in got:
        assert r.headers["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest()
        assert r.headers["Content-Length"] == str(len(r.block.encode()))
        assert r.target_uri == uris[r.record_id] and r.refers_to.startswith("<urn:uuid:")
    none = warc.derive(warc.responses(pages(spark, [])))
    empty = scratch(spark, "t-warc")
    files = materialise(warc.write_warc(none, empty), "t-warc-files")
    assert none.count() == files.count() == warc.read_warc(spark, files, empty).count() == 0


def run_stages(spark, docs, sf):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], sf), f"t-{name}"))
    return out


def test_pipeline_stages(spark):
    from test_llm_text import brute_components, brute_fingerprint, brute_spans
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given, good, single, clean, masked, packed = run_stages(spark, docs, SF)
    for df in (good, single, clean, masked):
        assert df.columns == docs.columns
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {r.doc_id for r in good.collect()}
    fine = [d for d, x in labels.items() if x == (1, 0)]
    assert sum(d in ids for d in fine) / len(fine) > 0.95
    prints = [(r.doc_id, brute_fingerprint(r.text)) for r in good.collect()]
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(brute_components(prints)))
    leaked = {r.doc_id for r in decontaminate.leaks(single, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - leaked
    before = {r.doc_id: r for r in clean.collect()}
    after = {r.doc_id: r for r in masked.collect()}
    assert set(before) == set(after)
    for d, r in after.items():
        assert not brute_spans(r.text) and r.n_chars == len(r.text)
        assert (r.text == before[d].text) == (not brute_spans(before[d].text))
    assert {r.doc_id for r in packed.collect()} == set(after)


def test_pipeline_on_odd_rows(spark, tmp_path):
    import shutil
    for t in ("labels", "benchmark"):
        shutil.copy(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for data in (C.rows(), []):
        df = spark.createDataFrame(data, schema).selectExpr("*", "text as fp", "1 as blob", "2 as length", "3 as meta")
        steps = run_stages(spark, df, str(tmp_path))
        assert all(s.columns == df.columns for s in steps[:-1])
        assert steps[-1].select("doc_id").distinct().count() == steps[-2].select("doc_id").distinct().count()


@pytest.mark.parametrize("name", sorted(queries.REGISTRY))
def test_query_against_its_sql(spark, name):
    import __spark_entry__ as E
    from oracle_check import compare
    assert name in E.queries()
    res = compare(spark, SF, [name], verbose=False)[name]
    assert res.startswith("ok" if name in queries.SQL else "rows-only"), res


def test_pipeline_is_registered(spark):
    import __spark_entry__ as E
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in queries.REGISTRY}
    assert "pipeline" in E.queries() and [n for n, _ in corpus_pipeline.STAGES] == [
        "quality", "near_dedup", "decontaminate", "secrets", "pack"]
    assert E.queries()["pipeline"](spark, SF).count() > 0
