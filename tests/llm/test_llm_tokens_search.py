"""Token counts, fill-in-the-middle and ranked search against the library and
brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import llm_cases as C
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from qoeflow.llm import fim, lexical, token_counts
from qoeflow.llm.tokens import default_path

TOK = Tokenizer.from_file(default_path())


def library_count(text):
    return len(TOK.encode(text or "", add_special_tokens=False).ids)


def column(texts):
    raw = [t.encode("utf-8", "replace") for t in texts]
    return (np.frombuffer(b"".join(raw) + b" ", np.uint8),
            np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))


# ------------------------------------------------------------- token counts
def test_token_counts_equal_the_library(spark):
    got = C.plain(token_counts.token_counts(C.frame(spark)), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = sorted(((i, len((t or "").encode()), n := library_count(t), n > 2048) for i, t, *_ in C.rows()), key=repr)
    assert got == want and any(r[3] for r in got)


ALPHABET = "abcdefgstmrelv''   .,!?019 \n\tABÉéßñ日本語😀Жж́ \xa0½²ⅣİΣσς#<|"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(ALPHABET), max_size=40), min_size=1, max_size=8))
def test_counts_of_any_characters(texts):
    assert token_counts.counter(default_path()).column(*column(texts)).tolist() == [library_count(t) for t in texts]


def test_counts_of_special_strings_contractions_and_long_runs(monkeypatch):
    texts = ["a<|endoftext|>b", "<|startoftext|><|endoftext|>'s", "<|ENDOFTEXT|>", "it's we'll they're 'tis ''s !'s 'll",
             "x" * 5000, "".join(random.Random(1).choice("0123456789abcdef") for _ in range(3000)), "", " \n", "Ⅳ" * 50,
             " ".join(random.Random(2).choice(["hahaha", "Rendezvous", "naïve", "中文", "don't"]) for _ in range(4000))]
    count = token_counts.Counter(default_path())
    want = [library_count(t) for t in texts]
    assert count.column(*column(texts)).tolist() == want
    monkeypatch.setattr(token_counts, "BLOCK_BYTES", 500)          # texts cut into blocks
    monkeypatch.setattr(token_counts, "STATES", 50)                # the transducer starts anew again and again
    assert count.column(*column(texts)).tolist() == want


def test_lexer_maps_compose():
    r = np.random.default_rng(5)
    for n in (0, 1, 63, 64, 65, 5000):
        classes = r.integers(0, 7, n).astype(np.uint8)
        state, want = 0, []
        for c in classes.tolist():
            want.append(state)
            state = int(token_counts._TO[state, c])
        assert token_counts.entered_states(classes).tolist() == want


def test_files_of_another_shape_go_to_the_library():
    import public_tokenizers
    count = token_counts.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    assert count.pieces is None
    texts = ["Hello  there, it's 2024!", "", "été"]
    assert count.column(*column(texts)).tolist() == [len(count.tok.encode(t, add_special_tokens=False).ids) for t in texts]


# -------------------------------------------------------- fill in the middle
def plain_fim(doc_id, text, rate=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    a, z = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:z], lines[z:]))
    form = "spm" if h4 % 100 < spm else "psm"
    return doc_id, n, form, len(p), len(m), (f"<S>{s}<P>{p}" if form == "spm" else f"<P>{p}<S>{s}") + f"<M>{m}"


def fim_rows():
    r = random.Random(9)
    shared = "".join(f"shared line {i} é 日本\n" for i in range(200))
    rows = [(i, t) for i, t, *_ in C.rows()]
    rows += [(400 + i, "".join(r.choice(["a b c\n", "\n", "ü" * r.randint(0, 300) + "\n", "x" * r.randint(0, 900)])
                               for _ in range(r.randint(0, 80))) + (shared if i % 2 else "")) for i in range(60)]
    return rows + [(500, "a <S> b\nc"), (501, "\n" * 5000), (502, "no line end"), (503, "<P"), (504, "y\n" * 50_000)]


@pytest.mark.parametrize("rate,spm", [(100, 50), (60, 10)])
def test_fim_equals_plain_form(spark, rate, spm):
    rows = fim_rows()
    df = C.frame(spark, [(i, t, None, None, None) for i, t in rows])
    got = C.plain(fim.fill_in_middle(df, rate=rate, spm=spm, with_output=True), "doc_id", "n", "form", "prefix_chars",
                  "middle_chars", "output", "output_sha256", "restored_sha256")
    want = []
    for i, t in rows:
        x = plain_fim(i, t, rate, spm)
        want.append((*x, hashlib.sha256(x[-1].encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr) and {r[2] for r in got} == {"plain", "psm", "spm"}


def test_equal_passages_become_equal_chunks_and_memory_is_bounded():
    r = random.Random(4)
    passage = "".join(r.choice("abcdefgh \n") for _ in range(20_000))
    memo = fim.Memo(limit=60_000)
    for k in range(30):
        raw = ("".join(r.choice("xyz") for _ in range(r.randint(0, 700))) + passage).encode()
        codes = np.frombuffer(raw, np.uint8)
        cuts = fim.ends(codes, np.array([len(raw)]))[0]
        assert cuts[-1] == len(raw) and all(b - a <= fim.MOST for a, b in zip([0, *cuts], cuts))
        fim.Text([raw[a:z] for a, z in zip([0, *cuts], cuts)], memo)
    assert memo.hits > 5 * memo.misses and sum(map(len, memo.known)) <= 60_000 + fim.MOST


def test_sentinel_across_chunks():
    memo = fim.Memo()
    assert fim.Text([b"ab<", b"M>cd"], memo).sentinel and fim.Text([b"<", b"S", b">"], memo).sentinel
    assert not fim.Text([b"ab<", b"Q>cd"], memo).sentinel


# ------------------------------------------------------------- ranked search
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    N, L = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item_id, text in sorted({x for x in items if x[1] is not None}, key=repr):
        scored = []
        for i, c, n in held:
            m = 100 - 50 + (50 * n * N) // L
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
                    for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item_id, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def search_rows():
    rows = [(i, t) for i, t, *_ in C.rows()]
    copy = rows[5][1]
    return rows + [(1000 + i, copy) for i in range(80)] + [(None, copy)] * 3 + [(900, copy)] * 4


@pytest.mark.parametrize("k,bits,broadcast", [(50, 16, 10**6), (3, 2, 10**6), (10, 16, 0)])
def test_search_equals_brute_force(spark, monkeypatch, k, bits, broadcast):
    monkeypatch.setattr(lexical, "BITS", bits)              # few bits: many bounds are too high, the result is the same
    monkeypatch.setattr(lexical, "BROADCAST_KEYS", broadcast)
    docs = search_rows()
    items = [(1, docs[5][1]), (2, "RUN password é Σ"), (3, None), (4, "nothingofthatkind"), (5, ""), (1, docs[5][1]),
             (6, docs[10][1] + " " + docs[20][1]), (7, "word x1")]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "text as score", "item_id as rank")
    got = C.plain(lexical.search(C.frame(spark, [(i, t, None, None, None) for i, t in docs]), bench, k=k),
                  "item_id", "rank", "doc_id", "score")
    assert got == brute_search(docs, items, k)


def test_search_of_many_item_blocks_and_empty_tables(spark, monkeypatch):
    docs = search_rows()
    items = [(i, t) for i, t in docs[:40] if t and i is not None]
    frame = C.frame(spark, [(i, t, None, None, None) for i, t in docs])
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_search(docs, items, 5)
    monkeypatch.setattr(lexical, "ITEM_BYTES", 4000)
    assert C.plain(lexical.search(frame, bench, k=5), "item_id", "rank", "doc_id", "score") == want
    assert lexical.search(frame.limit(0), bench, k=5).count() == 0
    assert lexical.search(frame, bench.limit(0), k=5).count() == 0
    for op in (token_counts.token_counts, fim.fill_in_middle):
        assert op(frame.limit(0)).count() == 0


def test_bounds_are_never_below_scores(spark):
    docs = [(i, t) for i, t in search_rows() if t and i is not None]
    words = sorted({t.encode() for _, x in docs[:30] for t in terms(x)})
    index = lexical.scan(C.frame(spark, [(i, t, None, None, None) for i, t in docs]), words, "doc_id", "text").collect()
    stats = Counter()
    for r in index:
        if r.stat is not None:
            stats[r.stat] += r.n_stat
    query = lexical.Query([(i, t.encode()) for i, t in docs[:30]], words, stats)
    seen = 0
    for r in index:
        if r.bits is not None:
            ids = np.frombuffer(r.ids, np.int64)
            bound = query.bounds(r.docs, r.slices, np.frombuffer(r.sizes, np.int64), bytes(r.bits))
            for d, i in enumerate(ids.tolist()):
                texts = [t for j, t in docs if j == i]
                if len(set(texts)) == 1:
                    scores = query.score(texts[0].encode(), list(range(30)))
                    assert all(b >= s for b, s in zip(bound[:, d].tolist(), scores))
                seen += 1
    assert seen == len(docs) - sum(not terms(t) for _, t in docs)
