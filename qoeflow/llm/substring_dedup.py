"""Substring dedup by recompression.

A document is a string of words.  Round 0 names maximal runs of one word,
every later round names pairs: a hash bit of a symbol puts it left or right
for that round, and each left symbol followed by a right one becomes one
symbol.  A name is a 64-bit hash of what it stands for, so it is global
without a dictionary, and equal substrings get equal symbols except at their
edges.

Which symbols of a window cannot depend on what surrounds it follows from the
window alone: its first and last run are left out, and in each pair round a
first symbol that is a right one and a last symbol that is a left one.  Of
the symbols of round ``ANCHOR_ROUND`` that remain (else of the last round that
leaves any) the longest two neighbours are the window's anchor; a window that
has none left is its own.  Equal windows have equal
anchors.

Spark stages, all on one exchange of the texts by bucket (a hash of the row):

1. per bucket: the distinct anchors, and the distinct high-level symbols of at
   least a window's length with a second hash of their words and their
   smallest doc_id; grouped by symbol over the buckets, what only one document
   has is dropped (reveal);
2. per bucket: windows inside a high-level symbol that a smaller document also
   holds are settled; the other windows with a shared anchor go out once per
   bucket as two hashes of their words' hashes, 96 bits; grouped over the buckets each
   gets the smallest doc_id that holds it (verify);
3. per bucket: words under windows of a smaller document are removed.

Every key has at most one row per bucket before a shuffle, so a passage that a
third of all documents share is no hot key.  Nothing is capped: windows of a
run (no anchor inside) are compared by their own hash.

Defined results: null text has no words; a null doc_id is neither smaller nor
larger than any (its words stay and it removes none); rows with equal doc_id
do not remove each other's words; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qoeflow.llm.common import U64, blocks, mix64, seeded, signed, unsigned
from qoeflow.llm.words import BLOCK, Poly, word_hashes

#: Bytes of text in a bucket: what one task call holds.
BUCKET_BYTES = 6 << 20
#: Words of a long text parsed at once.
UNIT_WORDS = 200_000
#: Round whose symbols are anchors: up to 4 words long, and few windows have
#: nothing left inside.
ANCHOR_ROUND = 2
#: Rounds whose symbols verify long repeats (a round names about a quarter of
#: the symbols away, so these are about 60 and 240 words long).
HIGH = (14, 19)

_ROUND = seeded(64, 21)
_WINDOW = [Poly(201), Poly(202)]
_SECOND = U64(0xA5A5A5A55A5A5A5A)


class Parsed:
    """Recompression of some units of words: window anchors and hashes, and the
    high-level symbols."""

    def __init__(self, h1, unit_of, n: int, anchors: bool):
        """h1: word hashes; unit_of: number of each word's unit,
        ascending; n: words of a window; anchors: whether they are wanted."""
        m = len(h1)
        p1, p2 = _WINDOW[0].prefix(h1), _WINDOW[1].prefix(mix64(h1 ^ _SECOND))
        at = np.arange(max(m - n + 1, 0))
        self.start = at = at[unit_of[at] == unit_of[at + n - 1]] if m >= n else at[:0]
        self.a = _WINDOW[0].ranges(p1, at, at + n)
        self.b = _WINDOW[1].ranges(p2, at, at + n) >> U64(32)
        # round 0: runs
        new = np.ones(m, bool)
        new[1:] = (h1[1:] != h1[:-1]) | (unit_of[1:] != unit_of[:-1])
        st = np.flatnonzero(new)
        en = np.append(st[1:], m)
        ln = (en - st).astype(U64)
        sym = np.where(ln > U64(1), mix64(h1[st] * U64(3) + mix64(ln)), h1[st]) if m else h1
        unit = unit_of[st]
        run = np.cumsum(new) - 1
        lo, hi = run[at] + 1, run[at + n - 1]
        anchor = self.a ^ U64(1)
        live = np.flatnonzero(lo < hi) if anchors else at[:0]
        lo, hi = lo[live], hi[live]
        self.high: list[tuple] = []
        for k in range(1, max(HIGH) + 1):
            right = (mix64(sym ^ _ROUND[k]) >> U64(63)).astype(bool)
            pair = np.zeros(len(sym), bool)
            pair[:-1] = ~right[:-1] & right[1:] & (unit[1:] == unit[:-1])
            if len(live):
                lo2, hi2 = lo + right[lo], hi - ~right[hi - 1]
                gone = lo2 >= hi2       # this round leaves nothing inside the window
                if gone.any():
                    anchor[live[gone]] = _choose(sym, en - st, lo[gone], hi[gone]) + U64(k - 1)
                    live, lo2, hi2 = live[~gone], lo2[~gone], hi2[~gone]
            keep = np.ones(len(sym), bool)
            keep[1:] = ~pair[:-1]
            left = np.flatnonzero(pair)
            sym, en = sym.copy(), en.copy()
            sym[left] = mix64(sym[left] * U64(5) + mix64(sym[left + 1] + _ROUND[k]))
            en[left] = en[left + 1]
            if len(live):
                index = np.cumsum(keep) - 1
                lo, hi = index[lo2], index[hi2 - 1] + 1
            sym, st, en, unit = sym[keep], st[keep], en[keep], unit[keep]
            if k == ANCHOR_ROUND:
                if len(live):
                    anchor[live] = _choose(sym, en - st, lo, hi) + U64(k)
                live = live[:0]
            if k in HIGH:
                long = np.flatnonzero(en - st >= n)
                s, e = st[long], en[long]
                self.high.append((sym[long] + U64(k), _WINDOW[1].ranges(p2, s, e), s, e))
        self.anchor = anchor


def _choose(sym, size, lo, hi) -> np.ndarray:
    """Of the neighbouring symbols in [lo, hi) of each window the longest pair,
    among equals that with the smallest hash (neighbouring windows mostly
    choose the same); a lone symbol where there is no pair."""
    two = np.append(mix64(sym[:-1] * U64(9) + mix64(sym[1:])), sym[-1:])
    long = np.append(size[:-1] + size[1:], size[-1:])
    rank = (U64(255) - np.minimum(long, 255).astype(U64) << U64(56)) | (two >> U64(8))
    at, best = lo.copy(), rank[lo]
    for j in range(1, int((hi - lo).max(initial=0)) - 1):
        more = np.flatnonzero(lo + j + 1 < hi)
        r = rank[lo[more] + j]
        win = r < best[more]
        best[more[win]] = r[win]
        at[more[win]] = lo[more[win]] + j
    return mix64(np.where(hi - lo > 1, two[at], sym[at]))


def _units(texts, n: int, anchors: bool = True):
    """Blocks of texts, as (row of each word, first word of the block within
    its row, Parsed).  A longer text comes alone and in parts that overlap by
    n-1 words; what a window gives does not depend on where a part ends."""
    for first, end in blocks([len(t or b"") + 1 for t in texts], BLOCK):
        data = [t or b"" for t in texts[first:end]]
        edge = np.cumsum([0] + [len(t) + 1 for t in data])
        start, h1 = word_hashes(b"\n".join(data))
        row = np.repeat(np.arange(first, end), np.diff(np.searchsorted(start, edge)))
        step = len(h1) if end - first > 1 else UNIT_WORDS
        for off in range(0, max(len(h1) - n + 1, 0), max(step, 1)):
            part = slice(off, off + step + n - 1)
            yield row[part], off, Parsed(h1[part], row[part], n, anchors)


_NO_ID = np.iinfo(np.int64).max
_NO_ROWS = np.zeros(0, np.int64), np.zeros(0, bool), []


def _columns(t: pa.Table):
    ids = t.column("doc_id").to_pylist()
    known = np.array([i is not None for i in ids], bool)
    codec = pa.Codec("zstd")
    texts = [codec.decompress(z.as_py(), n, asbytes=True) if n else b""
             for z, n in zip(t.column("text"), t.column("size").to_pylist())]
    return np.array([_NO_ID if i is None else i for i in ids], np.int64), known, texts


def _deflate(batches):
    """Texts are read by three stages from one exchange; it holds them packed."""
    codec = pa.Codec("zstd", 1)
    for b in batches:
        packed = [codec.compress(x.as_py(), asbytes=True) if n else None
                  for x, n in zip(b.column("text"), b.column("size").to_pylist())]
        yield pa.record_batch([b.column("bucket"), b.column("doc_id"), b.column("size"), pa.array(packed, pa.binary())],
                              ["bucket", "doc_id", "size", "text"])


def _least(kind, bucket, a, b, doc) -> pa.Table:
    """Distinct (a, b) with their smallest doc and how far the largest is above."""
    order = np.lexsort((b, a))
    a, b, doc = a[order], b[order], doc[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(first)
    lo = np.minimum.reduceat(doc, at) if len(at) else doc
    hi = np.maximum.reduceat(doc, at) if len(at) else doc
    return pa.table({"a": signed(a[at]), "b": signed(b[at]), "bucket": np.full(len(at), bucket, np.int64),
                     "lo": lo.astype(np.int64), "more": (hi - lo).astype(np.int64),
                     "kind": np.full(len(at), kind, np.int64)})


ANCHOR, HIGH_SYMBOL, WINDOW = 0, 1, 2
_KEYS = "a long, b long, bucket long, lo long, more long, kind long"


def _reveal(n: int):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        doc, known, texts = _columns(t)
        parts, high = [], []
        for row, _, p in _units(texts, n):
            w = row[p.start]
            keep = np.ones(len(w), bool)     # neighbours mostly share their anchor
            keep[1:] = (p.anchor[1:] != p.anchor[:-1]) | (w[1:] != w[:-1])
            keep &= known[w]
            parts.append((p.anchor[keep], np.zeros(int(keep.sum()), U64), doc[w[keep]]))
            for a, b, s, _ in p.high:
                u = row[s]
                high.append((a[known[u]], b[known[u]], doc[u[known[u]]]))
        anchors = _least(ANCHOR, key[0].as_py(), *_joined(parts))
        # of an anchor it only matters whether a second document has it
        many = pa.array((anchors.column("more").to_numpy() > 0).astype(np.int64))
        anchors = anchors.set_column(3, "lo", pa.array(np.zeros(len(many), np.int64))).set_column(4, "more", many)
        return pa.concat_tables([anchors, _least(HIGH_SYMBOL, key[0].as_py(), *_joined(high))])
    return run


def _joined(parts):
    return (np.concatenate([x[i] for x in parts]) if parts else np.zeros(0, (U64, U64, np.int64)[i])
            for i in range(3))


class _Table:
    """Exact lookup of (a, b) pairs: smallest doc_id, or _NO_ID."""

    def __init__(self, a, b, doc):
        self.key = mix64(a * U64(7) + mix64(b))
        order = np.argsort(self.key, kind="stable")
        self.key, self.a, self.b, self.doc = self.key[order], a[order], b[order], doc[order]

    def get(self, a, b) -> np.ndarray:
        out = np.full(len(a), _NO_ID, np.int64)
        if len(self.key):
            key = mix64(a * U64(7) + mix64(b))
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            hit = (self.key[at] == key) & (self.a[at] == a) & (self.b[at] == b)
            out[hit] = self.doc[at[hit]]
        return out


def _of_kind(t: pa.Table, kind: int) -> _Table:
    t = t.filter(pa.array(t.column("kind").to_numpy() == kind))
    return _Table(unsigned(t.column("a").to_numpy()), unsigned(t.column("b").to_numpy()), t.column("lo").to_numpy())


def _settled(p: Parsed, high: _Table, row, doc) -> np.ndarray:
    """For each word, how far a high-level symbol of a smaller document reaches
    that starts at or before it."""
    reach = np.zeros(len(row) + 1, np.int64)
    for a, b, s, e in p.high:
        hit = high.get(a, b) < doc[row[s]]
        reach[s[hit]] = np.maximum(reach[s[hit]], e[hit])
    return np.maximum.accumulate(reach)


def _verify(n: int):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table, shared: pa.Table) -> pa.Table:
        doc, known, texts = _columns(t) if t.num_rows else _NO_ROWS
        parts = []
        if not shared.num_rows:
            return shared.select(["a", "b", "bucket", "lo", "more", "kind"])
        anchors, high = np.sort(_of_kind(shared, ANCHOR).a), _of_kind(shared, HIGH_SYMBOL)
        for row, _, p in _units(texts if len(anchors) else [], n):
            w = row[p.start]
            at = np.minimum(np.searchsorted(anchors, p.anchor), len(anchors) - 1)
            want = (known[w] & (anchors[at] == p.anchor)
                    & (_settled(p, high, row, doc)[p.start] < p.start + n))
            parts.append((p.a[want], p.b[want], doc[w[want]]))
        # what is settled already is needed again by the last step
        kept = shared.filter(pa.array((shared.column("kind").to_numpy() == HIGH_SYMBOL)
                                      & (shared.column("more").to_numpy() > 0)))
        return pa.concat_tables([_least(WINDOW, key[0].as_py(), *_joined(parts)),
                                 kept.select(["a", "b", "bucket", "lo", "more", "kind"])])
    return run


def _remove(n: int, with_text: bool):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table, found: pa.Table) -> pa.Table:
        doc, known, texts = _columns(t) if t.num_rows else _NO_ROWS
        gone: dict[int, np.ndarray] = {}     # row -> its removed words' numbers
        if found.num_rows:
            high, windows = _of_kind(found, HIGH_SYMBOL), _of_kind(found, WINDOW)
            for row, off, p in _units(texts, n, anchors=False):
                w = row[p.start]
                hit = p.start[known[w] & ((windows.get(p.a, p.b) < doc[w])
                                          | (_settled(p, high, row, doc)[p.start] >= p.start + n))]
                d = np.zeros(len(row) + 1, np.int64)
                d[hit] += 1
                d[hit + n] -= 1
                under = np.flatnonzero(np.cumsum(d[:-1]))
                for u in np.unique(row[under]).tolist():
                    base = int(np.searchsorted(row, u)) - off
                    mine = under[np.searchsorted(row[under], u):np.searchsorted(row[under], u, "right")] - base
                    gone[u] = np.append(gone[u], mine) if u in gone else mine
        out = {"doc_id": [], "n_words": [], "n_removed": [], "kept_sha256": [], "kept_text": []}
        for row, text in enumerate(texts):
            words = (text or b"").split()
            kept, removed = words, 0
            if row in gone:
                stay = np.ones(len(words), bool)
                stay[gone[row]] = False
                removed = len(words) - int(stay.sum())
                kept = compress(words, stay.tolist())
            kept = b" ".join(kept)
            out["doc_id"].append(int(doc[row]) if known[row] else None)
            out["n_words"].append(len(words))
            out["n_removed"].append(removed)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept_text"].append(kept.decode("utf-8", "replace") if with_text else None)
        return pa.table(out, schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()),
                                               ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
                                               ("kept_text", pa.string())]))
    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 13,
                    with_text: bool = False, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and (``with_text``) kept_text:
    the words left after removing each word under an ``n``-word window that
    also starts in a document with a smaller id."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = d.select(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    n_buckets = max(1, math.ceil(size / bucket_bytes))
    d = d.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_buckets)).alias("bucket"), "doc_id",
                 F.octet_length("text").cast("long").alias("size"), F.col("text").cast("binary").alias("text"))
    d = d.mapInArrow(_deflate, "bucket long, doc_id long, size long, text binary")
    by_key = Window.partitionBy("a", "b", "kind")
    least, top = F.min("lo").over(by_key), F.max(F.col("lo") + F.col("more")).over(by_key)
    # more: how far the bucket's largest doc_id is above the smallest of all
    above = (F.col("lo") + F.col("more") - F.col("least")).alias("more")
    names = d.groupBy("bucket").applyInArrow(_reveal(n), _KEYS)
    shared = (names.select("*", least.alias("least"), top.alias("top"), F.count(F.lit(1)).over(by_key).alias("held"))
              .filter(f"least < top or kind = {ANCHOR} and held > 1")
              .select("a", "b", "bucket", F.col("least").alias("lo"), above, "kind"))
    found = (d.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(_verify(n), _KEYS)
             .select("*", least.alias("least")).select("a", "b", "bucket", F.col("least").alias("lo"), above, "kind")
             .filter("more > 0"))
    out = d.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(
        _remove(n, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out if with_text else out.drop("kept_text")
