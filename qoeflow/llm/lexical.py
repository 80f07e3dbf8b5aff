"""Ranked lexical search with bit-sliced Bloom signatures.

Terms are ``[0-9A-Za-z and everything beyond ASCII]+``, A-Z lower-cased; scores
are the integer form of BM25 that ``score`` states.

1. **Index** (one scan of the documents, no shuffle).  A task sorts the
   documents of a few MB by their number of keys and puts runs of similar ones
   into blocks.  A block is a bit matrix with a column per document: every key
   (term, level) sets ``HASHES`` bits of its document's column; level l says
   that the term occurs at least ``LEVELS[l]`` times.  A block is one row of a
   written table, stored by slices (matrix rows).  The same scan counts the
   documents, the terms and in how many documents each query term occurs.
2. **Bounds** (one scan of the index).  The AND of a key's slices marks every
   document that holds it and, rarely, one that does not.  A term's marks,
   level by level, bound its count from above and so its share of the score;
   weighted sums of the slices bound the score of each document of the block.
3. **Probe.**  The ``2 k`` documents of each item with the largest bounds are
   scored exactly from their texts.  The k-th best of those exact scores (and
   its doc_id) is a threshold that the k best documents reach.
4. **Rescore.**  A second scan of the index drops every document whose bound
   lies below the threshold (or on it, behind its doc_id); all others are
   scored exactly from their texts, and the k best are the result.

Bounds are never below a score, so the result is exact whatever the size of the
signatures.  Documents are met again by (doc_id, hash of the text).  Candidate
lists hold a few k of each item; they are broadcast to the scan of the texts
only when they count at most ``BROADCAST_KEYS``, else joined by a shuffle.
Items are the query set: they are worked off in blocks of about ``ITEM_BYTES``.
Document frequencies of query terms go by 64-bit hashes of the terms.

Defined results: null texts and texts without a term have no score and are no
result; items with equal id and text count once, an item without a term has no
rows; repeated documents are ranked each; a null doc_id comes behind all others
of its score; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qoeflow.llm.common import U64, materialise, mix64, seeded
from qoeflow.llm.token_counts import column_bytes
from qoeflow.llm.words import Poly

#: Occurrences from which a term's key of each level is in the signature.
LEVELS = (1, 2, 3, 4, 6, 9, 14, 24, 48)
#: Bits of a column for each key of the block's fullest document; slices a key.
BITS, HASHES = 16, 3
#: Documents and cells (bits) of a block, slices at most.
BLOCK_DOCS, BLOCK_CELLS, MOST_SLICES = 512, 1 << 23, 1 << 21
#: Bytes of text worked off at once; of items worked off together.
TEXT_BYTES = 1 << 20
#: Documents and distinct (document, term) pairs that a task sorts into blocks
#: at once; how much fuller a block's fullest document may be than its emptiest.
SORT_DOCS, SORT_KEYS, SPREAD = 8192, 1 << 20, 1.5
ITEM_BYTES = 2 << 20
#: Candidate keys above which texts are joined by a shuffle.
BROADCAST_KEYS = 200_000
NO_ID = np.iinfo(np.int64).max

_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_VALUES, _POLY = seeded(256, 1301), Poly(1303)
_LEVEL_SEED = seeded(len(LEVELS), 1307)


def terms_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


def _hashes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of each term of lower-cased bytes."""
    edge = np.diff(np.concatenate([[0], _TERM[codes].view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return start, _POLY.ranges(_POLY.prefix(_VALUES[codes]), start, end)


def term_hash(term: bytes) -> int:
    codes = np.frombuffer(term, np.uint8)
    return int(_POLY.ranges(_POLY.prefix(_VALUES[codes]), np.array([0]), np.array([len(codes)]))[0])


def _slices(term: np.ndarray, level: int, m: int) -> np.ndarray:
    """The ``HASHES`` slices of each key (term, level) among ``m``."""
    h = mix64(term ^ _LEVEL_SEED[level])
    a, b = h & U64(0xFFFFFFFF), (h >> U64(32)) | U64(1)
    return np.stack([((a + U64(i) * b) % U64(m)).astype(np.int64) for i in range(HASHES)])


# --------------------------------------------------------------------- index
INDEX = pa.schema([("stat", pa.int64()), ("n_stat", pa.int64()), ("docs", pa.int32()), ("slices", pa.int32()),
                   ("ids", pa.binary()), ("hashes", pa.binary()), ("sizes", pa.binary()), ("bits", pa.binary())])
INDEX_DDL = ("stat long, n_stat long, docs int, slices int, ids binary, hashes binary, sizes binary, bits binary")
#: ``stat`` of the numbers of documents and of terms; others are query terms.
DOCS, TERMS = -1, -2


class _Pending:
    """Documents whose signatures wait for others of about their size."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.docs = self.keys = 0

    def add(self, ids, text_hash, n, doc, term, tf) -> None:
        self.parts.append((ids, text_hash, n, doc + self.docs, term, tf))
        self.docs += len(n)
        self.keys += len(doc)

    def rows(self):
        """Index rows of all that waits: documents sorted by the number of
        their keys, a block ends where they are ``SPREAD`` times its least."""
        if not self.docs:
            return
        ids, text_hash, n, doc, term, tf = (np.concatenate(x) for x in zip(*self.parts))
        keys = np.searchsorted(LEVELS, tf, "right")
        load = np.bincount(doc, keys, len(n)).astype(np.int64)
        first = np.searchsorted(doc, np.arange(len(n) + 1))
        order = np.argsort(load, kind="stable")
        order = order[n[order] > 0]
        sizes = load[order]
        slices = np.minimum(MOST_SLICES, 64 * (sizes * BITS // 64 + 1))
        at = 0
        while at < len(order):
            end = min(len(order), at + BLOCK_DOCS, max(at + 8, int(np.searchsorted(sizes, SPREAD * sizes[at], "right"))))
            while end - at > 8 and slices[end - 1] * (end - at) > BLOCK_CELLS:
                end = at + max(8, (end - at) // 2)
            mine, m = order[at:end], int(slices[end - 1])
            cells = np.zeros((m, -(-len(mine) // 8) * 8), bool)
            of = np.concatenate([np.arange(first[d], first[d + 1]) for d in mine])
            column = np.repeat(np.arange(len(mine)), first[mine + 1] - first[mine])
            for level in range(int(keys[of].max())):
                has = keys[of] > level
                cells[_slices(term[of][has], level, m), column[has]] = True
            yield {"stat": None, "n_stat": None, "docs": len(mine), "slices": m, "ids": ids[mine].tobytes(),
                   "hashes": text_hash[mine].tobytes(), "sizes": n[mine].tobytes(),
                   "bits": np.packbits(cells, axis=1).tobytes()}
            at = end


def scan(docs: DataFrame, query_terms: list[bytes], id_col: str, text_col: str, sign: bool = True) -> DataFrame:
    """The index rows of ``docs`` (``sign``) and rows of statistics: how many
    documents hold each query term, documents and terms in all."""
    hashed = np.array([term_hash(t) for t in query_terms], U64)
    rank = np.argsort(hashed)
    sorted_hash = hashed[rank]

    def run(batches):
        df = np.zeros(len(hashed), np.int64)
        total = Counter()
        pending = _Pending()

        def flush():
            nonlocal pending
            for row in pending.rows():
                yield pa.RecordBatch.from_pylist([row], schema=INDEX)
            pending = _Pending()

        for b in batches:
            data, offsets = column_bytes(b.column("text"))
            ids = np.array(b.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False), np.int64)
            text_hash = np.array(b.column("hash").to_numpy(zero_copy_only=False), np.int64)
            i = 0
            while i < len(ids):
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + TEXT_BYTES, "right")) - 1)
                size = np.diff(offsets[i:j + 1])
                edge = np.cumsum(size + 1)
                codes = np.full(int(edge[-1]), 32, np.uint8)
                keep = np.ones(len(codes), bool)
                keep[edge - 1] = False
                codes[keep] = _LOWER[data[offsets[i]:offsets[j]]]
                start, h = _hashes(codes)
                doc = np.searchsorted(edge, start, "right")
                n = np.bincount(doc, minlength=j - i)
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                at = np.flatnonzero(new)
                doc, h, tf = doc[at], h[at], np.diff(np.append(at, len(h)))
                if len(hashed):
                    place = np.minimum(np.searchsorted(sorted_hash, h), len(hashed) - 1)
                    df += np.bincount(rank[place[sorted_hash[place] == h]], minlength=len(hashed))
                total[DOCS] += int(np.count_nonzero(n))
                total[TERMS] += int(n.sum())
                if sign:
                    pending.add(ids[i:j], text_hash[i:j], n.astype(np.int64), doc, h, tf)
                    if pending.docs >= SORT_DOCS or pending.keys >= SORT_KEYS:
                        yield from flush()
                i = j
        yield from flush()
        total.update({int(t): int(df[t]) for t in np.flatnonzero(df)})
        yield pa.RecordBatch.from_pylist([{"stat": k, "n_stat": v} for k, v in total.items()], schema=INDEX)

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("hash"),
                        F.col(text_col).cast("binary").alias("text"))
            .mapInArrow(run, INDEX_DDL))


def statistics(index: DataFrame) -> dict[int, int]:
    """Sums of the statistics; their number is bounded by the query terms."""
    rows = index.filter("stat is not null").groupBy("stat").agg(F.sum("n_stat").alias("n")).collect()
    return {r["stat"]: r["n"] for r in rows}


# -------------------------------------------------------------------- search
class Query:
    """A block of items with the weights of their terms."""

    def __init__(self, items: list[tuple], terms: list[bytes], stats: dict[int, int]):
        self.ids = [i for i, _ in items]
        self.N, self.L = stats.get(DOCS, 0), stats.get(TERMS, 0)
        number = {t: k for k, t in enumerate(terms)}
        self.terms = [sorted(number[t] for t in set(terms_of(text))) for _, text in items]
        self.words = terms
        self.weight = [math.floor(1000 * math.log((2 * self.N + 2) / (2 * stats.get(k, 0) + 1))) if stats.get(k) else 0
                       for k in range(len(terms))]
        self.hash = np.array([term_hash(t) for t in terms], U64)
        self.used = [np.array([t for t in ts if self.weight[t]], np.int64) for ts in self.terms]
        self.w = np.array(self.weight, np.float64)

    def norm(self, n):
        return 50 + (50 * n * self.N) // max(self.L, 1)

    def score(self, text: bytes, items: list[int]) -> list[int]:
        """Exact scores of a text for some items."""
        words = terms_of(text)
        m = self.norm(len(words))
        count = Counter(words)
        share: dict[int, int] = {}
        out = []
        for i in items:
            total = 0
            for t in self.terms[i]:
                if t not in share:
                    tf = count.get(self.words[t], 0)
                    share[t] = self.weight[t] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
                total += share[t]
            out.append(total)
        return out

    def bounds(self, docs: int, slices: int, sizes: np.ndarray, bits: bytes) -> np.ndarray:
        """Upper bounds of the scores (item, document) of an index block."""
        width = -(-docs // 8)
        table = np.frombuffer(bits, np.uint8).reshape(slices, width)
        m = self.norm(sizes)
        total = np.zeros((len(self.ids), docs), np.int64)
        share = np.zeros(docs, np.int64)
        term = np.arange(len(self.hash))
        held = None
        for level, least in enumerate(LEVELS):
            at = _slices(self.hash[term], level, slices)
            now = table[at[0]]
            for a in at[1:]:
                now = now & table[a]
            held = now if held is None else held & now
            some = held.any(axis=1)
            term, held = term[some], held[some]
            if not len(term):
                break
            most = np.minimum(LEVELS[level + 1] - 1, sizes) if level + 1 < len(LEVELS) else sizes
            most = np.maximum(most, 1)
            grown = (1_000_000_000 * most) // (1000 * most + 20 * m)
            more = np.maximum(grown - share, 0)
            share = np.maximum(grown, share)
            place = np.full(len(self.hash) + 1, -1)
            place[term] = np.arange(len(term))
            marks = np.unpackbits(held, axis=1)[:, :docs]
            for i, ts in enumerate(self.used):
                p = place[ts]
                ok = p >= 0
                if ok.any():
                    total[i] += (self.w[ts[ok]] @ marks[p[ok]].astype(np.float64)).astype(np.int64) * more
        return total


HITS = pa.schema([("item", pa.int32()), ("bound", pa.int64()), ("doc_id", pa.int64()), ("hash", pa.int64()),
                  ("task", pa.int32())])
HITS_DDL = "item int, bound long, doc_id long, hash long, task int"


def _index_rows(batches):
    for b in batches:
        for r in range(b.num_rows):
            row = {c: b.column(c)[r].as_py() for c in ("docs", "slices", "ids", "hashes", "sizes", "bits")}
            yield (row["docs"], row["slices"], np.frombuffer(row["ids"], np.int64), np.frombuffer(row["hashes"], np.int64),
                   np.frombuffer(row["sizes"], np.int64), row["bits"])


def _hits(item, bound, ids, hashes, task):
    known = pa.array(ids, pa.int64(), mask=ids == NO_ID)
    return pa.record_batch([pa.array(item, pa.int32()), pa.array(bound, pa.int64()), known,
                            pa.array(hashes, pa.int64()), pa.array(np.full(len(ids), task), pa.int32())], schema=HITS)


def probe(index: DataFrame, query: Query, k: int) -> DataFrame:
    """The ``k`` documents of each item with the largest bounds."""
    def run(batches):
        from pyspark import TaskContext
        task = TaskContext.get().partitionId()
        best = [(np.zeros(0, np.int64),) * 3 for _ in query.ids]
        for docs, slices, ids, hashes, sizes, bits in _index_rows(batches):
            bound = query.bounds(docs, slices, sizes, bits)
            for i in range(len(best)):
                mine = np.flatnonzero(bound[i] > (best[i][0][-1] - 1 if len(best[i][0]) == k else 0))
                if len(mine):
                    b, d, h = (np.concatenate(x) for x in zip(best[i], (bound[i][mine], ids[mine], hashes[mine])))
                    order = np.lexsort((h, d, -b))[:k]
                    best[i] = b[order], d[order], h[order]
        for i, (b, d, h) in enumerate(best):
            if len(b):
                yield _hits(np.full(len(b), i), b, d, h, task)

    rows = index.filter("bits is not null").mapInArrow(run, HITS_DDL)
    order = [F.col("bound").desc(), F.col("doc_id").asc_nulls_last(), "hash"]
    # two levels, so that no task sees the best of all tasks
    for part in (["item", F.col("task") % 64], ["item"]):
        rows = (rows.withColumn("place", F.row_number().over(Window.partitionBy(*part).orderBy(*order)))
                .filter(F.col("place") <= k).drop("place"))
    return rows


def survivors(index: DataFrame, query: Query, least: dict[int, tuple[int, int]]) -> DataFrame:
    """Documents whose bound does not prove that they lie behind the item's
    threshold (score, doc_id)."""
    score = np.array([least.get(i, (0, NO_ID))[0] for i in range(len(query.ids))], np.int64)[:, None]
    last = np.array([least.get(i, (0, NO_ID))[1] for i in range(len(query.ids))], np.int64)[:, None]

    def run(batches):
        for docs, slices, ids, hashes, sizes, bits in _index_rows(batches):
            bound = query.bounds(docs, slices, sizes, bits)
            item, doc = np.nonzero((bound > score) | ((bound == score) & (bound > 0) & (ids[None, :] <= last)))
            if len(item):
                yield _hits(item, bound[item, doc], ids[doc], hashes[doc], 0)
    return index.filter("bits is not null").mapInArrow(run, HITS_DDL)


def rescore(docs: DataFrame, hits: DataFrame, query: Query, id_col: str, text_col: str) -> DataFrame:
    """item, doc_id, score (above 0) of every document that ``hits`` names,
    from its text."""
    keys = materialise(hits.groupBy("doc_id", "hash").agg(F.collect_set("item").alias("items")), "lexical-keys")
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("h"),
                        F.col(text_col).alias("text"))
    met = texts.join(keys, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("hash")))

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                items = sorted(b.column("items")[r].as_py())
                scores = query.score(b.column("text")[r].as_py() or b"", items)
                got = [(i, s) for i, s in zip(items, scores) if s > 0]
                if got:
                    yield pa.record_batch({"item": pa.array([i for i, _ in got], pa.int32()),
                                           "doc_id": pa.array([b.column("id")[r].as_py()] * len(got), pa.int64()),
                                           "score": pa.array([s for _, s in got], pa.int64())})
    return (met.select("id", F.col("text").cast("binary").alias("text"), "items")
            .mapInArrow(run, "item int, doc_id long, score long"))


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def item_blocks(items: DataFrame, id_col: str, text_col: str):
    """The items (id, text), distinct, in blocks of about ``ITEM_BYTES``."""
    rows = materialise(items.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
                       .filter("text is not null").distinct(), "lexical-items")
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // ITEM_BYTES))
    for block in range(n):
        part = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == block).collect()
        yield sorted(((r["id"], bytes(r["text"])) for r in part), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score of each item's ``k`` best documents."""
    spark = docs.sparkSession
    kind = items.schema[item_col].dataType.simpleString()
    index, out = None, None
    for block in item_blocks(items, item_col, item_text):
        terms = sorted({t for _, text in block for t in terms_of(text)})
        if index is None:
            index = found = materialise(scan(docs, terms, id_col, text_col), "lexical-index")
        else:
            found = materialise(scan(docs, terms, id_col, text_col, sign=False), "lexical-terms")
        query = Query(block, terms, statistics(found))
        probed = _best(rescore(docs, probe(index, query, 2 * k), query, id_col, text_col), k)
        least = {r["item"]: (r["score"], NO_ID if r["doc_id"] is None else r["doc_id"])
                 for r in probed.filter(F.col("rank") == k).collect()}
        best = _best(rescore(docs, survivors(index, query, least), query, id_col, text_col), k)
        names = spark.createDataFrame(list(enumerate(query.ids)), f"item int, item_id {kind}")
        rows = best.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = rows if out is None else out.unionByName(rows)
    return out
