"""SimHash near-duplicates with pivot distance tables.

Fingerprints: every shingle of a text (bytes lower-cased for A-Z, words
``[^\\x20\\x09-\\x0D]+``) is hashed with XXH64; a bit is 1 if it is set in more
than half of the hashes.

Links (at most ``max_distance`` differing bits) are searched among distinct
fingerprints.  Every fingerprint carries its Hamming distances to ``PIVOTS``
reference fingerprints.  Distances differ by at most ``d(x, y)``, so a pair
with any coordinate further apart than ``max_distance`` is discarded; the
survivors are verified bit by bit.

A single pivot distance of two unrelated fingerprints is within 4 more than
half of the time, so the table alone would still look at every pair.  Pairs
are therefore only formed inside blocks: the 64 bits are cut into m segments,
and two fingerprints that differ in at most d bits agree on at least m - d of
them, so every link lies in a block of one of the C(m, d) choices of agreeing
segments.  m grows with the number of fingerprints, which keeps chance
meetings per fingerprint constant.  A block above ``BLOCK_ROWS`` is worked off
as pairs of sub-blocks in separate tasks; nothing is capped.  A block emits
the star of each component it finds, not its pairs, so output stays linear.

Defined results: null or wordless text has fingerprint 0 and is linked like
any other; a component's id is its smallest non-null doc_id (null if it has
none); repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qoeflow.llm.common import fresh, materialise, release, seeded, signed
from qoeflow.llm.graph import connected_components

PIVOTS = seeded(16, 61)
#: Members of a block that one task compares.
BLOCK_ROWS = 8192
#: Shingles hashed at once.
STEP = 1 << 16


def fingerprint(text: bytes | None, n: int = 4, seed: int = 42) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    k = max(1, len(words) - n + 1)
    start, end = start[:k], end[-k:]
    h = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, k, STEP):
        s, e = start[at:at + STEP].tolist(), end[at:at + STEP].tolist()
        values = np.fromiter((h(joined[a:b], seed) for a, b in zip(s, e)), np.dtype("<u8"), len(s))
        ones += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > k, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, n: int = 4) -> DataFrame:
    """doc_id, row_key (a hash of the row) and fp (the 64 bits as a long)."""
    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), n) for t in b.column("text")], np.uint64)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "row_key": b.column("row_key"),
                                   "fp": pa.array(signed(fp))})
            release()
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_key"),
                        F.col(text_col).cast("binary").alias("text"))
            .mapInArrow(run, "doc_id long, row_key long, fp long"))


def _masks(n_rows: int, d: int) -> list[int]:
    """Masks of the agreeing segments, for the least number of segments at
    which chance meetings stay below about eight a fingerprint."""
    m = d + 1
    while m < 64:
        bits = [64 * (i + 1) // m - 64 * i // m for i in range(m)]
        if 2.0 ** sum(sorted(bits)[:m - d]) * 8 >= math.comb(m, d) * n_rows:
            break
        m += 1
    edge = [64 * i // m for i in range(m + 1)]
    seg = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(m)]
    return [sum(seg[i] for i in c) for c in combinations(range(m), m - d)]


def pivot_columns():
    """The pivot table of a fingerprint as columns: its Hamming distances to
    the pivots, a byte each, eight to a long."""
    near = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(p)))).cast("long") for p in signed(PIVOTS)]
    out = []
    for at in range(0, len(near), 8):
        packed = near[at]
        for i, x in enumerate(near[at + 1:at + 8], 1):
            packed = packed.bitwiseOR(F.shiftleft(x, 8 * i))
        out.append(packed.alias(f"pivots{at // 8}"))
    return out


def pivot_table(*packed: np.ndarray) -> np.ndarray:
    """Rows of distances, one a pivot, from the longs of ``pivot_columns``."""
    return np.concatenate([np.ascontiguousarray(p).view(np.int8).reshape(-1, 8).T for p in packed])


def _survivors(table, fp, left, right, d):
    """Pairs (left[i], right[i]) whose coordinates never differ by more than d
    and that are at most d bits apart."""
    for row in table:
        ok = np.abs(row[left] - row[right]) <= d
        if not ok.all():
            left, right = left[ok], right[ok]
    ok = np.bitwise_count(fp[left] ^ fp[right]) <= d
    return left[ok], right[ok]


def _roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        apart = lo < hi
        if not apart.any():
            break
        u, v = u[apart], v[apart]
        np.minimum.at(root, hi[apart], lo[apart])
        while (root[root] != root).any():
            root = root[root]
    return root


def _stars(group: np.ndarray, fp: np.ndarray, table: np.ndarray, d: int):
    """Links (fp, another fp) that connect what is linked within each group;
    pairs are formed only where the first pivot distance differs by at most
    ``d``."""
    n = len(fp)
    order = np.lexsort((table[0], group))
    group, fp, table = group[order], fp[order], table[:, order]
    place = group.astype(np.int64) * 256 + table[0]
    end = np.searchsorted(place, place + d, "right")
    root = np.arange(n)
    links_u, links_v, held = [], [], 0

    def fold():
        nonlocal root, links_u, links_v, held
        if links_u:
            u, v = np.concatenate(links_u), np.concatenate(links_v)
            keep = root[u] != root[v]
            root = _roots(n, np.concatenate([u[keep], np.arange(n)]), np.concatenate([v[keep], root]))
        links_u, links_v, held = [], [], 0

    at = 0
    rows = np.arange(n)
    while at < n:                      # rows [at, stop) against all later rows of their group
        width = np.cumsum(end[at:at + 4096] - rows[at:at + 4096] - 1)
        stop = at + max(1, int(np.searchsorted(width, 1 << 20, side="right")))
        size = end[at:stop] - rows[at:stop] - 1
        left = np.repeat(rows[at:stop], size)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(size) - size, size)
        u, v = _survivors(table, fp, left, right, d)
        links_u.append(u)
        links_v.append(v)
        held += len(u)
        if held > 1 << 21:
            fold()
        at = stop
    fold()
    off = np.flatnonzero(root != np.arange(n))
    return fp[off], fp[root[off]]


def links(distinct: DataFrame, d: int = 4, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """u, v: links that connect every pair of distinct ``fp`` at most ``d``
    bits apart, directly or through other links."""
    masks = _masks(max(1, distinct.count()), d)
    signed_masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    pivots = [c for c in distinct.columns if c.startswith("pivots")]
    keyed = distinct.select("fp", *pivots, F.posexplode(F.array(*[F.lit(m) for m in signed_masks])).alias("c", "mask"))
    keyed = keyed.select("c", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", *pivots)
    met = keyed.groupBy("c", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = keyed.join(met, ["c", "key"]).withColumn("nb", F.ceil(F.col("n") / F.lit(block_rows)).cast("int"))
    rows = (rows.withColumn("blk", F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
            .filter("nb = 1 or other <> blk")
            .select("c", "key", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "fp", *pivots))

    def run(batches):
        held = None

        def out(part):
            """Numbered groups of whole rows to links."""
            key = np.stack([part[x] for x in ("c", "key", "i", "j")])
            group = np.concatenate([[0], np.cumsum((key[:, 1:] != key[:, :-1]).any(0))])
            u, v = _stars(group, part["fp"].view(np.uint64), pivot_table(*(part[p] for p in pivots)), d)
            return pa.record_batch({"u": pa.array(signed(u)), "v": pa.array(signed(v))})

        for b in batches:
            new = {x: b.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in b.schema.names}
            held = new if held is None else {x: np.concatenate([held[x], new[x]]) for x in new}
            key = np.stack([held[x] for x in ("c", "key", "i", "j")])
            last = np.flatnonzero((key != key[:, -1:]).any(0))
            whole = int(last[-1]) + 1 if len(last) else 0
            if whole:
                yield out({x: a[:whole] for x, a in held.items()})
                held = {x: a[whole:] for x, a in held.items()}
        if held is not None and len(held["fp"]):
            yield out(held)

    return (rows.repartition("c", "key", "i", "j").sortWithinPartitions("c", "key", "i", "j")
            .mapInArrow(run, "u long, v long"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4,
                       max_distance: int = 4, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, row_key, fingerprint (16 hex digits), component_id."""
    prints = materialise(fingerprints(docs, id_col, text_col, n), "simhash")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("lo")).select("fp", "lo", *pivot_columns())
    distinct = materialise(distinct, "simhash-distinct")
    found = links(distinct.drop("lo"), max_distance, block_rows)
    roots = connected_components(found)
    named = (distinct.join(roots, distinct.fp == roots.node, "left")
             .select("fp", "lo", F.coalesce("root", "fp").alias("root")))
    least = named.groupBy("root").agg(F.min("lo").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id")
    return (prints.join(named, "fp", "left")
            .select("doc_id", "row_key", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4,
             max_distance: int = 4) -> DataFrame:
    """``docs`` with one row of each component: that of its smallest doc_id
    (among equal ids that of the smallest row hash; of rows equal in id and
    text one).  A component whose ids are all null keeps the row with the
    smallest hash among those of each fingerprint."""
    parts = simhash_components(docs, id_col, text_col, n, max_distance)
    best = (parts.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
            .groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("f"))
            .agg(F.min("row_key").alias("row_key")))
    row = fresh(docs, "row")
    best = best.select(F.col("row_key").alias(row)).distinct()
    keyed = docs.withColumn(row, F.xxhash64(F.col(id_col), F.col(text_col)))
    return keyed.join(best, row, "left_semi").dropDuplicates([row, id_col]).drop(row)
