"""Fill-in-the-middle transformation by content-defined chunk memoization.

A text's lines (``[^\\n]*\\n|[^\\n]+``) are the units; two numbers drawn from a
hash of the document's id say how many lines make the prefix and how many end
the middle.  Where those cuts lie is found without splitting the text:

1. A rolling (gear) hash over the last 32 bytes cuts the text into chunks, so
   that equal passages of different documents become equal chunks whatever
   stands before them.  The hash of every position comes from five doublings in
   numpy; the hash depends on no byte before the chunk.
2. A worker keeps summaries of the chunks it has met, by their content: a hit
   is a chunk with the same bytes, never only the same hash.  A summary is the
   number of line ends and of characters, and whether a sentinel lies inside;
   the bytes at a chunk's ends tell whether one lies across two chunks.  The
   store is emptied when its chunks exceed ``MEMO_BYTES``.
3. Counts of chunks add up to counts of the text.  The chunk in which a cut
   lies follows from the running sums, and only that chunk is searched.

Everything is one pass without a shuffle; a task holds a batch of rows, the
block of bytes whose hash is at work and the store.

Defined results: null text is empty (form ``plain``, 0 lines); a null id is
hashed as the empty string; repeated rows are transformed each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qoeflow.llm.common import seeded
from qoeflow.llm.token_counts import column_bytes

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Least, usual (beyond the least) and largest bytes of a chunk; the least is
#: above the rolling hash's reach of 32 bytes.
LEAST, USUAL, MOST = 64, 512, 8192
#: Bytes hashed at once and bytes of chunks whose summaries a worker keeps.
BLOCK_BYTES = 1 << 20
MEMO_BYTES = 24 << 20

_GEAR = (seeded(256, 1201) >> np.uint64(32)).astype(np.uint32)


def gear(codes: np.ndarray) -> np.ndarray:
    """Rolling hash at every byte: the sum over the last 32 bytes of their
    gear values, each doubled once for every byte since."""
    h = _GEAR[codes]
    reach = 1
    while reach < 32:
        older = h[:-reach] << np.uint32(reach) if reach < len(h) else h[:0]
        h = h.copy()
        h[reach:] += older
        reach *= 2
    return h


def ends(codes: np.ndarray, edge: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each text; texts end at ``edge``."""
    marks: list[np.ndarray] = []
    for a in range(0, len(codes), BLOCK_BYTES):
        first = max(0, a - 31)
        h = gear(codes[first:a + BLOCK_BYTES])[a - first:]
        marks.append(np.flatnonzero((h >> np.uint32(32 - (USUAL.bit_length() - 1))) == 0) + a + 1)
    cut = np.concatenate(marks) if marks else np.zeros(0, np.int64)
    out, start = [], 0
    for text_end, mine in zip(edge.tolist(), np.split(cut, np.searchsorted(cut, edge[:-1], "left"))):
        got, at = [], start
        for c in [*mine.tolist(), text_end]:
            if c > text_end:
                continue
            while c - at > MOST:
                at += MOST
                got.append(at)
            if c - at >= LEAST:
                got.append(c)
                at = c
        if text_end > at:
            got.append(text_end)
        out.append(got)
        start = text_end
    return out


class Memo:
    """Summaries of chunks by their content."""

    def __init__(self, limit: int = MEMO_BYTES):
        self.limit, self.size = limit, 0
        self.known: dict[bytes, tuple[int, int, bool]] = {}
        self.hits = self.misses = 0

    def summary(self, chunk: bytes) -> tuple[int, int, bool]:
        """Line ends, characters, whether a sentinel lies inside."""
        found = self.known.get(chunk)
        if found is None:
            codes = np.frombuffer(chunk, np.uint8)
            found = (chunk.count(b"\n"), int(np.count_nonzero((codes & 0xC0) != 0x80)), has_sentinel(chunk))
            if self.size > self.limit:
                self.known.clear()
                self.size = 0
            self.known[chunk] = found
            self.size += len(chunk)
            self.misses += 1
        else:
            self.hits += 1
        return found


def has_sentinel(x: bytes) -> bool:
    return b"<" in x and (PREFIX in x or SUFFIX in x or MIDDLE in x)


class Text:
    """A text as its chunks' summaries."""

    def __init__(self, chunks: list[bytes], memo: Memo):
        self.chunks = chunks
        parts = [memo.summary(c) for c in chunks]
        self.line_ends = list(accumulate((p[0] for p in parts), initial=0))
        self.chars = list(accumulate((p[1] for p in parts), initial=0))
        self.bytes = list(accumulate(map(len, chunks), initial=0))
        self.sentinel = any(p[2] for p in parts)
        seam = b""
        for c in chunks:
            self.sentinel = self.sentinel or has_sentinel(seam + c[:2])
            seam = (seam + c[-2:])[-2:]
        self.lines = self.line_ends[-1] + (seam[-1:] not in (b"", b"\n"))

    def cut(self, k: int) -> tuple[int, int]:
        """Byte and character at which the first ``k`` lines end."""
        if k >= self.lines:
            return self.bytes[-1], self.chars[-1]
        if k == 0:
            return 0, 0
        i = bisect_left(self.line_ends, k) - 1
        codes = np.frombuffer(self.chunks[i], np.uint8)
        at = int(np.flatnonzero(codes == 10)[k - self.line_ends[i] - 1]) + 1
        return self.bytes[i] + at, self.chars[i] + int(np.count_nonzero((codes[:at] & 0xC0) != 0x80))


def restore(output: bytes, form: str) -> bytes:
    """The text from its transformed form."""
    if form == "plain":
        return output
    order = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
    at = [output.index(s) for s in order]
    part = {s: output[a + 3:z] for s, a, z in zip(order, at, [*at[1:], len(output)])}
    return part[PREFIX] + part[MIDDLE] + part[SUFFIX]


def transform(raw: bytes, text: Text, key: str, rate: int, spm: int):
    """form, characters of prefix and middle, transformed text."""
    h = hashlib.sha256(key.encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    if not raw or text.sentinel or h3 % 100 >= rate:
        return "plain", None, None, raw
    a, z = sorted((h1 % (text.lines + 1), h2 % (text.lines + 1)))
    (a, a_chars), (z, z_chars) = text.cut(a), text.cut(z)
    prefix, middle, suffix = PREFIX + raw[:a], MIDDLE + raw[a:z], SUFFIX + raw[z:]
    form = "spm" if h4 % 100 < spm else "psm"
    return form, a_chars, z_chars - a_chars, (suffix + prefix if form == "spm" else prefix + suffix) + middle


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100,
                   spm: int = 50, with_output: bool = False) -> DataFrame:
    """doc_id, n (lines), form, prefix_chars, middle_chars, output_sha256,
    restored_sha256 and (``with_output``) output of every row; ``rate`` percent
    of documents are transformed, ``spm`` percent of those suffix first."""
    def run(batches):
        memo = Memo()
        for b in batches:
            data, offsets = column_bytes(b.column("text"))
            ids = b.column("doc_id").to_pylist()
            i = 0
            while i < len(ids):
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK_BYTES, "right")) - 1)
                out = {k: [] for k in arrow.names}
                base = int(offsets[i])
                codes = data[base:offsets[j]]
                for doc_id, first, cuts in zip(ids[i:j], (offsets[i:j] - base).tolist(),
                                               ends(codes, offsets[i + 1:j + 1] - base)):
                    raw = codes[first:cuts[-1]].tobytes() if cuts else b""
                    at = [0, *(c - first for c in cuts)]
                    text = Text([raw[x:y] for x, y in zip(at, at[1:])], memo)
                    form, p, m, done = transform(raw, text, f"{seed}:{'' if doc_id is None else doc_id}", rate, spm)
                    for k, v in (("doc_id", doc_id), ("n", text.lines), ("form", form), ("prefix_chars", p),
                                 ("middle_chars", m), ("output_sha256", hashlib.sha256(done).hexdigest()),
                                 ("restored_sha256", hashlib.sha256(restore(done, form)).hexdigest()),
                                 ("output", done.decode("utf-8", "replace") if with_output else None)):
                        out[k].append(v)
                yield pa.record_batch(out, schema=arrow)
                i = j
    arrow = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                       ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("restored_sha256", pa.string()),
                       ("output", pa.string())])
    out = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
           .mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, "
                            "output_sha256 string, restored_sha256 string, output string"))
    return out if with_output else out.drop("output")
