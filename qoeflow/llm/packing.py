"""Best-fit packing by length-histogram planning.

1. Every document becomes token ids plus an end id; only one longer than a
   sequence is cut, into pieces of a sequence's length and a rest.  A task
   numbers its pieces of each length; counts by (task, length) turn that into
   a rank within the length.
2. The histogram of lengths (at most ``max_len`` counts, whatever the size of
   the corpus) is planned on the driver: best fit, longest first, over counts.
   Sequences that are filled alike are one range of sequence numbers, so one
   plan row places many pieces.
3. Pieces take their slots by joining the plan on length and block of ranks.

Nothing but the histogram reaches the driver, and no task sees more than its
own pieces.

Defined results: null text counts as empty (its end id is a piece of length 1);
rows with null or repeated ids are packed like any other; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qoeflow.llm.common import materialise, release, text_blocks
from qoeflow.llm.tokens import BLOCK_BYTES, default_path, encoder

MAX_LEN = 2048
#: Ranks of one length that share a join key.
RANK_BLOCK = 4096


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN,
           end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids (``with_ids``; little-endian
    unsigned 32-bit), task, task_rank (number within task and length)."""
    def run(batches):
        task = TaskContext.get().partitionId()
        seen = np.zeros(max_len + 1, np.int64)
        enc = encoder(path)
        for b in batches:
            doc_ids = b.column("doc_id").to_pylist()
            for first, end, texts in text_blocks(b.column("text"), BLOCK_BYTES):
                out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids", "task", "task_rank")}
                for doc_id, ids in zip(doc_ids[first:end], enc.encode(texts)):
                    raw = memoryview(np.append(ids, end_id).astype("<u4").tobytes())
                    for k, at in enumerate(range(0, len(raw), 4 * max_len)):
                        part = raw[at:at + 4 * max_len]
                        n = len(part) // 4
                        out["doc_id"].append(doc_id)
                        out["piece"].append(k)
                        out["start"].append(at // 4)
                        out["length"].append(n)
                        out["ids_crc32"].append(zlib.crc32(part))
                        out["ids"].append(bytes(part) if with_ids else None)
                        out["task"].append(task)
                        out["task_rank"].append(int(seen[n]))
                        seen[n] += 1
                yield pa.record_batch(out, schema=arrow)
            release()
    arrow = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                       ("ids_crc32", pa.int64()), ("ids", pa.binary()), ("task", pa.int32()),
                       ("task_rank", pa.int64())])
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
            .mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, task int, "
                             "task_rank long"))


def plan(histogram: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit over counts: rows (length, first rank, pieces, first sequence,
    pieces a sequence, offset).  Piece ``first rank + i`` goes to sequence
    ``first sequence + i // pieces a sequence``, at ``offset`` plus the pieces
    of this row before it there."""
    rows, free = [], {}              # free room -> ranges (first sequence, how many) of sequences with it
    rooms: list[int] = []            # ascending
    sequences = 0

    def put(room, first, n):
        if n and room:
            if room not in free:
                free[room] = []
                insort(rooms, room)
            free[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = free[room].pop()
                if not free[room]:
                    del free[room], rooms[at]
            else:
                room, first, n = max_len, sequences, -(-left // (max_len // length))
                sequences += n
            each = room // length    # the tightest room stays the tightest until the length no longer fits
            whole = min(n, left // each)
            if whole:
                rows.append((length, rank, whole * each, first, each, max_len - room))
                put(room - each * length, first, whole)
                first, n = first + whole, n - whole
                rank, left = rank + whole * each, left - whole * each
            if left and n and left < each:
                rows.append((length, rank, left, first, left, max_len - room))
                put(room - left * length, first, 1)
                first, n, rank, left = first + 1, n - 1, rank + left, 0
            put(room, first, n)
    return rows


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
         max_len: int = MAX_LEN, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset and
    (``with_ids``) ids of every piece."""
    spark = docs.sparkSession
    cut = materialise(pieces(docs, path or default_path(), id_col, text_col, max_len, end_id, with_ids), "pieces")
    counts = materialise(cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = counts.select("length", "task", (F.sum("n").over(
        Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    rows = plan(histogram, max_len)
    planned = spark.createDataFrame(rows, "length long, first long, n long, seq long, each long, at long")
    planned = planned.withColumn("block", F.explode(F.sequence(
        F.floor(F.col("first") / RANK_BLOCK), F.floor((F.col("first") + F.col("n") - 1) / RANK_BLOCK))))
    ranked = (cut.join(before, ["length", "task"]).withColumn("rank", F.col("before") + F.col("task_rank"))
              .withColumn("block", F.floor(F.col("rank") / RANK_BLOCK)))
    i = F.col("rank") - F.col("first")
    out = (ranked.join(planned, ["length", "block"]).filter("rank >= first and rank < first + n")
           .select("doc_id", "piece", "start", "length", "ids_crc32",
                   (F.col("seq") + F.floor(i / F.col("each"))).alias("sequence_id"),
                   (F.col("at") + i % F.col("each") * F.col("length")).alias("offset"), "ids"))
    return out if with_ids else out.drop("ids")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and ids of each sequence of a ``pack`` with ids; a
    group holds at most one sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return (packed.groupBy("sequence_id").agg(parts.alias("p"))
            .select("sequence_id", F.aggregate("p", F.lit(0).cast("bigint"), lambda a, x: a + x["length"])
                    .alias("n_tokens"),
                    F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids")))
