"""Token files: frequency-ranked ids in byte-aligned variable-length coding.

The id that occurs most often gets rank 0, the next rank 1, and so on (ties by
id).  A rank takes 1 to 4 bytes, little-endian; its length minus one is a 2-bit
code, four codes to a control byte (first value in the lowest bits), kept apart
from the data bytes.  Decoding looks control bytes up in a table of lengths,
sums them to offsets and reads and masks four bytes at each, all in numpy.

A folder holds ``ranks.bin`` (the ids by rank, little-endian unsigned 32-bit)
and one ``shard-NNNNNN.bin`` per range of doc_ids, in ascending doc_id order (a
null id first, equal ids by a hash of the text).  A shard is a row of blocks of
whole documents::

    magic "VTOK" | u32 documents | u64 tokens | u64 control bytes | u64 data bytes
    i64 doc_id per document | u8 doc_id known per document | u64 tokens per document
    control bytes | data bytes

Spark jobs: token ids and their counts per task (one pass over the texts);
ranks from the summed counts, whose number the vocabulary bounds; range
partitioning by doc_id, each partition writing its shard under a temporary name
and renaming it, so that a task can be run again; reading back block by block.

Defined results: null text is empty (its end id only); rows with null or
repeated ids are documents of their own; an empty table writes no shard; other
columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qoeflow.llm.common import materialise, release, scratch, text_blocks
from qoeflow.llm.tokens import BLOCK_BYTES, default_path, encoder

MAGIC = b"VTOK"
_HEAD = struct.Struct("<4sIQQQ")
#: Tokens of a shard and of a block in it.
SHARD_TOKENS = 4 << 20
BLOCK_TOKENS = 1 << 19

#: Lengths of the four values of each control byte.
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
_MASK = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    four = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    four[:len(v)] = code
    four = four.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    return control.tobytes(), data.tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    padded = data + b"\0\0\0"
    words = np.ndarray(len(padded) - 3, "<u4", padded, strides=(1,))
    return words[at] & _MASK[size]


def _block(docs: list, ranks: list[np.ndarray]) -> bytes:
    size = np.array([len(r) for r in ranks], "<u8")
    control, data = encode_values(np.concatenate(ranks))
    ids = np.array([i or 0 for i in docs], "<i8").tobytes() + bytes(i is not None for i in docs)
    return _HEAD.pack(MAGIC, len(docs), int(size.sum()), len(control), len(data)) + ids + size.tobytes() + control + data


def read_blocks(stream):
    """(doc_ids, token counts, ranks) of each block of an open shard."""
    while head := stream.read(_HEAD.size):
        magic, n, tokens, n_control, n_data = _HEAD.unpack(head)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        ids = np.frombuffer(stream.read(8 * n), "<i8").tolist()
        known = stream.read(n)
        size = np.frombuffer(stream.read(8 * n), "<u8").astype(np.int64)
        ranks = decode_values(stream.read(n_control), stream.read(n_data), tokens)
        yield [i if k else None for i, k in zip(ids, known)], size, ranks


def token_ids(docs: DataFrame, path: str, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """doc_id, tie, n and ids (deflated, 16-bit where the vocabulary allows,
    else 32-bit) of every document, and per task a row with only ``counts``
    (deflated counts by id)."""
    def run(batches):
        enc = encoder(path)
        vocab = max(enc.tok.get_vocab_size(), end_id + 1)
        kind = "<u2" if vocab <= 1 << 16 else "<u4"
        counts = np.zeros(vocab, np.int64)
        for b in batches:
            for first, end, texts in text_blocks(b.column("text"), BLOCK_BYTES):
                ids = [np.append(i, end_id) for i in enc.encode(texts)]
                counts += np.bincount(np.concatenate(ids), minlength=vocab)
                m = end - first
                yield pa.record_batch({
                    "doc_id": b.column("doc_id")[first:end], "tie": b.column("tie")[first:end],
                    "n": pa.array([len(i) for i in ids], pa.int64()),
                    "ids": pa.array([zlib.compress(i.astype(kind).tobytes(), 1) for i in ids], pa.binary()),
                    "counts": pa.nulls(m, pa.binary())}, schema=arrow)
            release()
        yield pa.record_batch({"doc_id": [None], "tie": [None], "n": [None], "ids": [None],
                               "counts": [zlib.compress(counts.tobytes(), 1)]}, schema=arrow)
    arrow = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()),
                       ("counts", pa.binary())])
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("tie"),
                        F.col(text_col).cast("binary").alias("text"))
            .mapInArrow(run, "doc_id long, tie long, n long, ids binary, counts binary"))


def _ranks(ids: DataFrame) -> np.ndarray:
    """Ids by descending frequency.  The counts are summed by id on the
    executors; the vocabulary bounds what reaches the driver."""
    def run(batches):
        total = None
        for b in batches:
            for c in b.column("counts"):
                one = np.frombuffer(zlib.decompress(c.as_py()), np.int64)
                total = one if total is None else total + one
        if total is not None:
            used = np.flatnonzero(total)
            yield pa.record_batch({"id": pa.array(used, pa.int64()), "n": pa.array(total[used])})
    rows = (ids.filter("counts is not null").select("counts").mapInArrow(run, "id long, n long")
            .groupBy("id").agg(F.sum("n").alias("n")).collect())
    rows.sort(key=lambda r: (-r["n"], r["id"]))
    return np.array([r["id"] for r in rows], np.uint32)


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri)


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text", end_id: int = 1, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the token files; returns their manifest: shard, path, documents,
    tokens, start (tokens of all shards before)."""
    path = path or default_path()
    ids = materialise(token_ids(docs, path, id_col, text_col, end_id), "token-ids")
    by_rank = _ranks(ids)
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    rows = ids.filter("counts is null").select("doc_id", "tie", "n", "ids")
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    fs, base = _open(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/ranks.bin") as f:
        f.write(by_rank.astype("<u4").tobytes())

    def run(batches):
        ctx = TaskContext.get()
        fs, base = _open(folder)
        name = f"{base}/shard-{ctx.partitionId():06d}.bin"
        out, docs_n, tokens = None, 0, 0
        held_ids, held, size = [], [], 0

        def flush():
            nonlocal held_ids, held, size
            if held_ids:
                out.write(_block(held_ids, held))
            held_ids, held, size = [], [], 0

        for b in batches:
            if out is None and b.num_rows:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{name}.tmp-{ctx.taskAttemptId()}")
            for doc_id, n, raw in zip(b.column("doc_id").to_pylist(), b.column("n").to_pylist(), b.column("ids")):
                raw = zlib.decompress(raw.as_py())
                held_ids.append(doc_id)
                held.append(rank_of[np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")])
                size += n
                docs_n, tokens = docs_n + 1, tokens + n
                if size >= BLOCK_TOKENS:
                    flush()
        if out is not None:
            flush()
            out.close()
            fs.move(f"{name}.tmp-{ctx.taskAttemptId()}", name)
            yield pa.record_batch({"shard": pa.array([ctx.partitionId()], pa.int32()), "documents": [docs_n],
                                   "tokens": [tokens]})

    shards = max(1, -(-total // shard_tokens))
    written = (rows.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
               .mapInArrow(run, "shard int, documents long, tokens long"))
    written = materialise(written, "token-manifest")
    before = F.sum("tokens").over(Window.orderBy("shard")) - F.col("tokens")
    return written.select("shard", F.format_string(f"{folder.replace('%', '%%')}/shard-%06d.bin", "shard").alias("path"),
                          "documents", "tokens", before.alias("start"))


def read_tokens(spark: SparkSession, manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and (``with_ids``) ids, as
    little-endian unsigned 32-bit, of every document, from the files."""
    def run(batches):
        fs, base = _open(folder)
        with fs.open_input_stream(f"{base}/ranks.bin") as f:
            by_rank = np.frombuffer(f.read(), "<u4")
        for b in batches:
            for shard, at in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                with fs.open_input_stream(f"{base}/{os.path.basename(shard)}") as f:
                    for docs, size, ranks in read_blocks(f):
                        raw = memoryview(by_rank[ranks].astype("<u4").tobytes())
                        cut = np.concatenate([[0], np.cumsum(size)])
                        parts = [raw[4 * a:4 * z] for a, z in zip(cut[:-1].tolist(), cut[1:].tolist())]
                        yield pa.record_batch({
                            "doc_id": pa.array(docs, pa.int64()), "start": pa.array(at + cut[:-1], pa.int64()),
                            "n_tokens": pa.array(size, pa.int64()),
                            "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                            "ids": pa.array([bytes(p) if with_ids else None for p in parts], pa.binary())})
                        at += int(cut[-1])
    # a range for each shard: a given number of partitions is not coalesced, and no two hash alike
    out = (manifest.repartitionByRange(max(1, manifest.count()), "shard").select("path", "start")
           .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"))
    return out if with_ids else out.drop("ids")


def token_round_trip(docs: DataFrame, folder: str | None = None, **kw) -> DataFrame:
    """Write the files and read them back: one row per document."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "token-files")
    return read_tokens(spark, write_tokens(docs, folder, **kw), folder)
