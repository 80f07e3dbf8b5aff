"""Helpers shared by the operators: scratch tables, tables of a data folder,
row blocks and 64-bit mixing in numpy."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from qoeflow.session import shared_dir

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, which every executor reaches."""
    return f"{shared_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below the shared folder and read it back: later uses
    neither recompute it nor depend on an executor that may be lost."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (fixed public constants), element-wise."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """``n`` pseudo-random 64-bit values from a rule, equal everywhere."""
    return mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def blocks(sizes, limit: int):
    """Consecutive ``(first, end)`` row ranges whose sizes add up to about
    ``limit``; a row above the limit has a range of its own."""
    first, total = 0, 0
    for i, s in enumerate(sizes):
        if i > first and total + s > limit:
            yield first, i
            first, total = i, 0
        total += s
    if first < len(sizes):
        yield first, len(sizes)


def text_blocks(column: pa.Array, limit: int):
    """(first, end, texts) of consecutive rows of a binary column, about
    ``limit`` bytes each: of a whole Arrow batch only one block is held as
    Python objects.  A null is empty."""
    sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    for first, end in blocks(sizes.tolist(), limit):
        yield first, end, [t or b"" for t in column.slice(first, end - first).to_pylist()]


def release() -> None:
    """Give memory that a worker no longer uses back to the system: workers are
    used again by later stages, which share the executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):        # another C library
        pass


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def unsigned(x) -> np.ndarray:
    return np.ascontiguousarray(np.asarray(x, dtype=np.int64)).view(U64)
