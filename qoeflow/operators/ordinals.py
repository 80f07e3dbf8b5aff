"""Skew-safe ordinals.

``row_number() over (partition by k order by o)`` puts a whole partition
key into one task: with two sources, or one hot (minute, decision), that
is a third of the data in one task.  Instead:

1. range-partition the rows by (k, o) into P partitions and sort within
   them (a hot key spreads over many partitions);
2. number rows inside each partition with ``monotonically_increasing_id``
   (partition index << 33 + position), minus the first id of the
   (partition, key) run;
3. count rows per (partition, key) -- a table of at most
   #keys + P rows -- and turn it into running offsets per key;
4. join the offsets back on (partition, key).

Steps 2 and 3 read the numbered rows twice.  Range-partition bounds come
from a sample seeded with the RDD id, so two evaluations may cut the
ranges differently; the numbered frame is therefore materialised once
with a reliable ``checkpoint()`` in the shared checkpoint folder (which
also cuts the lineage, so a lost executor re-reads it instead of
recomputing).  The order columns must be unique within a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qoeflow.session import shared_dir


def ordinal_within(df: DataFrame, part: list[str], order: list[str], name: str = "ord",
                   n_parts: int | None = None) -> DataFrame:
    """Add a 1-based ordinal of each row within ``part`` ordered by ``order``."""
    spark = df.sparkSession
    shared_dir(spark)
    # Without an explicit count AQE may coalesce adjacent ranges to the
    # advisory partition size -- order across partitions is kept.
    ranged = (df.repartitionByRange(n_parts, *part, *order) if n_parts
              else df.repartitionByRange(*part, *order))
    r = (ranged
           .sortWithinPartitions(*part, *order)
           .withColumn("_pid", F.spark_partition_id())
           .withColumn("_idx", F.monotonically_increasing_id())
           .checkpoint(eager=True))
    runs = r.groupBy("_pid", *part).agg(F.min("_idx").alias("_first"), F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(*part).orderBy("_pid") if part else Window.orderBy("_pid")
    runs = runs.withColumn("_off", F.sum("_cnt").over(w) - F.col("_cnt"))
    out = r.join(runs.select("_pid", *part, "_first", "_off"), ["_pid", *part], "inner")
    return (out.withColumn(name, (F.col("_off") + F.col("_idx") - F.col("_first") + 1).cast("bigint"))
               .drop("_pid", "_idx", "_first", "_off"))


def ordinal_by_number(df: DataFrame, part: list[str], key: str, name: str = "ord",
                      bucket: int = 1 << 16) -> DataFrame:
    """Ordinal within ``part`` ordered by a unique integer ``key`` (e.g. a
    line number), without a checkpoint.

    Buckets are arithmetic (``key div bucket``), so every evaluation cuts the
    rows the same way; a bucket holds at most ``bucket`` rows of a part
    because the key is unique, so a hot part spreads over many buckets.
    Counts per (part, bucket) -- a small table -- give running offsets;
    ``row_number`` inside each (part, bucket) gives the rest.

    The key must be dense, like line numbers: the counts table has one row
    per non-empty bucket, about rows / ``bucket`` for dense keys.  Sparse
    keys (timestamps in microseconds, hashes) would give a bucket per row
    and a hot part's offset window would hold all its rows -- use
    ``ordinal_within`` for those."""
    b = df.withColumn("_b", F.floor(F.col(key) / bucket).cast("bigint"))
    counts = b.groupBy(*part, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(*part).orderBy("_b") if part else Window.orderBy("_b")
    offs = counts.select(*part, "_b", (F.sum("_cnt").over(w) - F.col("_cnt")).alias("_off"))
    rn = F.row_number().over(Window.partitionBy(*part, "_b").orderBy(key))
    return (b.join(offs, [*part, "_b"], "inner")
             .withColumn(name, (F.col("_off") + rn).cast("bigint"))
             .drop("_b", "_off"))
