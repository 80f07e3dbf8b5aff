"""As-of join: for each row the last row of another table at or before its time.

Both sides are partitioned by (key, block of time), so that a key with a third
of all rows is many tasks.  Inside a block the match is the last one seen in
time order; a row before the first match of its block takes the block's carry,
the last match of the key's earlier blocks.  Carries are made from one row per
(key, block), which is all that a window over a whole key ever sees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Right-hand rows that a block holds if they are spread evenly over time.
BLOCK_ROWS = 1 << 16


def block_width(right: DataFrame, on: str, rows: int = BLOCK_ROWS) -> float:
    """Width of time blocks of about ``rows`` rows each, if all rows had one key."""
    c = F.col(on).cast("double")
    lo, hi, n = right.select(F.min(c), F.max(c), F.count(c)).first()
    return 1.0 if lo is None or hi == lo else (hi - lo) / max(1, -(-n // rows))


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str, payload: list[str],
              name: str = "matched", strict: bool = False, width: float | None = None,
              ties: list[str] | None = None) -> DataFrame:
    """``left`` with ``name``: a struct of the ``payload`` columns of the last
    ``right`` row of the same keys whose ``right_on`` is at or before (``strict``:
    before) ``left_on``; null if there is none, or if a key or the time is null.

    Times are numbers.  Of equal times the row with the largest ``ties`` (by
    default the largest payload) wins.  ``width`` is the width of a time block.
    """
    if width is None:
        width = block_width(right, right_on)
    ks = [f"_k{i}" for i in range(len(keys))]
    block = F.floor(F.col("_t") / F.lit(width)).cast("bigint").alias("_b")
    l = left.select(*[F.col(k).alias(a) for k, a in zip(keys, ks)], F.col(left_on).alias("_t"),  # noqa: E741
                    F.struct(*[F.col(c) for c in left.columns]).alias("_row"))
    r = right.dropna(subset=[*keys, right_on]).select(
        *[F.col(k).alias(a) for k, a in zip(keys, ks)], F.col(right_on).alias("_t"),
        F.struct(*[F.col(c) for c in (ties or payload)]).alias("_o"), F.struct(*[F.col(c) for c in payload]).alias("_p"))
    # of equal times the side that comes second sees the first
    both = (r.select("*", block, F.lit(1 if strict else 0).alias("_side"))
            .unionByName(l.select("*", block, F.lit(0 if strict else 1).alias("_side")), allowMissingColumns=True))
    seen = (Window.partitionBy(*ks, "_b").orderBy("_t", "_side", "_o")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    asked = both.withColumn("_in", F.last("_p", ignorenulls=True).over(seen)).where(F.col("_row").isNotNull())
    ends = both.groupBy(*ks, "_b").agg(
        F.max_by("_p", F.when(F.col("_p").isNotNull(), F.struct("_t", "_o"))).alias("_end"))
    earlier = Window.partitionBy(*ks).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*ks, "_b", F.last("_end", ignorenulls=True).over(earlier).alias("_carry"))
    return (asked.join(carry.where(F.col("_carry").isNotNull()), [*ks, "_b"], "left")
            .select("_row.*", F.coalesce("_in", "_carry").alias(name)))
