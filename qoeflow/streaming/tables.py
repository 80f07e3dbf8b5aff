"""Tables written by streams.

``MergeTable`` is a keyed table that a batch changes without rewriting it: each
batch adds a small delta, and only what has grown is merged.  A folder of whole
versions ``v=<n>`` (``write_version``) is for small tables that are replaced.

Either way batch ``n`` reads what batches below ``n`` have written and writes
under its own number, so a batch that runs again starts from the same rows and
rewrites its own.  Only a missing folder counts as "nothing yet"; a listing or
read that fails fails the batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qoeflow.session import file_system, list_folder


class MergeTable:
    """A table of one row per key, the newest by (``order``, batch), in hash
    buckets.

    Layout: ``buckets=<B>/level<l>/b=<n>/bucket=<k>`` and ``buckets=<B>/base/...``.
    A batch writes its rows to ``level0/b=<batch>``.  When a level holds ``fan``
    folders that nothing covers, the next batch merges them into one folder of
    the next level; when the levels of a bucket outgrow ``ratio`` times its base,
    the next batch merges base and levels of that bucket (and of no other) into
    a new base.  A folder ``b=<n>`` covers what lower levels hold up to batch n.
    So the bytes a batch writes follow the batch's rows (times the logarithm of
    the table's size over the batch's), not the table.

    Merging takes batches below the running one only: they are complete, and a
    batch that runs again finds the same rows.  A merge that died leaves a
    folder without a success marker, which counts as nothing.  Reading a row
    that was merged already does no harm, because the newest row wins; covered
    folders stay for one more batch, for readers that have listed them.

    ``by`` (default: the key) are the columns whose hash gives the bucket; give
    a part of the key to read all rows of, say, some groups from their buckets.
    ``alive`` (a condition on the rows, given the batch) lets merges into the
    base drop rows that no reader wants any more.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, keys: list[str],
                 by: list[str] | None = None, order: list[str] | None = None, buckets: int = 16, ratio: float = 0.5,
                 fan: int = 8, alive: Callable[[int], Column] | None = None):
        self.spark, self.keys, self.by, self.order = spark, keys, by or keys, order or []
        self.ratio, self.fan, self.alive = ratio, fan, alive
        self.schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
        known = [x for x in list_folder(spark, path) if x.startswith("buckets=")]
        self.buckets = int(known[0].split("=")[1]) if known else buckets      # fixed by the first batch
        self.path = f"{path}/buckets={self.buckets}"

    # ------------------------------------------------------------- folders
    def _folders(self, level: str) -> list[int]:
        """Batches of the complete folders of a level, ascending."""
        out = []
        for name in list_folder(self.spark, f"{self.path}/{level}"):
            fs, marker = file_system(self.spark, f"{self.path}/{level}/{name}/_SUCCESS")
            if name.startswith("b=") and fs.exists(marker):
                out.append(int(name[2:]))
        return sorted(out)

    def _sizes(self, level: str, n: int) -> dict[int, int]:
        """Bytes by bucket of a folder."""
        fs, p = file_system(self.spark, f"{self.path}/{level}/b={n}")
        return {int(s.getPath().getName()[7:]): int(fs.getContentSummary(s.getPath()).getLength())
                for s in fs.listStatus(p) if s.getPath().getName().startswith("bucket=")}

    def _levels(self) -> list[str]:
        names = [x for x in list_folder(self.spark, self.path) if x.startswith("level")]
        return sorted(names, key=lambda x: -int(x[5:]))                        # highest first

    def _live(self, before: int | None) -> tuple[dict, dict]:
        """What readers need, folder (level, n) -> {bucket: bytes}, and the
        rest, which newer merges cover."""
        live: dict[tuple[str, int], dict[int, int]] = {}
        rest: dict[tuple[str, int], dict[int, int]] = {}
        cover = {k: -1 for k in range(self.buckets)}
        ok = lambda n: before is None or n < before
        for n in reversed([n for n in self._folders("base") if ok(n)]):
            for k, size in self._sizes("base", n).items():
                (live if n > cover[k] else rest).setdefault(("base", n), {})[k] = size
                cover[k] = max(cover[k], n)
        for level in self._levels():
            newest = dict(cover)
            for n in [n for n in self._folders(level) if ok(n)]:
                for k, size in self._sizes(level, n).items():
                    (live if n > cover[k] else rest).setdefault((level, n), {})[k] = size
                if level != "level0":                   # it covers all buckets of the levels below it
                    newest = {k: max(x, n) for k, x in newest.items()}
            cover = newest
        return live, rest

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    # ------------------------------------------------------------- reading
    def _rows(self, folders: dict, buckets=None) -> DataFrame:
        """All stored rows of some folders, with their batch."""
        stored = T.StructType([*self.schema.fields, T.StructField("_batch", T.LongType())])
        paths = [f"{self.path}/{level}/b={n}/bucket={k}" for (level, n), sizes in folders.items() for k in sizes
                 if buckets is None or k in buckets]
        if not paths:
            return self.spark.createDataFrame([], stored)
        return self.spark.read.schema(stored).parquet(*paths)

    def _newest(self, rows: DataFrame) -> DataFrame:
        """One row per key."""
        rest = [f.name for f in self.schema.fields if f.name not in self.keys]
        best = F.max_by(F.struct(*rest, "_batch"), F.struct(*self.order, "_batch"))
        return (rows.groupBy(*self.keys).agg(best.alias("_x"))
                .select(*[F.col(f.name) if f.name in self.keys else F.col(f"_x.{f.name}").alias(f.name)
                          for f in self.schema.fields], F.col("_x._batch").alias("_batch")))

    def read(self, before: int | None = None, of: DataFrame | None = None) -> DataFrame:
        """The table as batches below ``before`` left it; ``of``: only the
        buckets of these rows' ``by`` columns (other rows of the buckets
        included)."""
        some = None
        if of is not None:                              # at most ``buckets`` numbers
            some = {r[0] for r in of.select(self.bucket().alias("k")).distinct().collect()}
        return self._newest(self._rows(self._live(before)[0], some)).drop("_batch")

    # ------------------------------------------------------------- writing
    def _write(self, rows: DataFrame, level: str, n: int) -> None:
        rows = rows.withColumn("bucket", self.bucket())
        (rows.repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy("bucket")
         .parquet(f"{self.path}/{level}/b={n}"))

    def merge(self, rows: DataFrame, batch: int) -> DataFrame:
        """Take a batch's rows in; returns them as written (one per key)."""
        self.compact(batch)
        new = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields],
                          F.lit(batch).cast("bigint").alias("_batch"))
        self._write(self._newest(new), "level0", batch)
        mine = self._sizes("level0", batch)
        return self._rows({("level0", batch): mine}).drop("_batch")

    def compact(self, batch: int) -> None:
        """Merge what has grown among the batches below ``batch`` and remove
        what was already covered when the batch before it ran."""
        upto = batch - 1
        for (level, n), sizes in self._live(upto)[1].items():
            for k in sizes:
                fs, p = file_system(self.spark, f"{self.path}/{level}/b={n}/bucket={k}")
                fs.delete(p, True)
        live = self._live(batch)[0]
        base, grown = {}, {}
        for (level, _), sizes in live.items():
            for k, size in sizes.items():
                to = base if level == "base" else grown
                to[k] = to.get(k, 0) + size
        count = len({n for level, n in live if level != "base"})
        due = {k for k, size in grown.items() if (size > self.ratio * base[k] if k in base else count >= self.fan)}
        if due and upto not in self._folders("base"):
            merged = self._newest(self._rows(live, due))
            if self.alive is not None:
                merged = merged.where(self.alive(batch))
            self._write(merged, "base", upto)
            live = self._live(batch)[0]
        for i, level in enumerate(reversed(self._levels())):                   # lowest first
            some = {x: sizes for x, sizes in live.items() if x[0] == level}
            above = f"level{i + 1}"
            if len(some) >= self.fan and upto not in self._folders(above):
                self._write(self._newest(self._rows(some)), above, upto)
                break                                   # one merge of levels a batch


def versions(spark: SparkSession, table: str) -> list[int]:
    """Complete versions (those with a success marker), ascending."""
    out = []
    for name in list_folder(spark, table):
        if name.startswith("v="):
            fs, marker = file_system(spark, f"{table}/{name}/_SUCCESS")
            if fs.exists(marker):
                out.append(int(name[2:]))
    return sorted(out)


def latest_version(spark: SparkSession, table: str, before: int | None = None) -> DataFrame | None:
    """The newest version (below ``before``); None if there is none yet."""
    known = [v for v in versions(spark, table) if before is None or v < before]
    return spark.read.parquet(f"{table}/v={known[-1]}") if known else None


def write_version(df: DataFrame, table: str, version: int, keep: int = 2) -> DataFrame:
    """Write ``v=version``, remove all but the newest ``keep`` versions, and
    return what was written."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{table}/v={version}")
    for old in versions(spark, table)[:-keep]:
        if old < version:
            fs, p = file_system(spark, f"{table}/v={old}")
            fs.delete(p, True)
    return spark.read.parquet(f"{table}/v={version}")
