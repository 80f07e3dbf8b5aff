"""Session helpers: builder defaults and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app: str = "qoeflow", extra: dict | None = None) -> SparkSession:
    """Session with the settings the library assumes (UTC, AQE, no UI)."""
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.sql.parquet.aggregatePushdown", "true"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by ``spark.checkpoint.dir``.

    Unset, it is the one of ``setCheckpointDir``; if there is none either, a
    fresh local folder for a ``local`` or ``local[...]`` master (one process)
    and one below the warehouse for others.  It is registered, so that
    ``DataFrame.checkpoint()`` works too.

    The name of a folder of the local file system (``file:``, or no scheme
    where that is the default) does not tell whether all machines mount it.  On
    a cluster it is tried once a session (``all_see``), and one that loses what
    tasks write is an error.  A ``local-cluster`` master is one machine.
    """
    sc = spark.sparkContext
    one_process = sc.master == "local" or sc.master.startswith("local[")
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        d = (tempfile.mkdtemp(prefix="qoeflow-ckpt-") if one_process
             else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_qoeflow")
    fs, p = file_system(spark, d)
    if fs.getUri().getScheme() != "file":
        d = fs.makeQualified(p).toString()       # for readers that do not know Spark's default file system
    elif not sc.master.startswith("local") and not all_see(spark, d):
        raise RuntimeError(f"{d} is a folder of one machine: rows that tasks wrote there were lost; set "
                           "spark.checkpoint.dir to one that driver and executors share (HDFS/S3/a shared mount)")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


_seen: set[tuple[str, str]] = set()              # (application, folder) that passed


def all_see(spark: SparkSession, folder: str) -> bool:
    """Whether a table that tasks on all cores write below ``folder`` is read
    back whole."""
    sc = spark.sparkContext
    if (sc.applicationId, folder) not in _seen:
        n, path = max(2, sc.defaultParallelism), f"{folder.rstrip('/')}/qoeflow/seen-{uuid.uuid4().hex[:12]}"
        spark.range(0, n, 1, n).write.parquet(path)
        if spark.read.schema("id long").parquet(path).count() != n:
            return False
        _seen.add((sc.applicationId, folder))
    return True


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique sub-path of the shared folder for one run."""
    return f"{shared_dir(spark).rstrip('/')}/qoeflow/{name}-{uuid.uuid4().hex[:12]}"


def file_system(spark: SparkSession, path: str):
    """Hadoop file system and path object of ``path`` (metadata operations
    only: existence, listing, renaming; data is read and written by jobs)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; empty if there is no such folder.  Any other
    failure to list is an error."""
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p))


def write_once(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table below the shared folder: read several times without
    being computed again, and safe against lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
