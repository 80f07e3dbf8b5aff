"""Topics as streams.

``read_topic``/``write_topic`` take the format as a parameter: ``kafka``
in production (needs the Kafka connector on the classpath; not present
in this test environment, so that path is untested here), a file format
in tests.  Either way a row is (topic, value) and the sink routes each
row by its ``topic`` column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def broker_list(hosts: str, port: int = 9092) -> str:
    """A comma-separated host list as a broker list: every host with the port."""
    return hosts.replace(",", f":{port},") + f":{port}"


def read_topic(spark: SparkSession, fmt: str, options: dict, schema: str | None = None) -> DataFrame:
    """A string topic as a stream of ``value`` rows.

    kafka: options need ``kafka.bootstrap.servers`` and ``subscribe``;
    starts at latest unless told otherwise.  Files: option ``path``.
    """
    r = spark.readStream.format(fmt)
    if fmt == "kafka":
        options = {"startingOffsets": "latest", **options}
    elif schema:
        r = r.schema(schema)
    opts = {k: v for k, v in options.items() if k != "path"}
    df = r.options(**opts).load(options.get("path")) if "path" in options else r.options(**opts).load()
    if fmt == "kafka":
        df = df.select(F.col("topic"), F.col("value").cast("string").alias("value"),
                       F.col("offset").alias("seq"))
    return df


def spool_source(spark: SparkSession, path: str, max_files: int | None = None,
                 clean: str | None = None, archive_dir: str | None = None) -> DataFrame:
    """A spool folder of JSON-line files, each line read once.

    The file-source log gives exactly-once reads across restarts;
    ``clean='archive'|'delete'`` removes processed files like the
    reference's claim-read-delete loop."""
    r = spark.readStream.format("text")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    if clean:
        r = r.option("cleanSource", clean)
        if archive_dir:
            r = r.option("sourceArchiveDir", archive_dir)
    return r.load(path)


def write_topic(df: DataFrame, fmt: str, options: dict, checkpoint: str,
                trigger: dict | None = None):
    """Each row to the topic named in its ``topic`` column."""
    w = df.select("topic", "value").writeStream.option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"availableNow": True}))
    if fmt == "kafka":
        return w.format("kafka").options(**options).start()
    return w.format(fmt).partitionBy("topic").options(**options).start()
