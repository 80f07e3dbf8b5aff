"""The failover result log, CSV lines ``url_idx,mode,cost``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "url_idx INT, mode STRING, cost DOUBLE"


def _complete():
    return F.col("_r.url_idx").isNotNull() & F.col("_r.cost").isNotNull()


def parse_result_log(lines: DataFrame, value: str = "value") -> DataFrame:
    """CSV text with a line-number column -> typed rows; ``result_log_rejects``
    has the other lines."""
    p = lines.withColumn("_r", F.from_csv(F.col(value), SCHEMA))
    return p.where(_complete()).select("line_no", "_r.url_idx", "_r.mode", "_r.cost")


def result_log_rejects(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines without a frontend number or a cost, as they came."""
    p = lines.withColumn("_r", F.from_csv(F.col(value), SCHEMA))
    return p.where(~F.coalesce(_complete(), F.lit(False))).drop("_r")


def read_result_log(spark: SparkSession, path: str) -> DataFrame:
    """Read log files with their line order (see ``sources.lines``)."""
    from qoeflow.sources.lines import read_lines
    return parse_result_log(read_lines(spark, path))
