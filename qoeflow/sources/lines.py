"""Text files with their line order (H6).

Text rows carry no order, but every split is read front to back, so the
line order is (file, split start, position within the task).  That stays
right when large files are split or small files are packed into one
task.  The global line number comes from the skew-safe ordinal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qoeflow.operators.ordinals import ordinal_within


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) for every line of the text files under ``path``."""
    df = (spark.read.text(path)
          .withColumn("_file", F.col("_metadata.file_path"))
          .withColumn("_split", F.col("_metadata.file_block_start"))
          .withColumn("_pos", F.monotonically_increasing_id()))
    return (ordinal_within(df, [], ["_file", "_split", "_pos"], "line_no")
            .select("line_no", "value"))
