"""The corpus pipeline: documents in, packed training sequences out.

Stages work on what the one before kept, each on a written table:

* ``quality``: documents that the co-trained classifier rejects go;
* ``near_dedup``: of each SimHash component (4-word shingles, at most 4 bits)
  the document with the smallest id stays;
* ``decontaminate``: documents that hold a benchmark item go;
* ``secrets``: secrets are replaced by ``[secret]`` (and ``n_chars`` follows);
  every document stays;
* ``pack``: best-fit packing; one row per piece.

No SQL can express the tokenizer or the classifier, so ``ORACLE_SQL`` is None
and tests compare each stage with a plain version.

Defined results: null and empty texts are documents like any other (a stage's
operator says what it makes of them); repeated rows count once after near_dedup;
an empty table gives an empty result; columns beside those of documents stay to
the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qoeflow.llm import decontaminate, packing, quality, secret_scan, simhash
from qoeflow.llm.common import fresh, materialise, scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, n=4, max_distance=4)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ledger = secret_scan.update_ledger(spark, docs, scratch(spark, "ledger"), new=True)
    old = fresh(docs, "old_length")
    masked = secret_scan.mask(docs.withColumn(old, F.length("text")), ledger)
    changed = F.length("text") - F.col(old)
    return masked.withColumn("n_chars", F.col("n_chars") + F.coalesce(changed, F.lit(0))).drop(old)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("decontaminate", decontaminate_stage),
          ("secrets", secrets_stage), ("pack", pack_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
