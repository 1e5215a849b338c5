"""The corpus pipeline: quality rules, near-duplicate removal, decontamination, packing.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and is written as Parquet and
read again before the next.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aularank.llm import op7_quality, op8_decontaminate, op9_simhash, op10_packing
from aularank.llm.common import row_hash, table, use_checkpoint_dir

SHINGLE_WORDS = 4  # the near-duplicate operator's contract
MAX_DISTANCE = 4


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep."""
    judged = op7_quality.quality_rules(docs, table(spark, sf_dir, "labels"))  # the documents' columns come first
    return judged.where("kept").select(*[F.col(f"`{n}`").alias(c) for n, c in zip(judged.columns, docs.columns)])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: that of its smallest doc_id (of equal ids, the smallest row hash)."""
    return op9_simhash.keep_one(docs, shingle=SHINGLE_WORDS, distance=MAX_DISTANCE)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    return op8_decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins of all remaining rows."""
    return op10_packing.pack_documents(docs)


STAGES = [("quality rules", quality), ("near-duplicates", near_dedup), ("decontamination", decontaminate), ("packing", pack)]

#: The classifier's verdicts, the fingerprints' components and best-fit bins have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared checkpoint folder and read again."""
    base = f"{use_checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        out.write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
