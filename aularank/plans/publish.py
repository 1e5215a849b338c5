"""SNK-5: versioned model tables and encoders, and immutable pointers.

A refresh writes every derived table under ``<base>/v=<version>/<name>`` and only then appends one pointer row to
``<base>/versions``.  Nothing is overwritten or deleted there, so a reader always sees the newest complete version;
a failed build leaves the previous one in service.  Paths must be on shared storage (the cluster's file system).
"""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from aularank.plans.recommend import TABLES, Model


def publish_model(model: Model, base: str, version: int | str) -> str:
    root = f"{base}/v={version}"
    for name in TABLES:
        model.table(name).write.mode("overwrite").parquet(f"{root}/{name}")
    return _point(model.catalog.sparkSession, base, version, root)


def _point(spark: SparkSession, base: str, version: int | str, root: str) -> str:
    spark.createDataFrame([(str(version), root, time.time_ns())], "version string, path string, published long") \
        .coalesce(1).write.mode("append").parquet(f"{base}/versions")
    return root


def publish_encoder(spark: SparkSession, encoder: PipelineModel, base: str, version: int | str) -> str:
    """VEC-1: stores what ``retrieval.fit_encoder`` returned under a version of its own."""
    root = f"{base}/v={version}"
    encoder.write().overwrite().save(f"{root}/encoder")
    return _point(spark, base, version, root)


def load_encoder(spark: SparkSession, base: str) -> PipelineModel:
    """The newest published encoder: the same for passages and queries."""
    root = current_version(spark, base)
    if root is None:
        raise FileNotFoundError(f"no encoder published under {base}")
    return PipelineModel.load(f"{root}/encoder")


def current_version(spark: SparkSession, base: str) -> str | None:
    """The newest published version's folder; None only where nothing was published."""
    try:
        pointers = spark.read.schema("version string, path string, published long").parquet(f"{base}/versions")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    row = pointers.orderBy(F.col("published").desc()).first()
    return None if row is None else row["path"]


def load_model(spark: SparkSession, base: str) -> Model:
    root = current_version(spark, base)
    if root is None:
        raise FileNotFoundError(f"no model published under {base}")
    return Model({name: lambda name=name: spark.read.parquet(f"{root}/{name}") for name in TABLES})
