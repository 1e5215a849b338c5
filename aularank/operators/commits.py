"""All-or-nothing log batches (SNK-3): both tables of a batch become visible by one manifest row.

A run of a batch writes its interactions and its recommendation details into folders of its own attempt and then appends one
row to the manifest.  Readers see the rows of the newest committed attempt of each batch: a run that stops between the
tables leaves nothing to see, and a run that is repeated, with fewer rows or others, replaces the earlier one as a whole.
Nothing that is written is changed later, so a lost executor or a second driver cannot tear a batch.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG, DETAILS, MANIFEST = "conversaciones_agente", "recomendaciones_detalle", "manifest"
MANIFEST_SCHEMA = "batch_id string, attempt string, committed_at long, n_log long, n_details long"


def write_attempt(df: DataFrame, root: str, table: str, attempt: str) -> None:
    """Rows of one attempt, laid out by day and, where they have one, task."""
    out = df.withColumn("dia", F.to_date("timestamp"))
    keys = ["dia"]
    if "tarea" in df.columns:
        out, keys = out.withColumn("tarea_", F.col("tarea")), ["dia", "tarea_"]
    out.write.mode("errorifexists").partitionBy(*keys).parquet(f"{root}/{table}/attempt={attempt}")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The newest committed attempt of each batch; of equal times the larger attempt id."""
    rows = _read(spark, f"{root}/{MANIFEST}", MANIFEST_SCHEMA)
    return rows.groupBy("batch_id").agg(F.max(F.struct("committed_at", "attempt", "n_log", "n_details")).alias("x")).select("batch_id", "x.*")


def commit_batch(log: DataFrame, details: DataFrame, root: str, batch_id: str, before_manifest=None) -> str:
    """Writes both tables of a batch and then its manifest row; returns the attempt's id.

    A failure at any point raises and leaves the batch as it was.  ``before_manifest``, if given, is called after both tables
    are written (a check that may still refuse the batch by raising).
    """
    spark = log.sparkSession
    attempt = uuid.uuid4().hex
    write_attempt(log, root, LOG, attempt)
    write_attempt(details, root, DETAILS, attempt)
    if before_manifest is not None:
        before_manifest()
    counts = [_attempt(spark, root, t, attempt, df.schema).count() for t, df in ((LOG, log), (DETAILS, details))]
    row = spark.createDataFrame([(batch_id, attempt, time.time_ns(), *counts)], MANIFEST_SCHEMA)
    row.coalesce(1).write.mode("append").parquet(f"{root}/{MANIFEST}")
    return attempt


def _attempt(spark: SparkSession, root: str, table: str, attempt: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{root}/{table}/attempt={attempt}")


def committed(spark: SparkSession, root: str, table: str, schema) -> DataFrame:
    """Rows of a table (with its own columns, ``batch_id`` and the layout columns) that a committed batch holds.

    The manifest meets the folders in a join on the attempt, which also keeps Spark from reading other attempts'
    files.  ``schema``: that of the rows, so that a table without a batch is an empty one.
    """
    rows = spark.createDataFrame([], schema).withColumns({"attempt": F.lit(None).cast("string"), "dia": F.lit(None).cast("date")})
    if "tarea" in rows.columns:
        rows = rows.withColumn("tarea_", F.lit(None).cast("string"))
    found = _read(spark, f"{root}/{table}", rows.schema)
    return found.join(manifest(spark, root).select("attempt", "batch_id"), "attempt").drop("attempt")


def uncommitted(spark: SparkSession, root: str, table: str, schema) -> DataFrame:
    """(attempt): folders that no manifest row names any more or yet; a clean-up may remove those that no running job owns."""
    rows = spark.createDataFrame([], schema).withColumn("attempt", F.lit(None).cast("string"))
    return _read(spark, f"{root}/{table}", rows.schema).select("attempt").distinct().join(manifest(spark, root), "attempt", "left_anti")
