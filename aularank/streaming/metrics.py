"""STR-2: daily metrics maintained from the interaction-log stream.

Three ways, for three readers:

* ``daily_metrics_stream``: days of event time with a watermark, in update mode.  The state holds the days that the
  watermark has not closed; a row that comes later than ``delay`` is left out.
* ``start_daily_metrics``: the whole report again with every batch, from one state row per day and task.
* ``start_daily_sums`` and ``daily_report``: mergeable sums.  A batch adds its own counts for the days and tasks that it holds, so a row of
  any age corrects its day, days without new rows are not written again, and the stream keeps no state.  On a bounded input
  the report equals the batch report ``logs.daily_metrics``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aularank.functions.columns import round_half_away
from aularank.operators.logs import metric_columns

SUMS_SCHEMA = "fecha date, tarea string, consultas long, latencias long, latencia_total long, tokens_totales long"


def daily_metrics_stream(log_stream: DataFrame, tz: str | None = None, delay: str | None = None) -> DataFrame:
    """LOG-1 over a stream, with the same day boundaries.

    With ``delay`` (such as "2 days") a day closes when a row of a day that much later was read: its state goes, and rows
    that still come for it are left out.
    """
    keys, aggregates = metric_columns(log_stream, tz)
    if delay is None:
        return log_stream.groupBy(*keys).agg(*aggregates)
    dated = log_stream.withColumn("_day", keys[0].cast("timestamp")).withWatermark("_day", delay)
    return dated.groupBy("_day", *keys).agg(*aggregates).drop("_day")


def day_sums(log: DataFrame, tz: str | None = None) -> DataFrame:
    """Mergeable sums per day and task: rows, latencies that are known, their sum, tokens."""
    keys, _ = metric_columns(log, tz)
    tokens = F.coalesce(F.col("tokens_entrada"), F.lit(0)) + F.coalesce(F.col("tokens_salida"), F.lit(0))
    return log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("consultas"),
        F.count("latencia_ms").alias("latencias"),
        F.sum(F.col("latencia_ms").cast("long")).alias("latencia_total"),
        F.sum(tokens.cast("long")).alias("tokens_totales"),
    )


def _merged(sums: DataFrame) -> DataFrame:
    return sums.groupBy("fecha", "tarea").agg(*[F.sum(c).alias(c) for c in ("consultas", "latencias", "latencia_total", "tokens_totales")])


def _folder(spark: SparkSession, path: str, number: str) -> DataFrame:
    """Sums with the number of the batch that wrote them; a folder not written yet is empty."""
    schema = f"{SUMS_SCHEMA}, {number} long"
    try:
        return spark.read.schema(schema).option("basePath", path).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _live(spark: SparkSession, path: str) -> DataFrame:
    """The newest base and the sums of the batches after it."""
    bases = _folder(spark, f"{path}/bases", "upto")
    done = _folder(spark, f"{path}/based", "upto").agg(F.max("upto")).first()[0]
    done = -1 if done is None else done
    later = _folder(spark, f"{path}/sums", "batch").where(F.col("batch") > done).drop("batch")
    return bases.where(F.col("upto") == done).drop("upto").unionByName(later)


def merge_batch(log: DataFrame, path: str, batch_id: int, tz: str | None = None, base_every: int = 100) -> None:
    """Adds one batch: its sums go to ``<path>/sums/batch=<id>``, which a retry replaces as a whole.

    Each ``base_every``-th batch writes all sums up to itself to ``<path>/bases`` and, when that is complete, a mark to
    ``<path>/based``, so that a reader meets one base and less than ``base_every`` small folders.  Batches come in order.
    """
    spark = log.sparkSession
    day_sums(log, tz).coalesce(1).write.mode("overwrite").parquet(f"{path}/sums/batch={batch_id}")
    if (batch_id + 1) % base_every == 0:
        # A retry of this batch has its own mark already, so the base is made from what lies before it.
        earlier = _folder(spark, f"{path}/based", "upto").where(F.col("upto") < batch_id).agg(F.max("upto")).first()[0]
        earlier = -1 if earlier is None else earlier
        whole = _folder(spark, f"{path}/bases", "upto").where(F.col("upto") == earlier).drop("upto").unionByName(
            _folder(spark, f"{path}/sums", "batch").where((F.col("batch") > earlier) & (F.col("batch") <= batch_id)).drop("batch"))
        _merged(whole).write.mode("overwrite").parquet(f"{path}/bases/upto={batch_id}")
        mark = spark.createDataFrame([(None, None, 0, 0, 0, 0)], SUMS_SCHEMA)
        mark.coalesce(1).write.mode("overwrite").parquet(f"{path}/based/upto={batch_id}")


def daily_report(spark: SparkSession, path: str) -> DataFrame:
    """The report as ``logs.daily_metrics`` gives it, from the sums of all batches."""
    mean = round_half_away(F.col("latencia_total") / F.when(F.col("latencias") > 0, F.col("latencias")), 0)
    return _merged(_live(spark, path)).select("fecha", "tarea", "consultas", mean.alias("latencia_promedio_ms"), "tokens_totales") \
        .orderBy(F.col("fecha").desc(), F.col("tarea").asc())


def start_daily_sums(log_stream: DataFrame, path: str, checkpoint: str, tz: str | None = None,
                     available_now: bool = False, base_every: int = 100):
    """Keeps the sums that ``daily_report`` reads; a batch writes only the days that it holds."""
    return _start(log_stream.writeStream.foreachBatch(lambda batch, number: merge_batch(batch, path, number, tz, base_every)),
                  checkpoint, available_now)


def start_daily_metrics(log_stream: DataFrame, path: str, checkpoint: str, tz: str | None = None,
                        available_now: bool = False):
    """Keeps the report in ``<path>/batch=<id>``: each batch writes the whole small report, a retried batch replaces
    its own folder.  The newest folder is the report."""

    def write(report: DataFrame, batch_id: int) -> None:
        report.write.mode("overwrite").parquet(f"{path}/batch={batch_id:012d}")

    return _start(daily_metrics_stream(log_stream, tz).writeStream.outputMode("complete").foreachBatch(write), checkpoint, available_now)


def _start(writer, checkpoint: str, available_now: bool):
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
