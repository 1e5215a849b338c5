"""STR-1: keep the derived recommender tables fresh as enrolments arrive.

Newly arrived enrolment files are picked up by a file stream; each
micro-batch becomes a partition of the enrolment table named by its batch id, which a retry replaces, the model is rebuilt from the
whole table (catalog-level quantities such as the newest year and every
popularity normaliser are global, so they are recomputed rather than patched)
and published as a new version (``publish_model``), flipping the pointer only
after every table is written.  A failed batch leaves the previous version in
service; the stream's checkpoint makes the refresh resume where it stopped.

``start_state_refresh`` keeps mergeable state instead (``streaming/state.py``): a batch reads and writes only what it touches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from aularank.params import RecommenderParams
from aularank.plans.publish import publish_model
from aularank.plans.recommend import Model, build_model
from aularank.sources.enrolments import clean_enrolments
from aularank.streaming.state import RecommenderState


def start_refresh(spark: SparkSession, incoming: str, schema: T.StructType, table_path: str, model_base: str,
                  checkpoint: str, params: RecommenderParams = RecommenderParams(),
                  ttl_seconds: int | None = 3600, available_now: bool = False, fmt: str = "parquet",
                  build: Callable[[DataFrame, RecommenderParams], Model] = build_model):
    """Start the refresh stream; returns the ``StreamingQuery``.

    ``ttl_seconds`` is the refresh period (the reference reloads every hour);
    ``available_now`` processes what is there and stops (tests, backfills);
    ``build`` makes the model from the cleaned enrolments.
    """
    stream = spark.readStream.schema(schema).format(fmt).load(incoming)

    def refresh(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table_path}/batch_id={batch_id}")
        enrol = clean_enrolments(spark.read.parquet(table_path).drop("batch_id"))
        publish_model(build(enrol, params), model_base, batch_id)

    return _start(stream, refresh, checkpoint, ttl_seconds, available_now)


def start_state_refresh(spark: SparkSession, incoming: str, schema: T.StructType, base: str, checkpoint: str,
                        params: RecommenderParams = RecommenderParams(), ttl_seconds: int | None = 3600,
                        available_now: bool = False, fmt: str = "parquet", buckets: int = 64, base_every: int = 50):
    """Folds each batch into the state under ``base``; ``RecommenderState.model`` is the model of the newest batch."""
    state = RecommenderState(spark, base, clean_enrolments(spark.createDataFrame([], schema)), params, buckets, base_every)
    stream = spark.readStream.schema(schema).format(fmt).load(incoming)
    return _start(stream, lambda batch, batch_id: state.fold(clean_enrolments(batch), batch_id), checkpoint, ttl_seconds, available_now)


def _start(stream: DataFrame, each: Callable[[DataFrame, int], object], checkpoint: str, ttl_seconds: int | None, available_now: bool):
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif ttl_seconds:
        writer = writer.trigger(processingTime=f"{int(ttl_seconds)} seconds")
    return writer.start()
