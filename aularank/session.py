"""SparkSession helpers used by tests, bench and the driver entry."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession


LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: Whether a query's shuffle files are removed when it ends (else when the driver's collector gets to them).
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    spark = (
        SparkSession.builder.master(master)
        .appName("aularank")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names: on a cluster, one that driver and executors share.

    Only a local session (one machine) falls back to a scratch folder where none is configured.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            named = LOCAL_CHECKPOINTS
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Queries made and run in here leave no shuffle files behind."""
    before = spark.conf.get(SHUFFLES_END, None)
    spark.conf.set(SHUFFLES_END, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_END)
        else:
            spark.conf.set(SHUFFLES_END, before)


def kept(df: DataFrame) -> DataFrame:
    """The rows, written to the checkpoint folder; the shuffle files that made them are gone afterwards."""
    ensure_checkpoint_dir(df.sparkSession)
    with shuffles_end(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def only_row(df: DataFrame) -> Row | None:
    """The first row; the shuffle files that made it are gone afterwards."""
    with shuffles_end(df.sparkSession):
        return df.select("*").first()


def filed(df: DataFrame) -> DataFrame:
    """``kept`` by columns, for wide rows of which each reader takes a few columns."""
    if re.search(r"\b(void|interval|variant)\b", df.schema.simpleString()):  # no such columns in Parquet
        return kept(df)
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/rows-{uuid.uuid4().hex}"
    with shuffles_end(spark):
        df.select("*").write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def refiled(df: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """``filed`` rows that take the place of ``old`` filed ones, whose files are removed."""
    new = filed(df)
    sc = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in old.inputFiles()} if old is not None else ():
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    return new
