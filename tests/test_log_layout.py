import datetime as dt
import glob

from pyspark.sql import functions as F

from aularank.operators import logs as lg

SCHEMA = "usuario string, id string, curso string, timestamp timestamp"


def scanned(df):
    """(rows found, rows that left the scan)."""
    n = len(df.collect())
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return n, scan.metrics().apply("numOutputRows").value()


def test_a_lookup_by_any_key_reads_a_small_share_and_a_hot_user_is_cut(spark, tmp_path):
    path = str(tmp_path / "log")
    i = F.col("id")
    rows = spark.range(40_000).select(
        F.when(i % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), (i * 7919 % 2003).cast("string"))).alias("usuario"),
        F.concat(F.lit("c"), F.floor(i / 4).cast("string")).alias("id"),
        F.concat(F.lit("k"), (i * 104_729 % 1009).cast("string")).alias("curso"),
        F.timestamp_seconds(i * 60).alias("timestamp"))
    lg.lay_out(rows, path, ["usuario", "id", "curso"], files=64)
    back = spark.read.parquet(path)
    assert back.count() == 40_000 and back.exceptAll(rows).isEmpty()
    for key, value in (("usuario", "u5"), ("id", "c77"), ("curso", "k9")):
        found, read = scanned(back.where(F.col(key) == value))
        assert found == rows.where(F.col(key) == value).count() > 0
        assert read <= 40_000 * 0.4, (key, read)
    assert scanned(back.where("usuario = 'nobody'"))[1] <= 40_000 * 0.05
    sizes = [r["count"] for r in back.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 40 and max(sizes) < 4 * 40_000 / 64


def test_null_keys_repeated_rows_and_an_empty_table(spark, tmp_path):
    row = ("a", "1", None, dt.datetime(2024, 1, 1))
    df = spark.createDataFrame([row, row, (None, None, None, None)], SCHEMA)
    lg.lay_out(df, str(tmp_path / "x"), ["usuario", "curso"], files=4)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "x")).collect()), key=str) == sorted([row, row, (None,) * 4], key=str)
    lg.lay_out(df.limit(0), str(tmp_path / "y"), ["usuario"], files=4)
    assert glob.glob(f"{tmp_path}/y/*.parquet") and spark.read.parquet(str(tmp_path / "y")).count() == 0
