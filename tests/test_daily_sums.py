import datetime as dt
import random

from aularank.operators import logs as lg
from aularank.streaming import metrics as mt

SCHEMA = "tarea string, tokens_entrada int, tokens_salida int, latencia_ms int, timestamp timestamp"


def rows(seed, n, days):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", None]), rng.choice([None, 3, 5]), rng.choice([None, 7]), rng.choice([None, 10, 11, 250]),
             dt.datetime(2024, 3, rng.choice(days), rng.randrange(24), 5)) for _ in range(n)]


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_sums_of_batches_equal_the_batch_report_with_late_rows_retries_and_bases(spark, tmp_path):
    path = str(tmp_path / "m")
    assert mt.daily_report(spark, path).count() == 0
    batches = [rows(s, 20, d) for s, d in ((1, [10, 11]), (2, [11]), (3, [2, 11]), (4, [12]), (5, [2, 12]), (6, [1]), (7, [12]))]
    so_far = []
    for n, batch in enumerate(batches):
        df = spark.createDataFrame(batch, SCHEMA)
        if n in (2, 3, 5):  # a first run with other rows, which the retry replaces (also where it made a base)
            mt.merge_batch(spark.createDataFrame(rows(99, 30, [5, 11]), SCHEMA), path, n, "America/Lima", base_every=2)
        mt.merge_batch(df, path, n, "America/Lima", base_every=2)
        so_far += batch
        if n in (0, 3, 5, 6):
            assert table(mt.daily_report(spark, path)) == table(lg.daily_metrics(spark.createDataFrame(so_far, SCHEMA), "America/Lima")), n
    # a batch holds only its own days
    assert spark.read.parquet(f"{path}/sums/batch=6").select("fecha").distinct().count() <= 2


def test_stream_of_sums(spark, tmp_path):
    src, every = str(tmp_path / "log"), rows(8, 60, [1, 2, 9])
    for part in (every[:30], every[30:]):
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        mt.start_daily_sums(stream, str(tmp_path / "m"), str(tmp_path / "ck"), available_now=True, base_every=2).awaitTermination(120)
    assert table(mt.daily_report(spark, str(tmp_path / "m"))) == table(lg.daily_metrics(spark.createDataFrame(every, SCHEMA)))


def test_watermark_closes_days_and_bounds_the_state(spark, tmp_path):
    src, seen = str(tmp_path / "log"), []
    at = lambda day: [("a", 1, 1, 10, dt.datetime(2024, 3, day, 12))]
    for day in (1, 2, 20, 2, 19):  # the second row of the 2nd comes after its day was closed, that of the 19th in time
        spark.createDataFrame(at(day), SCHEMA).write.mode("append").parquet(src)
        out = mt.daily_metrics_stream(spark.readStream.schema(SCHEMA).parquet(src), delay="2 days")
        q = out.writeStream.outputMode("update").foreachBatch(lambda b, _: seen.extend((r.fecha.day, r.consultas) for r in b.collect())) \
            .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert seen == [(1, 1), (2, 1), (20, 1), (19, 1)]
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 2
