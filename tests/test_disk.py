"""Steps that run while a query is built leave no shuffle files; wide rows are filed by columns."""

import os

from pyspark.sql import functions as F

from aularank.operators import scores as sc
from aularank.operators.features import COURSE, USER
from aularank.operators.similarity import user_neighbours
from aularank.plans import recommend as rp
from aularank.session import SHUFFLES_END, filed, kept, only_row


def _left(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in dirs for _, _, files in os.walk(d) for f in files if f.startswith("shuffle_")}


def _ratings(spark):
    rows = [(f"u{u}", f"c{(u * 7 + c * c) % 23}", 0.5 + (u + c) % 10 / 2) for u in range(40) for c in range(8)]
    return spark.createDataFrame(rows, f"{USER} string, {COURSE} string, rating double").groupBy(USER, COURSE).agg(F.max("rating").alias("rating"))


def test_kept_rows_leave_no_shuffle_files(spark):
    before, setting = _left(spark), spark.conf.get(SHUFFLES_END, None)
    rows = kept(_ratings(spark))
    assert only_row(rows.groupBy(USER).count().agg(F.sum("count")))[0] > 0
    assert not _left(spark) - before
    assert spark.conf.get(SHUFFLES_END, None) == setting


def test_neighbours_and_collaborative_lists_leave_no_shuffle_files(spark):
    ratings = kept(_ratings(spark))
    before = _left(spark)
    for hot in (1000, 3):
        neighbours = kept(user_neighbours(ratings, 5, hot_raters=hot))
        lists = kept(sc.collaborative_scores(neighbours, ratings, ratings.select(USER, COURSE), 4))
        assert not _left(spark) - before
        assert lists.count()
        before = _left(spark)


def test_filed_rows_are_the_rows(spark):
    rows = spark.sql("select id, struct(id as a, cast(id as string) as b) as ord, if(id % 3 = 0, null, 'ñ') as CURSO, cast(id as double) / 10 as q from range(50)")
    again = filed(rows)
    assert again.schema.simpleString() == rows.schema.simpleString()
    assert sorted(again.collect()) == sorted(rows.collect())
    odd = filed(spark.sql("select id, struct(null as n) as ord from range(3)"))
    assert odd.count() == 3


def test_model_files_only_the_rows_columns(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(rp, "filed", lambda df: seen.append(df.columns) or df)
    enrol = _ratings(spark).select(USER, COURSE, F.col("rating").alias("RATING_COMPUESTO"), F.lit("x").alias("ID_GRUPO"))
    whole = rp.build_model(enrol).ratings
    lone = rp.build_model(enrol, file_rows=False).ratings
    assert seen == [[USER, COURSE, "RATING_COMPUESTO"]]
    assert sorted(whole.collect()) == sorted(lone.collect())
