import math
import random

from pyspark.sql import functions as F

from aularank.functions.columns import binary_flag, fmt_fixed, last_sentence_trim, round_half_away
from aularank.sources.enrolments import clean_enrolments


def test_fmt_fixed_matches_python(spark):
    random.seed(7)
    vals = [4.25, 2.55, 2.675, 1.005, 0.125, 12.5, 13.5, 0.0, 99.995, -2.55]
    vals += [round(random.random() * 10, random.choice([2, 3, 4])) for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in vals], "x double").select(
        "x", *[fmt_fixed(F.col("x"), n).alias(f"f{n}") for n in (0, 1, 2, 4)]).collect()
    for r in rows:
        for n in (0, 1, 2, 4):
            assert r[f"f{n}"] == f"{r.x:.{n}f}", (r.x, n)


def test_round_half_away_scales_binary_value(spark):
    rows = spark.createDataFrame([(1.005,), (0.125,), (2.675,), (None,)], "x double").select(
        round_half_away(F.col("x"), 2).alias("r")).collect()
    assert [r.r for r in rows] == [1.0, 0.13, 2.68, None]


def test_binary_flag_text_and_numbers(spark):
    vals = ["SI", "sí", "Y", "true", "1", "2", "0", "NO", "", None, " s ", "NaN"]
    got = [r.f for r in spark.createDataFrame([(v,) for v in vals], "v string")
           .select(binary_flag(F.col("v"), spark.createDataFrame([], "v string").schema["v"].dataType).alias("f"))
           .collect()]
    assert got == [1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 1, 0]


def test_last_sentence_trim(spark):
    vals = ["Hola.", "Uno. Dos tres cuatro", "Primera frase completa. Segunda sin punto", "sin punto", None, ""]
    got = [r.t for r in spark.createDataFrame([(v,) for v in vals], "v string")
           .select(last_sentence_trim(F.col("v")).alias("t")).collect()]
    assert got == ["Hola.", "Uno. Dos tres cuatro", "Primera frase completa.", "sin punto", None, ""]


def test_cleaning_rules(spark):
    raw = spark.createDataFrame(
        [
            (" 7 ", " C1", "Curso", "PRIMARIA", "1", "1", "2022.9", "0.8", "7", "SI", "20", "41"),
            ("8", "C2", None, "", "SI", "2", "x", "80", "-1", "2", None, "x"),
            ("9", "C3", "c", None, "0", "0", "2024", "0.49", "NaN", "NO", "5", None),
        ],
        "Dni string, id_oferta string, ` curso ` string, nivel string, APROBACION string, ACTIVO string, "
        "anio string, PORCENTAJE_AVANCE string, CALIFICACIONES string, CURSO_CULMINADO string, "
        "HORAS_PROGRAMA string, EDAD string",
    )
    rows = {r.USUARIO_DOCUMENTO: r for r in clean_enrolments(raw.withColumn("ORD", F.monotonically_increasing_id())).collect()}
    a, b, c = rows["7"], rows["8"], rows["9"]
    assert a.ID_OFERTA_FORMATIVA == "C1" and a["AÑO"] == 2022 and a.CALIFICACIONES == 5.0
    assert a.CURSO_CULMINADO == 1 and a.RATING_COMPUESTO == 2.5
    assert b.APROBACION == 0 and b.ACTIVO == 2 and b["AÑO"] == 0 and b.PORCENTAJE_AVANCE == 1.0
    assert b.CALIFICACIONES == 0.0 and b.CURSO_CULMINADO == 1 and b.EDAD is None and b.HORAS_PROGRAMA == 0.0
    assert c.CALIFICACIONES is None and c.CURSO_CULMINADO == 0 and c.RATING_COMPUESTO == 0.0
    assert a.NOMBRE_DRE == "" and a.PUBLICO_OBJETIVO == ""  # optional defaults


def test_missing_required_column_raises(spark):
    import pytest

    raw = spark.createDataFrame([("1", "C")], "USUARIO_DOCUMENTO string, ID_OFERTA_FORMATIVA string")
    with pytest.raises(ValueError):
        clean_enrolments(raw)


def test_composite_rating_edges(spark):
    raw = spark.createDataFrame(
        [("u", "a", "x", "L", 1, 1, 2024, 0.8, 0), ("u", "b", "x", "L", 0, 1, 2024, 0.5, 0),
         ("u", "c", "x", "L", 1, 1, 2024, 0.1, 1), ("u", "d", "x", "L", 0, 1, 2024, 0.79, 0)],
        "USUARIO_DOCUMENTO string, ID_OFERTA_FORMATIVA string, CURSO string, NIVELNEXUS string, "
        "APROBACION int, ACTIVO int, `AÑO` int, PORCENTAJE_AVANCE double, CURSO_CULMINADO int")
    got = {r.ID_OFERTA_FORMATIVA: r.RATING_COMPUESTO for r in clean_enrolments(raw.withColumn("ORD", F.monotonically_increasing_id())).collect()}
    assert got == {"a": 2.5, "b": 0.5, "c": 2.5, "d": 0.5}
    assert not math.isnan(got["a"])


def test_json_field_and_latency(spark):
    import datetime as dt

    from aularank.functions.columns import json_field, latency_ms

    df = spark.createDataFrame([('{"text": "a", "chunk": 3}', dt.datetime(2024, 1, 1, 0, 0, 0),
                                 dt.datetime(2024, 1, 1, 0, 0, 1, 250000))], "p string, a timestamp, b timestamp")
    r = df.select(json_field(F.col("p"), "text", "").alias("t"), json_field(F.col("p"), "filename", "").alias("f"),
                  latency_ms(F.col("a"), F.col("b")).alias("ms")).first()
    assert (r.t, r.f, r.ms) == ("a", "", 1250)
