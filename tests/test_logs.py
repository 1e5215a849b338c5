import datetime as dt

from aularank.operators import logs as lg
from aularank.streaming.metrics import start_daily_metrics

LOG_SCHEMA = ("id int, usuario string, nombre_usuario string, mensaje string, respuesta string, tarea string, "
              "fuente_datos string, tokens_entrada int, tokens_salida int, latencia_ms int, timestamp timestamp")
DET_SCHEMA = ("id int, conversacion_id int, usuario string, posicion smallint, id_oferta_formativa string, "
              "curso string, publico_objetivo string")


def _log(spark):
    t = dt.datetime
    return spark.createDataFrame([
        (1, "u1", "n", "m", "r", "sifods", "qdrant", 10, 20, 100, t(2024, 1, 1, 4, 0)),
        (2, "u1", "n", "m", "r", "recomendacion", "x", None, 5, None, t(2024, 1, 1, 6, 0)),
        (2, "u" * 101, "n", None, "r", "otra", "x", 1, 1, 300, t(2024, 1, 2, 3, 0)),
    ], LOG_SCHEMA)


def test_daily_metrics_and_timezone(spark):
    rows = {(str(r.fecha), r.tarea): r for r in lg.daily_metrics(_log(spark)).collect()}
    assert rows[("2024-01-01", "sifods")].tokens_totales == 30
    assert rows[("2024-01-01", "recomendacion")].latencia_promedio_ms is None
    lima = {(str(r.fecha), r.tarea) for r in lg.daily_metrics(_log(spark), tz="America/Lima").collect()}
    assert ("2023-12-31", "sifods") in lima and ("2024-01-01", "otra") in lima


def test_constraint_report_finds_violations(spark):
    det = spark.createDataFrame([(1, 2, "u1", 1, "c", "x", "T"), (2, 99, "u1", 1, "c", "x", "T")], DET_SCHEMA)
    rep = {(r.tabla, r.regla): r.n for r in lg.constraint_report(_log(spark), det).collect()}
    assert rep[("conversaciones_agente", "primary_key:id")] == 1
    assert rep[("conversaciones_agente", "domain:tarea")] == 1
    assert rep[("conversaciones_agente", "not_null:mensaje")] == 1
    assert rep[("conversaciones_agente", "length:usuario>100")] == 1
    assert rep[("recomendaciones_detalle", "foreign_key:conversacion_id")] == 1


def test_cascade_delete(spark):
    det = spark.createDataFrame([(1, 1, "u1", 1, "c", "x", "T"), (2, 2, "u1", 1, "c", "x", "T")], DET_SCHEMA)
    ids = spark.createDataFrame([(1,)], "id int")
    log2, det2 = lg.cascade_delete(_log(spark), det, ids)
    assert {r.id for r in log2.collect()} == {2}
    assert {r.conversacion_id for r in det2.collect()} == {2}


def test_stream_metrics_equal_batch(spark, tmp_path):
    log = _log(spark)
    src = str(tmp_path / "log")
    log.where("id = 2").write.parquet(src)
    for batch in range(2):
        if batch:  # rows that come a day late still count
            log.where("id = 1").write.mode("append").parquet(src)
        stream = spark.readStream.schema(log.schema).parquet(src)
        start_daily_metrics(stream, str(tmp_path / "out"), str(tmp_path / "ck"), "America/Lima", available_now=True).awaitTermination(120)
    newest = sorted((tmp_path / "out").glob("batch=*"))[-1]
    got = sorted((tuple(r) for r in spark.read.parquet(str(newest)).collect()), key=str)
    want = sorted((tuple(r) for r in lg.daily_metrics(log, "America/Lima").collect()), key=str)
    assert got == want
