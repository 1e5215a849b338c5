import datetime as dt

from pyspark.sql import functions as F

from aularank.operators import logs as lg
from aularank.plans import recommend as rp
from aularank.plans.publish import current_version, load_model
from aularank.sources.enrolments import clean_enrolments
from aularank.streaming.refresh import start_refresh

from tests.test_recommender import SCHEMA, make_rows


def test_refresh_stream_publishes_model(spark, tmp_path):
    raw = spark.createDataFrame(make_rows(6, n_users=10, n_courses=6, n_rows=40), SCHEMA)
    incoming = str(tmp_path / "in")
    raw.write.parquet(incoming)
    q = start_refresh(spark, incoming, raw.schema, str(tmp_path / "table"), str(tmp_path / "model"),
                      str(tmp_path / "ck"), available_now=True)
    q.awaitTermination(300)
    assert current_version(spark, str(tmp_path / "model")) is not None
    m = load_model(spark, str(tmp_path / "model"))
    assert m.catalog.count() == clean_enrolments(raw).select("ID_OFERTA_FORMATIVA").distinct().count()


def test_interaction_and_detail_rows(spark, tmp_path):
    enrol = clean_enrolments(spark.createDataFrame(make_rows(7, n_users=8, n_courses=6, n_rows=40), SCHEMA))
    model = rp.build_model(enrol, checkpoint=False)
    reqs = spark.createDataFrame([("r1", "U01", "Ana", None, dt.datetime(2024, 1, 1))],
                                 "request_id string, usuario string, nombre_usuario string, top_k int, ts timestamp")
    recs = rp.recommend(model, reqs.withColumnRenamed("usuario", "USUARIO_DOCUMENTO"))
    ans = spark.createDataFrame([("r1", "texto", 10, 5)], "request_id string, respuesta string, tokens_salida int, latencia_ms int")
    inter = lg.interaction_rows(reqs, ans)
    det = lg.detail_rows(recs.join(reqs.select("request_id", F.col("usuario").alias("USUARIO_DOCUMENTO")),
                                   "USUARIO_DOCUMENTO"), inter)
    rows = det.orderBy("posicion").collect()
    assert [r.posicion for r in rows] == list(range(1, len(rows) + 1))
    assert inter.first().mensaje == "Recomendación (top 3)"
    out = str(tmp_path / "log")
    lg.append_batch(inter, out, "b1")
    lg.append_batch(inter, out, "b1")  # retried batch replaces, never duplicates
    assert spark.read.parquet(out).count() == 1
    assert lg.append_batch(inter, out, "b2", enabled=False) is False
    assert lg.append_batch(inter, "nofs://x/y", "b1", strict=False) is False
    asked = reqs.select("request_id", "usuario", "nombre_usuario", F.lit("hola").alias("mensaje"), "ts")
    told = spark.createDataFrame([("r1", "texto", "qdrant:kb", 4, 2, 9)], "request_id string, respuesta string, fuente_datos string, tokens_entrada int, tokens_salida int, latencia_ms int")
    row = lg.retrieval_rows(asked, told).first()
    assert (row.tarea, row.mensaje, row.fuente_datos, row.tokens_entrada) == ("sifods", "hola", "qdrant:kb", 4)
    neg = reqs.withColumn("top_k", F.lit(-1))
    assert lg.interaction_rows(neg, ans).first().mensaje == "Recomendación (top -1)"


def test_refresh_retries_a_failed_build_without_duplicates(spark, tmp_path):
    raw = spark.createDataFrame(make_rows(6, n_users=6, n_courses=4, n_rows=25), SCHEMA)
    incoming, table = str(tmp_path / "in"), str(tmp_path / "table")
    raw.write.parquet(incoming)
    calls = []

    def flaky(enrol, params):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("build failed")
        return rp.build_model(enrol, params)

    for _ in range(2):
        q = start_refresh(spark, incoming, raw.schema, table, str(tmp_path / "model"), str(tmp_path / "ck"), available_now=True, build=flaky)
        try:
            q.awaitTermination(300)
        except Exception:  # the first build fails
            assert current_version(spark, str(tmp_path / "model")) is None
    assert len(calls) == 2 and spark.read.parquet(table).count() == raw.count()
    assert load_model(spark, str(tmp_path / "model")).catalog.count() > 0
