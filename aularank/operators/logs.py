"""Interaction log, recommendation detail log, reports and integrity checks.

SNK-1..5, DQ-1, DQ-2, LOG-1..3.  The two logs are append-only tables; the
reports are DataFrame expressions (or temp views) over them.
"""

from __future__ import annotations

import functools
import logging
import math
from collections.abc import Sequence
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aularank.fixed_values import RECOMMENDATION_MESSAGE, SOURCE_RECOMMENDER, TASKS
from aularank.functions.columns import round_half_away, text_sanitise

log_ = logging.getLogger(__name__)

# Declared column widths (VARCHAR(n)) of the two log tables.
LOG_WIDTHS = {"usuario": 100, "nombre_usuario": 200, "tarea": 20, "fuente_datos": 50}
DETAIL_WIDTHS = {"usuario": 100, "id_oferta_formativa": 50, "curso": 255, "publico_objetivo": 200}
LOG_NOT_NULL = ["usuario", "mensaje", "respuesta", "tarea"]
DETAIL_NOT_NULL = ["conversacion_id", "usuario", "posicion"]

HISTORY_COLUMNS = [
    ("ca", "timestamp"), ("ca", "usuario"), ("ca", "nombre_usuario"), ("rd", "posicion"),
    ("rd", "id_oferta_formativa"), ("rd", "curso"), ("rd", "horas_programa"), ("rd", "publico_objetivo"),
    ("rd", "score_final"), ("rd", "algoritmos_usados"), ("rd", "tasa_culminacion"),
    ("rd", "calificacion_prom"), ("rd", "justificacion"), ("ca", "latencia_ms"),
]


# ---- LOG-1 / LOG-2 ----------------------------------------------------------

def day_of(ts_col: str = "timestamp", tz: str | None = None, zoneless: bool = False):
    """DATE(timestamp) in the session's zone; with ``tz`` the day boundary follows that zone (Q26).

    A timestamp is an instant, so it is read in the session's zone before it is moved to ``tz``; a timestamp
    without zone is taken as UTC.
    """
    ts = F.col(ts_col)
    if tz:
        local = F.convert_timezone(F.current_timezone(), F.lit(tz), ts.cast("timestamp_ntz"))
        ts = F.convert_timezone(F.lit("UTC"), F.lit(tz), ts) if zoneless else local
    return F.to_date(ts)


def metric_columns(log: DataFrame, tz: str | None = None) -> tuple[list, list]:
    """Keys and aggregates of LOG-1."""
    tokens = F.coalesce(F.col("tokens_entrada"), F.lit(0)) + F.coalesce(F.col("tokens_salida"), F.lit(0))
    zoneless = dict(log.dtypes)["timestamp"] == "timestamp_ntz"
    return [day_of("timestamp", tz, zoneless).alias("fecha"), F.col("tarea")], [
        F.count(F.lit(1)).alias("consultas"),
        round_half_away(F.avg("latencia_ms"), 0).alias("latencia_promedio_ms"),
        F.sum(tokens.cast("long")).alias("tokens_totales"),
    ]


def daily_metrics(log: DataFrame, tz: str | None = None) -> DataFrame:
    """LOG-1: per day and task: count, rounded mean latency, total tokens."""
    keys, aggregates = metric_columns(log, tz)
    return log.groupBy(*keys).agg(*aggregates).orderBy(F.col("fecha").desc(), F.col("tarea").asc())


def recommendation_history(log: DataFrame, details: DataFrame) -> DataFrame:
    """LOG-2: one row per recommended course, newest interaction first."""
    ca = log.where(F.col("tarea") == "recomendacion").alias("ca")
    rd = details.alias("rd")
    return (
        ca.join(rd, F.col("rd.conversacion_id") == F.col("ca.id"))
        .select(*[F.col(f"{t}.{c}").alias(c) for t, c in HISTORY_COLUMNS])
        .orderBy(F.col("timestamp").desc(), F.col("posicion").asc())
    )


def register_views(log: DataFrame, details: DataFrame, tz: str | None = None) -> None:
    """Expose the two reports as temp views (always fresh on read)."""
    log.createOrReplaceTempView("conversaciones_agente")
    details.createOrReplaceTempView("recomendaciones_detalle")
    daily_metrics(log, tz).createOrReplaceTempView("v_metricas_diarias")
    recommendation_history(log, details).createOrReplaceTempView("v_historial_recomendaciones")


# ---- DQ-1 / DQ-2 ------------------------------------------------------------

def _violations(df: DataFrame, table: str, not_null: list[str], widths: dict[str, int],
                extra: dict) -> DataFrame:
    checks = {f"not_null:{c}": F.col(c).isNull() for c in not_null}
    checks.update({f"length:{c}>{n}": F.length(F.col(c)) > n for c, n in widths.items()})
    checks.update(extra)
    agg = df.agg(*[F.count(F.when(cond, 1)).alias(name) for name, cond in checks.items()])
    names = list(checks)
    return agg.unpivot([], names, "regla", "n").select(F.lit(table).alias("tabla"), "regla", "n")


def _duplicate_keys(df: DataFrame, table: str, key: str = "id") -> DataFrame:
    dup = df.groupBy(key).count().where(F.col("count") > 1)
    return dup.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(table).alias("tabla"), F.lit(f"primary_key:{key}").alias("regla"), "n")


def constraint_report(log: DataFrame, details: DataFrame) -> DataFrame:
    """DQ-1: ``(tabla, regla, n)`` violation counts for every declared constraint."""
    bad_task = F.col("tarea").isNotNull() & ~F.col("tarea").isin(*TASKS)
    orphans = details.where(F.col("conversacion_id").isNotNull()).join(log.select(F.col("id").alias("conversacion_id")), "conversacion_id", "left_anti")
    orphan_row = orphans.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("recomendaciones_detalle").alias("tabla"), F.lit("foreign_key:conversacion_id").alias("regla"), "n")
    return (
        _violations(log, "conversaciones_agente", LOG_NOT_NULL, LOG_WIDTHS, {"domain:tarea": bad_task})
        .unionByName(_violations(details, "recomendaciones_detalle", DETAIL_NOT_NULL, DETAIL_WIDTHS, {}))
        .unionByName(_duplicate_keys(log, "conversaciones_agente"))
        .unionByName(_duplicate_keys(details, "recomendaciones_detalle"))
        .unionByName(orphan_row)
    )


def cascade_delete(log: DataFrame, details: DataFrame, deleted_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """DQ-2: removing interactions removes their detail rows."""
    ids = deleted_ids.select(F.col("id"))
    kept_log = log.join(ids, "id", "left_anti")
    kept_details = details.join(ids.withColumnRenamed("id", "conversacion_id"), "conversacion_id", "left_anti")
    return kept_log, kept_details


# ---- SNK-1..3: building and appending log rows ------------------------------

def _logged(requests: DataFrame, answers: DataFrame, mensaje, tarea, fuente, entrada) -> DataFrame:
    r = requests.join(answers, "request_id", "left")
    return r.select(
        "request_id",
        F.md5(F.concat_ws("|", F.col("request_id").cast("string"), F.col("ts").cast("string"))).alias("id"),
        text_sanitise(F.col("usuario")).alias("usuario"),
        text_sanitise(F.col("nombre_usuario")).alias("nombre_usuario"),
        mensaje.alias("mensaje"),
        text_sanitise(F.col("respuesta")).alias("respuesta"),
        tarea.alias("tarea"),
        fuente.alias("fuente_datos"),
        entrada.cast("int").alias("tokens_entrada"),
        F.col("tokens_salida").cast("int").alias("tokens_salida"),
        F.col("latencia_ms").cast("int").alias("latencia_ms"),
        F.col("ts").alias("timestamp"),
    )


def interaction_rows(requests: DataFrame, answers: DataFrame, default_top_k: int = 3) -> DataFrame:
    """SNK-1 rows for recommendation interactions.

    requests: (request_id, usuario, nombre_usuario, top_k, ts)
    answers:  (request_id, respuesta, tokens_salida, latencia_ms)
    ``id`` is a 128-bit digest of the request id and time, so a re-run of the same
    batch produces the same keys (no run-dependent ids).  ``request_id`` is
    kept so detail rows can be linked (SNK-2).  A null or zero ``top_k`` is logged as the default,
    a negative one as it came.
    """
    top_k = F.when(F.col("top_k") != 0, F.col("top_k")).otherwise(F.lit(default_top_k))
    return _logged(requests, answers, F.format_string(RECOMMENDATION_MESSAGE.replace("{}", "%d"), top_k),
                   F.lit("recomendacion"), F.lit(SOURCE_RECOMMENDER), F.lit(0))


def retrieval_rows(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """SNK-1 rows for answered questions.

    requests: (request_id, usuario, nombre_usuario, mensaje, ts)
    answers:  (request_id, respuesta, fuente_datos, tokens_entrada, tokens_salida, latencia_ms)
    """
    return _logged(requests, answers, text_sanitise(F.col("mensaje")), F.lit("sifods"),
                   F.col("fuente_datos"), F.col("tokens_entrada"))


def detail_rows(recs: DataFrame, interactions: DataFrame) -> DataFrame:
    """SNK-2: one detail row per recommendation, positions 1..N, decimal casts.

    recs: recommendation rows (user, posicion, course, scores, methods, course
    facts, justificacion) plus ``request_id``; interactions: SNK-1 rows with
    ``request_id``.  Requests without a logged id get no detail rows.
    """
    ids = interactions.select("request_id", F.col("id").alias("conversacion_id"), "timestamp")
    j = recs.join(ids, "request_id")
    dec = lambda c, p, s: F.col(c).cast(f"decimal({p},{s})")
    return j.select(
        F.concat_ws(":", F.col("conversacion_id").cast("string"), F.col("posicion").cast("string")).alias("id"),
        "conversacion_id",
        text_sanitise(F.col("USUARIO_DOCUMENTO")).alias("usuario"),
        F.col("posicion").cast("smallint").alias("posicion"),
        F.col("ID_OFERTA_FORMATIVA").alias("id_oferta_formativa"),
        text_sanitise(F.col("CURSO")).alias("curso"),
        F.col("HORAS_PROGRAMA").cast("int").alias("horas_programa"),
        text_sanitise(F.col("PUBLICO_OBJETIVO")).alias("publico_objetivo"),
        dec("TASA_CULMINACION", 4, 2).alias("tasa_culminacion"),
        dec("TASA_APROBACION", 4, 2).alias("tasa_aprobacion"),
        dec("CALIFICACION_PROM", 3, 1).alias("calificacion_prom"),
        dec("score_final", 6, 4).alias("score_final"),
        dec("score_colaborativo", 6, 4).alias("score_colaborativo"),
        dec("score_popularidad", 6, 4).alias("score_popularidad"),
        dec("score_historial", 6, 4).alias("score_historial"),
        dec("score_novedad", 6, 4).alias("score_novedad"),
        F.col("metodos_usados").alias("algoritmos_usados"),
        text_sanitise(F.col("justificacion")).alias("justificacion"),
        "timestamp",
    )


def append_batch(df: DataFrame, path: str, batch_id: str, enabled: bool = True, strict: bool = True) -> bool:
    """SNK-1/2, LOG-3: the rows of one table's batch, laid out by batch, day and, where they have one, task.

    A re-run replaces the batch's whole folder, also where it has fewer rows or days, so a retried batch never
    duplicates or leaves rows.  Two tables that must appear together go through ``commits.commit_batch``.  Returns whether
    rows were written; a failed write raises, or with ``strict`` off is logged and the job goes on (an answer is not
    lost with its log).
    """
    if not enabled:
        return False
    keys = ["dia", *(["tarea_"] if "tarea" in df.columns else [])]
    out = df.withColumn("dia", F.to_date("timestamp"))
    if "tarea" in df.columns:
        out = out.withColumn("tarea_", F.col("tarea"))
    try:
        out.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*keys).parquet(f"{path}/batch_id={quote(batch_id, safe='')}")
    except Exception:
        if strict:
            raise
        log_.warning("batch %s was not written to %s", batch_id, path, exc_info=True)
        return False
    return True


def lay_out(df: DataFrame, path: str, keys: Sequence[str], files: int = 64) -> None:
    """LOG-3: a copy of a log table in which rows of one user, conversation or course lie in few files.

    Files follow a Z-curve over the hashes of ``keys``: each key gives its bits in turn, so equal values of any one key meet in
    about ``files ** (1 - 1/len(keys))`` files (more where cells do not end with files), and Parquet's Bloom filters and dictionaries (with the sorted files' ranges) let an
    ordinary ``where`` skip the others.  Cells are cut by time, so a user with a third of all rows fills files of equal size.
    Null keys lie together; an empty table gives a readable empty one; columns and repeated rows are kept as they are.
    """
    bits = max(1, math.ceil(math.log2(max(files, 2)) / len(keys)))
    turns = [F.shiftleft(F.shiftright(F.xxhash64(F.lit(j), F.col(f"`{k}`")), b).bitwiseAND(1), (bits - 1 - b) * len(keys) + j)
             for b in range(bits) for j, k in enumerate(keys)]
    order = [functools.reduce(lambda a, b: a + b, turns), F.col("timestamp")]
    writer = df.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("overwrite").option("parquet.bloom.filter.adaptive.enabled", "true")
    for k in keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true")
    writer.parquet(path)


def schema_check(spark: SparkSession, tables=("conversaciones_agente", "recomendaciones_detalle"),
                 views=("v_metricas_diarias", "v_historial_recomendaciones")) -> DataFrame:
    """SNK-4: report which expected tables/views exist; creates nothing."""
    rows = [(name, kind, bool(spark.catalog.tableExists(name))) for kind, names in
            (("table", tables), ("view", views)) for name in names]
    return spark.createDataFrame(rows, "object string, kind string, exists boolean")

