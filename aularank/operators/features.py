"""Course catalog, user profile, rating table and their statistics.

AGG-1..8, AGG-11.  All aggregates are algebraic (min_by / max / count / sum /
avg), so Spark combines them map-side before the shuffle: a course or user
holding a third of all rows costs one partial row per input partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aularank.fixed_values import NOVELTY_VALUES
from aularank.functions.columns import clip_nn, round_half_away, safe_ratio

USER = "USUARIO_DOCUMENTO"
COURSE = "ID_OFERTA_FORMATIVA"


def first_non_null(col: str, ord_col: str = "ord"):
    """pandas ``first`` in source order: first non-null value (Q5)."""
    return F.min_by(F.col(col), F.when(F.col(col).isNotNull(), F.col(ord_col)))


def keyed(enrol: DataFrame, *keys: str) -> DataFrame:
    """Drop rows whose grouping key is null (Q6)."""
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return enrol.where(cond)


def course_catalog(enrol: DataFrame) -> DataFrame:
    """AGG-1..3: one row per course with rates, popularity and novelty."""
    agg = keyed(enrol, COURSE).groupBy(COURSE).agg(
        first_non_null("CURSO").alias("CURSO"),
        first_non_null("HORAS_PROGRAMA").alias("HORAS_PROGRAMA"),
        first_non_null("PROPOSITO").alias("PROPOSITO"),
        first_non_null("PUBLICO_OBJETIVO").alias("PUBLICO_OBJETIVO"),
        F.max("AÑO").alias("AÑO_MAX"),
        F.max("ACTIVO").alias("ACTIVO"),
        F.count(USER).alias("TOTAL_INSCRITOS"),
        F.sum("CURSO_CULMINADO").alias("TOTAL_CULMINADOS"),
        F.sum("APROBACION").alias("TOTAL_APROBADOS"),
        F.avg("CALIFICACIONES").alias("CALIFICACION_PROM"),
    )
    return catalog_scores(agg)


def catalog_scores(agg: DataFrame) -> DataFrame:
    """AGG-2, AGG-3: rates, popularity and novelty of a course's totals; novelty follows the newest year of all courses."""
    n = F.col("TOTAL_INSCRITOS")
    agg = agg.select(
        "*",
        clip_nn(safe_ratio(F.col("TOTAL_CULMINADOS"), n), 0.0, 1.0).alias("TASA_CULMINACION"),
        clip_nn(safe_ratio(F.col("TOTAL_APROBADOS"), n), 0.0, 1.0).alias("TASA_APROBACION"),
        clip_nn(F.coalesce(F.col("CALIFICACION_PROM"), F.lit(0.0)) / 5.0, 0.0, 1.0).alias("CALIFICACION_NORM"),
    ).withColumn(
        "SCORE_POPULARIDAD",
        round_half_away(F.col("TASA_CULMINACION") * F.col("CALIFICACION_NORM") * F.log1p(n.cast("double")), 4),
    )
    # Global newest year over every course (inactive too): a one-row aggregate,
    # so the broadcast is bounded by construction.
    newest = F.broadcast(agg.agg(F.max("AÑO_MAX").alias("_newest")))
    age = F.col("_newest") - F.col("AÑO_MAX")
    return (
        agg.crossJoin(newest)
        .withColumn(
            "SCORE_NOVEDAD",
            F.when(age == 0, NOVELTY_VALUES[0]).when(age == 1, NOVELTY_VALUES[1]).when(age == 2, NOVELTY_VALUES[2]).otherwise(NOVELTY_VALUES[3]),
        )
        .drop("_newest")
    )


def user_profile(enrol: DataFrame) -> DataFrame:
    """AGG-4: one row per user."""
    p = keyed(enrol, USER).groupBy(USER).agg(
        first_non_null("NOMBRE_COMPLETO").alias("NOMBRE_COMPLETO"),
        first_non_null("NIVELNEXUS").alias("NIVELNEXUS"),
        first_non_null("NOMBRE_DRE").alias("NOMBRE_DRE"),
        first_non_null("NOMBRE_UGEL").alias("NOMBRE_UGEL"),
        first_non_null("EDAD").alias("EDAD_APROX"),
        F.count(COURSE).alias("TOTAL_CURSOS"),
        F.sum("CURSO_CULMINADO").alias("CURSOS_CULMINADOS"),
        F.sum("APROBACION").alias("CURSOS_APROBADOS"),
    )
    return profile_rates(p)


def profile_rates(p: DataFrame) -> DataFrame:
    return p.withColumn(
        "TASA_COMPLETITUD", round_half_away(safe_ratio(F.col("CURSOS_CULMINADOS"), F.col("TOTAL_CURSOS")), 4))


def user_first_row(enrol: DataFrame) -> DataFrame:
    """WIN-5: the user's level and region from their first row, nulls included."""
    first = F.min_by(F.struct(F.col("NIVELNEXUS"), F.col("NOMBRE_DRE")), F.col("ord"))
    return (
        keyed(enrol, USER).groupBy(USER).agg(first.alias("_f"))
        .select(USER, F.col("_f.NIVELNEXUS").alias("level"), F.col("_f.NOMBRE_DRE").alias("region"))
    )


def rating_table(enrol: DataFrame) -> DataFrame:
    """AGG-5: max composite rating per (user, course); zero ratings kept."""
    return (
        keyed(enrol, USER, COURSE)
        .groupBy(USER, COURSE)
        .agg(F.max("RATING_COMPUESTO").alias("rating"))
    )


def taken_courses(enrol: DataFrame) -> DataFrame:
    """AGG-11 / FLT-3: distinct (user, course) pairs, whatever the outcome."""
    return keyed(enrol, USER, COURSE).select(USER, COURSE).distinct()


def matrix_stats(enrol: DataFrame, ratings: DataFrame, catalog: DataFrame) -> DataFrame:
    """AGG-6: one row of load and matrix statistics."""
    load = enrol.agg(F.count(F.lit(1)).alias("registros"))
    r = ratings.agg(
        F.countDistinct(USER).alias("usuarios"),
        F.countDistinct(COURSE).alias("cursos"),
        F.count(F.when(F.col("rating") != 0, 1)).alias("no_ceros"),
    )
    act = catalog.agg(F.count(F.when(F.col("ACTIVO") == 1, 1)).alias("cursos_activos"))
    out = load.crossJoin(r).crossJoin(act)  # three one-row aggregates
    return out.withColumn(
        "densidad",
        round_half_away(safe_ratio(F.col("no_ceros").cast("double"), F.col("usuarios") * F.col("cursos")), 6),
    ).withColumn("bytes_valores", F.col("no_ceros") * 4)


def user_activity(ratings: DataFrame) -> DataFrame:
    """AGG-7: activity = sum of the user's ratings."""
    return ratings.groupBy(USER).agg(F.sum("rating").alias("actividad"))


def most_active_users(ratings: DataFrame, cap: int) -> DataFrame:
    """TOP-6: the ``cap`` most active users (activity desc, user asc).

    ``orderBy().limit()`` plans as a per-partition top-N then one merge of at
    most ``cap`` rows per partition.
    """
    return user_activity(ratings).orderBy(F.col("actividad").desc(), F.col(USER).asc()).limit(cap)


def course_info(catalog: DataFrame, course_id) -> DataFrame:
    """FLT-4: point lookup; empty result when absent."""
    return catalog.where(F.col(COURSE) == F.lit(str(course_id))).limit(1)


def courses_info(catalog: DataFrame, course_ids: DataFrame) -> DataFrame:
    """FLT-4 batch form: the catalog rows of the requested courses; unknown ids give nothing."""
    return catalog.join(course_ids.select(F.col(COURSE).cast("string").alias(COURSE)).distinct(), COURSE, "left_semi")


def new_courses_for_users(users: DataFrame, ratings_taken: DataFrame, catalog: DataFrame) -> DataFrame:
    """SET-2 / FLT-2: (user, course) for the active courses that each requested user has not taken.

    The result is users x catalog by definition: ask for a bounded set of users.  The ranked lists use pruned
    plans instead.
    """
    pairs = users.select(USER).distinct().join(catalog.where(F.col("ACTIVO") == 1).select(COURSE), F.lit(True))
    return pairs.join(ratings_taken.select(USER, COURSE), [USER, COURSE], "left_anti")


def user_enrolments(enrol: DataFrame, users: DataFrame) -> DataFrame:
    """FLT-3 batch form: every enrolment row of the requested users."""
    return enrol.join(users.select(USER).distinct(), USER, "left_semi")
