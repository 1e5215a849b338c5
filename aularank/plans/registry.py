"""Registered queries: name -> Spark job over the given tables, plus oracle SQL.

Every query reads the driver's parquet tables (or tables Spark derives from
them), over whole tables and whole texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aularank.functions.columns import round_half_away
from aularank.operators import commits
from aularank.operators import features as fe
from aularank.operators import logs as lg
from aularank.operators import prompts as pm
from aularank.operators import retrieval as rt
from aularank.operators import scores as sc
from aularank.operators.features import COURSE, USER
from aularank.operators.similarity import user_neighbours
from aularank.params import RecommenderParams, RouterParams
from aularank.operators.vectors import top_k_dot
from aularank.plans import oracle_sql as O
from aularank.plans import publish as pb
from aularank.plans import recommend as rp
from aularank.sources import testdata
from aularank.session import ensure_checkpoint_dir
from aularank.sources.enrolments import clean_enrolments, read_files
from aularank.streaming import metrics as mt
from aularank.streaming.state import RecommenderState

PARAMS = RecommenderParams()
FALLBACK_PARAMS = RecommenderParams(min_score=1.01)
# The fixture vectors are near-random, so the test thresholds of FIXTURES B2
# (high .28, low .12, gap .03) are used to reach every routing branch.
ROUTER = RouterParams(high=0.28, low=0.12, gap=0.03, block_rows=256)
# Raters that make a course hot in the queries of the pruned similarity search; both leave hot courses at sf0.01.
HOT_RATERS = 25
SKEWED_RATERS = 100
# Rows of one file of the folder that `catalog_by_position` reads, about: what one task sorts.
FILE_ROWS = 1 << 20
# Length of the activity report.
TOP_USERS = 100


def _enrol(spark: SparkSession, sf: str) -> DataFrame:
    return testdata.enrolments(spark, sf)


def _recs_flat(df: DataFrame) -> DataFrame:
    """Methods array as a comma-joined string (comparable across engines)."""
    cols = [c for c in df.columns if c != "metodos_usados"]
    idx = cols.index("score_novedad") + 1
    return df.select(*cols[:idx], F.array_join("metodos_usados", ",").alias("metodos"), *cols[idx:])


# ---- recommender -------------------------------------------------------------

def q_clean_enrolments(spark, sf):
    return _enrol(spark, sf).drop("ord")


def q_course_catalog(spark, sf):
    cat = fe.course_catalog(_enrol(spark, sf))
    return cat.select(*[round_half_away(F.col(c), 6).alias(c) if c in (
        "CALIFICACION_PROM", "TASA_CULMINACION", "TASA_APROBACION", "CALIFICACION_NORM") else F.col(c)
        for c in cat.columns])


def q_user_profile(spark, sf):
    return fe.user_profile(_enrol(spark, sf))


def q_rating_long(spark, sf):
    return fe.rating_table(_enrol(spark, sf))


def q_matrix_stats(spark, sf):
    en = _enrol(spark, sf)
    return fe.matrix_stats(en, fe.rating_table(en), fe.course_catalog(en))


def q_user_activity_topn(spark, sf):
    """AGG-7 / TOP-6: the report of the most active users (its length is the report's own parameter)."""
    return fe.most_active_users(fe.rating_table(_enrol(spark, sf)), TOP_USERS)


def q_user_neighbours(spark, sf):
    nb = user_neighbours(fe.rating_table(_enrol(spark, sf)), PARAMS.similar_users, hot_raters=PARAMS.hot_raters)
    return nb.select(USER, "neighbour", round_half_away(F.col("sim"), 9).alias("sim"), "rank")


def q_user_neighbours_hot(spark, sf):
    """The same result with every course of over 25 raters taken as hot: the pruned search serves most pairs."""
    nb = user_neighbours(fe.rating_table(_enrol(spark, sf)), PARAMS.similar_users, hot_raters=HOT_RATERS)
    return nb.select(USER, "neighbour", round_half_away(F.col("sim"), 9).alias("sim"), "rank")


def skewed_ratings(spark, sf):
    """Ratings with three of four courses folded into a hundred, the first of them rated by nearly every user."""
    part = F.col(COURSE).cast("long")
    k = part % 100
    folded = F.when(part % 4 == 0, F.col(COURSE)).otherwise(F.concat(F.lit("f"), F.floor(k * k * k / 10000).cast("string")))
    return fe.rating_table(_enrol(spark, sf)).groupBy(USER, folded.alias(COURSE)).agg(F.max("rating").alias("rating"))


def q_user_neighbours_skewed(spark, sf):
    """JN-1 where some courses have nearly all users: hot from 100 raters on."""
    nb = user_neighbours(skewed_ratings(spark, sf), PARAMS.similar_users, hot_raters=SKEWED_RATERS)
    return nb.select(USER, "neighbour", round_half_away(F.col("sim"), 9).alias("sim"), "rank")


def _model(spark, sf, params=PARAMS, file_rows=True):
    """A model over the data as it is now; its tables are made as a query reads them."""
    return rp.build_model(_enrol(spark, sf), params, file_rows=file_rows)


def q_model_build(spark, sf):
    """Builds every model table; returns the catalog."""
    model = _model(spark, sf)
    for name in rp.TABLES:
        model.table(name)
    return model.catalog


def q_score_collaborative(spark, sf):
    m = _model(spark, sf, file_rows=False)  # the ratings are all it reads
    c = sc.collaborative_scores(m.neighbours, m.ratings, m.taken, PARAMS.expand)
    return c.select(USER, COURSE, round_half_away(F.col("score"), 6).alias("score"), "rank")


def _first_popular(m, k):
    return sc.first_popular(rp.all_users(m), sc.popularity_ranking(m.catalog), m.taken, k)


def q_popularity_normaliser(spark, sf):
    return sc.popularity_normaliser(_first_popular(_model(spark, sf), 1))


def q_score_popularity(spark, sf):
    first = _first_popular(_model(spark, sf), PARAMS.expand)
    s = sc.popularity_scores(first, sc.popularity_normaliser(first))
    return s.select(USER, COURSE, "slot", round_half_away(F.col("score"), 6).alias("score"))


def q_score_novelty(spark, sf):
    return sc.novelty_scores(fe.course_catalog(_enrol(spark, sf)))


def q_score_history(spark, sf):
    m = _model(spark, sf)
    comp = rp.components(m, rp.all_users(m), PARAMS, collaborative=False)
    return comp.history.select(USER, COURSE, round_half_away(F.col("score"), 6).alias("score"), "rank")


def q_recommend_hybrid(spark, sf):
    return _recs_flat(rp.recommend(_model(spark, sf)))


def q_recommend_requests(spark, sf):
    """SRC-6 / FLT-13: each request's own number of courses."""
    return _recs_flat(rp.recommend(_model(spark, sf), testdata.requests(spark, sf), PARAMS))


def q_recommend_fallback(spark, sf):
    return _recs_flat(rp.recommend(_model(spark, sf, FALLBACK_PARAMS), None, FALLBACK_PARAMS))


def q_justification_prompts(spark, sf):
    m = _model(spark, sf)
    return pm.justification_prompts(rp.recommend(m), m.profile)


def q_response_text(spark, sf):
    m = _model(spark, sf)
    r = pm.response_records(rp.recommend(m), rp.all_users(m))
    return r.select(USER, "respuesta", "total", F.array_join("algoritmos", ",").alias("algoritmos"),
                    "tokens_salida")


def q_user_courses(spark, sf):
    """FLT-3: every enrolment of the users that appear in the event log."""
    asked = testdata.table(spark, sf, "events").select(F.col("user_id").cast("string").alias(USER))
    return fe.user_enrolments(_enrol(spark, sf), asked).select(
        USER, COURSE, "CURSO", "AÑO", "CURSO_CULMINADO", "APROBACION", "CALIFICACIONES")


def q_course_info(spark, sf):
    """FLT-4 for the courses named in the recommendation log."""
    asked = testdata.recommendation_details(spark, sf).select(F.col("id_oferta_formativa").alias(COURSE))
    return fe.courses_info(fe.course_catalog(_enrol(spark, sf)), asked).select(
        COURSE, "CURSO", "HORAS_PROGRAMA", "PUBLICO_OBJETIVO", "TOTAL_INSCRITOS", "SCORE_POPULARIDAD")


def q_text_enrolments(spark, sf):
    """PRJ-1..11 over a text export: alias headers, absent optional columns, numbers in strings."""
    e = clean_enrolments(testdata.text_enrolments(spark, sf))
    return e.select("ord", USER, COURSE, "CURSO", "NIVELNEXUS", "AÑO", "APROBACION", "ACTIVO", "HORAS_PROGRAMA", "CALIFICACIONES",
                    "CURSO_CULMINADO", "PORCENTAJE_AVANCE", "EDAD", "NOMBRE_DRE", "RATING_COMPUESTO")


def q_taken_courses(spark, sf):
    return fe.taken_courses(_enrol(spark, sf))


def q_regional_share(spark, sf):
    en = _enrol(spark, sf)
    rc = sc.regional_completions(sc.completions(en), fe.course_catalog(en))
    tot = fe.keyed(en, COURSE).where((F.col("CURSO_CULMINADO") == 1)).groupBy(
        F.col("NOMBRE_DRE").alias("region")).agg(F.count(F.lit(1)).alias("N_d"))
    return rc.join(tot, "region").select(
        "region", COURSE, "n_dc", "N_d", round_half_away(F.col("n_dc") / F.col("N_d"), 6).alias("share"))


def q_audience_match(spark, sf):
    """FLT-8 per enrolment: does the course audience match the user's level?"""
    en = _enrol(spark, sf)
    cat = fe.course_catalog(en)
    first = fe.user_first_row(en)
    levels = first.where(F.col("level").isNotNull() & (F.col("level") != "")).select(
        F.upper("level").alias("lvl")).distinct()
    matches = sc.audience_matches(cat, levels).withColumn("_hit", F.lit(True))
    t = fe.taken_courses(en).join(first, USER).join(cat.select(COURSE, "PUBLICO_OBJETIVO"), COURSE)
    t = t.withColumn("lvl", F.upper("level")).join(matches, ["lvl", COURSE], "left")
    todos = F.upper(F.col("PUBLICO_OBJETIVO")) == "TODOS"
    flag = (F.when(F.col("level").isNull(), todos)
            .when(F.col("level") == "", F.lit(False))
            .otherwise(F.coalesce(F.col("_hit"), F.lit(False)) | todos))
    return t.select(USER, COURSE, F.coalesce(flag, F.lit(False)).alias("audience_match"))


# ---- logs ---------------------------------------------------------------------

def q_daily_metrics(spark, sf):
    return lg.daily_metrics(testdata.interactions(spark, sf))


def q_daily_metrics_by_batch(spark, sf):
    """STR-2: the report from the sums of four batches, the third run twice; two of them end in a base."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.conf.get('spark.checkpoint.dir')}/daily-sums-{uuid.uuid4().hex}"
    log = testdata.interactions(spark, sf)
    for number in (0, 1, 2, 2, 3):
        mt.merge_batch(log.where(F.pmod(F.col("id"), F.lit(4)) == number), path, number, base_every=2)
    return mt.daily_report(spark, path)


def _folded(spark, sf):
    """STR-1: the model from three batches of enrolments: nearly all, then two small ones (the places in the source that end alike), the second with a base."""
    rows = _enrol(spark, sf).withColumn("_part", F.pmod(F.col("ord"), F.lit(200)))
    state = RecommenderState(spark, f"{ensure_checkpoint_dir(spark)}/refresh-{uuid.uuid4().hex}", rows.drop("_part"), PARAMS, buckets=8, base_every=3)
    for number, part in enumerate((~F.col("_part").isin(1, 2), F.col("_part") == 1, F.col("_part") == 2)):
        state.fold(rows.where(part).drop("_part"), number)
    return state.model()


def q_neighbours_by_batches(spark, sf):
    nb = _folded(spark, sf).neighbours
    return nb.select(USER, "neighbour", round_half_away(F.col("sim"), 9).alias("sim"), "rank")


def q_profile_by_batches(spark, sf):
    return _folded(spark, sf).profile


def q_committed_history(spark, sf):
    """SNK-3: the history of what was committed: a batch that ran again with half of its rows, one that ran once, and one
    that stopped between the two tables."""
    root = f"{ensure_checkpoint_dir(spark)}/log-store-{uuid.uuid4().hex}"
    log, det = testdata.interactions(spark, sf), testdata.recommendation_details(spark, sf)

    def batch(condition):
        return log.where(condition), det.join(log.where(condition).select(F.col("id").alias("conversacion_id")), "conversacion_id", "left_semi").select(*det.columns)

    commits.commit_batch(*batch("id % 4 = 0 or id % 4 = 2"), root, "b0")
    commits.commit_batch(*batch("id % 4 = 0"), root, "b0")
    commits.commit_batch(*batch("id % 4 = 1"), root, "b1")
    commits.write_attempt(batch("id % 4 = 3")[0], root, commits.LOG, uuid.uuid4().hex)  # no details, no manifest row
    seen = [commits.committed(spark, root, t, df.schema) for t, df in ((commits.LOG, log), (commits.DETAILS, det))]
    h = lg.recommendation_history(*seen)
    return h.withColumn("algoritmos_usados", F.array_join("algoritmos_usados", ","))


def q_catalog_by_position(spark, sf):
    """WIN-5 / SRC-2: the catalog of a folder of files without an order column; "first" is the first row of the files."""
    path = f"{ensure_checkpoint_dir(spark)}/enrolments-{uuid.uuid4().hex}"
    parts = max(spark.sparkContext.defaultParallelism, -(-testdata.table(spark, sf, "lineitem").count() // FILE_ROWS))
    testdata.raw_enrolments(spark, sf).repartitionByRange(parts, "ORD").sortWithinPartitions("ORD").drop("ORD").write.parquet(path)
    cat = fe.course_catalog(clean_enrolments(read_files(spark, path)))
    return cat.select(*[round_half_away(F.col(c), 6).alias(c) if c in (
        "CALIFICACION_PROM", "TASA_CULMINACION", "TASA_APROBACION", "CALIFICACION_NORM") else F.col(c) for c in cat.columns])


def q_profile_by_key(spark, sf):
    """WIN-5 / SRC-1: the profile of a table without an order column, under a declared key of its own."""
    raw = testdata.raw_enrolments(spark, sf).withColumnRenamed("ORD", "line_key")
    return fe.user_profile(clean_enrolments(raw, order_by=["line_key"]))


def q_recommendation_history(spark, sf):
    h = lg.recommendation_history(testdata.interactions(spark, sf), testdata.recommendation_details(spark, sf))
    return h.withColumn("algoritmos_usados", F.array_join("algoritmos_usados", ","))


def q_constraint_report(spark, sf):
    return lg.constraint_report(testdata.interactions(spark, sf), testdata.recommendation_details(spark, sf))


def q_constraint_violations(spark, sf):
    """DQ-1 over logs in which every rule is broken somewhere."""
    return lg.constraint_report(testdata.dirty_interactions(spark, sf), testdata.dirty_details(spark, sf))


def q_cascade_delete(spark, sf):
    """DQ-2: the detail rows that stay when the error-free half of the interactions goes."""
    log, det = testdata.interactions(spark, sf), testdata.recommendation_details(spark, sf)
    gone = log.where(F.col("tokens_entrada") % 2 == 0).select("id")
    _, kept = lg.cascade_delete(log, det, gone)
    return kept.select("id", "conversacion_id", "posicion", "score_final", "curso")


# ---- retrieval ----------------------------------------------------------------

def _routing(spark, sf):
    qs, nodes = testdata.queries(spark, sf), testdata.nodes(spark, sf)
    cands = rt.route_candidates(qs, nodes, ROUTER)
    return qs, nodes, cands, rt.route_decision(cands, qs, nodes, ROUTER)


def q_route_candidates(spark, sf):
    _, _, cands, _ = _routing(spark, sf)
    return cands.select("query_id", "rank", "knowledge_base", round_half_away(F.col("score"), 6).alias("score"))


def q_route_decision(spark, sf):
    _, _, _, dec = _routing(spark, sf)
    return dec.select("query_id", "kb", "node", "path", "method", "fast_path", "score")


def q_escalation_prompts(spark, sf):
    qs, _, cands, dec = _routing(spark, sf)
    return rt.escalation_prompts(cands, dec, qs)


def q_route_labelled(spark, sf):
    """VEC-4 / JN-11: escalated queries take an outside label where it names a node."""
    qs, nodes = testdata.labelled_queries(spark, sf), testdata.nodes(spark, sf)
    dec = rt.route_decision(rt.route_candidates(qs, nodes, ROUTER), qs, nodes, ROUTER)
    return dec.select("query_id", "kb", "node", "path", "method", "fast_path", "score")


def q_search_with_fallback(spark, sf):
    """VEC-8: a third of the collections are empty; their queries search the general one."""
    qs, _, _, dec = _routing(spark, sf)
    return rt.search_chunks(dec, qs, testdata.chunks_with_general(spark, sf), ROUTER)


def q_search_general(spark, sf):
    """VEC-9 without a router: prompts' source and node, and the best hit."""
    qs = testdata.queries(spark, sf)
    hits = rt.search_general(qs, testdata.chunks_with_general(spark, sf), ROUTER)
    return rt.answer_prompts(qs, None, hits).select("query_id", "fuente_datos", "nodo_navegacion", F.size("referencias").alias("n_ref"))


def q_node_index(spark, sf):
    """TRE-1 / TRE-2: the flattened trees and each node's text."""
    return rt.flatten_tree(testdata.tree_documents(spark, sf)).select(
        "knowledge_base", "name", "path", F.array_join("keywords", ",").alias("keywords"), "embed_text")


def q_search_texts(spark, sf):
    """VEC-1 / UDF-2 from texts alone: an encoder fitted on the passages, stored, loaded for passages and questions.

    The three best documents of each benchmark item by their scores (copies of a document tie, so ids are left out).
    """
    ensure_checkpoint_dir(spark)
    base = f"{spark.conf.get('spark.checkpoint.dir')}/encoder-{uuid.uuid4().hex}"
    docs, items = testdata.table(spark, sf, "documents"), testdata.table(spark, sf, "benchmark")
    pb.publish_encoder(spark, rt.fit_encoder(docs, "text"), base, 1)
    model = pb.load_encoder(spark, base)
    passages = rt.embed(docs.select("doc_id", "text"), "text", rt.PASSAGE_PREFIX, model=model)
    questions = rt.embed(items.select("item_id", "text"), "text", model=model)
    hits = top_k_dot(questions.select(F.col("item_id").alias("id"), F.lit("").alias("group"), F.col("embedding").alias("vec")),
                     passages.select(F.col("doc_id").alias("id"), F.lit("").alias("group"), F.col("embedding").alias("vec")), 3)
    return hits.select(F.col("left_id").alias("item_id"), "rank", round_half_away(F.col("score"), 6).alias("score"))


def _search(spark, sf):
    qs, _, _, dec = _routing(spark, sf)
    return qs, dec, rt.search_chunks(dec, qs, testdata.chunks(spark, sf), ROUTER)


def q_chunk_search(spark, sf):
    _, _, hits = _search(spark, sf)
    return hits


def q_chunk_search_cells(spark, sf):
    """VEC-7 through the centroid index."""
    ensure_checkpoint_dir(spark)
    qs, _, _, dec = _routing(spark, sf)
    return rt.search_chunks(dec, qs, testdata.chunks(spark, sf), replace(ROUTER, cells=4))


def q_context_text(spark, sf):
    _, _, hits = _search(spark, sf)
    return rt.context_text(hits).select("query_id", "context", "n_chunks")


def q_answer_prompts(spark, sf):
    qs, dec, hits = _search(spark, sf)
    a = rt.answer_prompts(qs, dec, hits)
    refs = F.array_join(F.transform("referencias", lambda x: F.concat(
        x["fuente"], F.lit("="), F.format_string("%.4f", x["relevancia"]))), ";")
    return a.select("query_id", "prompt", "fuente_datos", "nodo_navegacion", refs.alias("referencias"),
                    "tokens_entrada")


SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "clean_enrolments": q_clean_enrolments,
    "course_catalog": q_course_catalog,
    "user_profile": q_user_profile,
    "rating_long": q_rating_long,
    "matrix_stats": q_matrix_stats,
    "user_activity_topn": q_user_activity_topn,
    "taken_courses": q_taken_courses,
    "user_neighbours": q_user_neighbours,
    "score_collaborative": q_score_collaborative,
    "popularity_normaliser": q_popularity_normaliser,
    "score_history": q_score_history,
    "regional_share": q_regional_share,
    "audience_match": q_audience_match,
    "recommend_hybrid": q_recommend_hybrid,
    "recommend_fallback": q_recommend_fallback,
    "justification_prompts": q_justification_prompts,
    "response_text": q_response_text,
    "daily_metrics": q_daily_metrics,
    "recommendation_history": q_recommendation_history,
    "committed_history": q_committed_history,
    "catalog_by_position": q_catalog_by_position,
    "profile_by_key": q_profile_by_key,
    "constraint_report": q_constraint_report,
    "route_candidates": q_route_candidates,
    "route_decision": q_route_decision,
    "escalation_prompts": q_escalation_prompts,
    "chunk_search": q_chunk_search,
    "context_text": q_context_text,
    "answer_prompts": q_answer_prompts,
    "score_popularity": q_score_popularity,
    "score_novelty": q_score_novelty,
    "user_courses": q_user_courses,
    "course_info": q_course_info,
    "text_enrolments": q_text_enrolments,
    "recommend_requests": q_recommend_requests,
    "user_neighbours_hot": q_user_neighbours_hot,
    "user_neighbours_skewed": q_user_neighbours_skewed,
    "constraint_violations": q_constraint_violations,
    "cascade_delete": q_cascade_delete,
    "route_labelled": q_route_labelled,
    "search_with_fallback": q_search_with_fallback,
    "search_general": q_search_general,
    "node_index": q_node_index,
    "search_texts": q_search_texts,
    "daily_metrics_by_batch": q_daily_metrics_by_batch,
    "chunk_search_cells": q_chunk_search_cells,
    "neighbours_by_batches": q_neighbours_by_batches,
    "profile_by_batches": q_profile_by_batches,
}

_W = O.with_
_BASE = (O.ENROL, O.CATALOG, O.RATINGS)
_E = PARAMS.expand

SQL: dict[str, str] = {
    "clean_enrolments": _W(O.ENROL) + " SELECT * EXCLUDE (ord) FROM enrol_r",
    "course_catalog": _W(O.ENROL, O.CATALOG) + """
 SELECT ID_OFERTA_FORMATIVA, CURSO, HORAS_PROGRAMA, PROPOSITO, PUBLICO_OBJETIVO, "AÑO_MAX", ACTIVO,
   TOTAL_INSCRITOS, TOTAL_CULMINADOS, TOTAL_APROBADOS, round(CALIFICACION_PROM, 6) AS CALIFICACION_PROM,
   round(TASA_CULMINACION, 6) AS TASA_CULMINACION, round(TASA_APROBACION, 6) AS TASA_APROBACION,
   round(CALIFICACION_NORM, 6) AS CALIFICACION_NORM, SCORE_POPULARIDAD, SCORE_NOVEDAD FROM catalog""",
    "user_profile": _W(O.ENROL, O.PROFILE) + " SELECT * FROM profile",
    "rating_long": _W(O.ENROL, O.RATINGS) + " SELECT * FROM ratings",
    "matrix_stats": _W(*_BASE) + """
 SELECT (SELECT count(*) FROM enrol_r) AS registros,
   count(DISTINCT USUARIO_DOCUMENTO) AS usuarios, count(DISTINCT ID_OFERTA_FORMATIVA) AS cursos,
   count(CASE WHEN rating <> 0 THEN 1 END) AS no_ceros,
   (SELECT count(CASE WHEN ACTIVO = 1 THEN 1 END) FROM catalog) AS cursos_activos,
   round(count(CASE WHEN rating <> 0 THEN 1 END)::DOUBLE
         / (count(DISTINCT USUARIO_DOCUMENTO) * count(DISTINCT ID_OFERTA_FORMATIVA)), 6) AS densidad,
   count(CASE WHEN rating <> 0 THEN 1 END) * 4 AS bytes_valores
 FROM ratings""",
    "user_activity_topn": _W(O.ENROL, O.RATINGS) + """
 SELECT USUARIO_DOCUMENTO, sum(rating) AS actividad FROM ratings GROUP BY 1
 ORDER BY actividad DESC, USUARIO_DOCUMENTO ASC LIMIT """ + str(TOP_USERS),
    "taken_courses": _W(O.ENROL, O.RATINGS) + " SELECT * FROM taken",
    "user_neighbours": _W(O.ENROL, O.RATINGS, O.neighbours_cte(PARAMS.similar_users))
    + " SELECT USUARIO_DOCUMENTO, neighbour, round(sim, 9) AS sim, rank FROM neighbours",
    "score_collaborative": _W(*_BASE, O.neighbours_cte(PARAMS.similar_users), O.collaborative_cte(_E))
    + " SELECT USUARIO_DOCUMENTO, ID_OFERTA_FORMATIVA, round(score, 6) AS score, rank FROM collab_top",
    "popularity_normaliser": _W(*_BASE, O.CANDIDATES) + " SELECT * FROM maxpop",
    "score_history": _W(*_BASE, O.CANDIDATES, O.history_cte(_E, PARAMS))
    + " SELECT USUARIO_DOCUMENTO, ID_OFERTA_FORMATIVA, round(score, 6) AS score, rank FROM hist_top",
    "regional_share": _W(*_BASE) + """,
 done AS (SELECT * FROM enrol_r WHERE CURSO_CULMINADO = 1 AND ID_OFERTA_FORMATIVA IS NOT NULL),
 ndc AS (SELECT NOMBRE_DRE AS region, ID_OFERTA_FORMATIVA, count(*) AS n_dc FROM done
         WHERE NOMBRE_DRE IS NOT NULL AND NOMBRE_DRE <> '' GROUP BY 1, 2),
 nd AS (SELECT NOMBRE_DRE AS region, count(*) AS N_d FROM done GROUP BY 1)
 SELECT ndc.region, ndc.ID_OFERTA_FORMATIVA, n_dc, N_d, round(n_dc::DOUBLE / N_d, 6) AS share
 FROM ndc JOIN nd USING (region)
 WHERE ndc.ID_OFERTA_FORMATIVA IN (SELECT ID_OFERTA_FORMATIVA FROM catalog WHERE ACTIVO = 1)""",
    "audience_match": _W(*_BASE) + """,
 firstrow AS (SELECT USUARIO_DOCUMENTO, first(NIVELNEXUS ORDER BY ord) AS level FROM enrol_r GROUP BY 1)
 SELECT t.USUARIO_DOCUMENTO, t.ID_OFERTA_FORMATIVA,
   coalesce(CASE WHEN f.level IS NULL THEN upper(c.PUBLICO_OBJETIVO) = 'TODOS'
        WHEN f.level = '' THEN false
        ELSE contains(upper(c.PUBLICO_OBJETIVO), upper(f.level)) OR upper(c.PUBLICO_OBJETIVO) = 'TODOS' END,
        false) AS audience_match
 FROM taken t JOIN firstrow f USING (USUARIO_DOCUMENTO) JOIN catalog c USING (ID_OFERTA_FORMATIVA)""",
    "recommend_hybrid": O.recommend_sql(PARAMS),
    "recommend_fallback": O.recommend_sql(FALLBACK_PARAMS),
    "justification_prompts": O.justification_sql(PARAMS),
    "response_text": O.response_sql(PARAMS),
    "daily_metrics": O.with_(O.LOG) + """
 SELECT CAST("timestamp" AS DATE) AS fecha, tarea, count(*) AS consultas,
   round(avg(latencia_ms)) AS latencia_promedio_ms,
   CAST(sum(coalesce(tokens_entrada, 0) + coalesce(tokens_salida, 0)) AS BIGINT) AS tokens_totales
 FROM log GROUP BY 1, 2 ORDER BY fecha DESC, tarea""",
    "recommendation_history": O.with_(O.LOG, O.DETAILS) + """
 SELECT ca."timestamp", ca.usuario, ca.nombre_usuario, rd.posicion, rd.id_oferta_formativa, rd.curso,
   rd.horas_programa, rd.publico_objetivo, rd.score_final, rd.algoritmos_usados, rd.tasa_culminacion,
   rd.calificacion_prom, rd.justificacion, ca.latencia_ms
 FROM log ca JOIN det rd ON rd.conversacion_id = ca.id WHERE ca.tarea = 'recomendacion'
 ORDER BY ca."timestamp" DESC, rd.posicion ASC""",
    "constraint_report": O.with_(O.LOG, O.DETAILS) + O.CONSTRAINTS,
    "route_candidates": O.with_(*O.routing_ctes(ROUTER))
    + " SELECT query_id, rank, knowledge_base, round(score, 6) AS score FROM cands",
    "route_decision": O.with_(*O.routing_ctes(ROUTER))
    + " SELECT query_id, kb, node, path, method, fast_path, score FROM decision",
    "escalation_prompts": O.with_(*O.routing_ctes(ROUTER)) + O.ESCALATION,
    "chunk_search": O.with_(*O.routing_ctes(ROUTER), O.search_cte(ROUTER)) + " SELECT * FROM hits",
    "context_text": O.with_(*O.routing_ctes(ROUTER), O.search_cte(ROUTER), O.CONTEXT)
    + " SELECT query_id, context, n_chunks FROM ctx",
    "answer_prompts": O.with_(*O.routing_ctes(ROUTER), O.search_cte(ROUTER), O.CONTEXT) + O.ANSWERS,
    "user_neighbours_skewed": _W(O.ENROL, O.RATINGS, O.SKEWED, O.neighbours_cte(PARAMS.similar_users, "skewed"))
    + " SELECT USUARIO_DOCUMENTO, neighbour, round(sim, 9) AS sim, rank FROM neighbours",
    "user_neighbours_hot": _W(O.ENROL, O.RATINGS, O.neighbours_cte(PARAMS.similar_users))
    + " SELECT USUARIO_DOCUMENTO, neighbour, round(sim, 9) AS sim, rank FROM neighbours",
    "score_popularity": _W(*_BASE, O.CANDIDATES) + f"""
 SELECT ua.USUARIO_DOCUMENTO, ua.ID_OFERTA_FORMATIVA,
   row_number() OVER (PARTITION BY ua.USUARIO_DOCUMENTO ORDER BY SCORE_POPULARIDAD DESC, ID_OFERTA_FORMATIVA) AS slot,
   round(CASE WHEN max_pop > 0 THEN least(greatest(SCORE_POPULARIDAD / max_pop, 0::DOUBLE), 1::DOUBLE) ELSE 0::DOUBLE END, 6) AS score
 FROM ua JOIN maxpop USING (USUARIO_DOCUMENTO) QUALIFY slot <= {_E}""",
    "score_novelty": _W(O.ENROL, O.CATALOG) + """
 SELECT ID_OFERTA_FORMATIVA, "AÑO_MAX", SCORE_NOVEDAD AS score FROM catalog WHERE ACTIVO = 1""",
    "user_courses": _W(O.ENROL) + """
 SELECT USUARIO_DOCUMENTO, ID_OFERTA_FORMATIVA, CURSO, "AÑO", CURSO_CULMINADO, APROBACION, CALIFICACIONES FROM enrol_r
 WHERE USUARIO_DOCUMENTO IN (SELECT CAST(user_id AS VARCHAR) FROM events)""",
    "course_info": _W(O.ENROL, O.CATALOG, O.LOG, O.DETAILS) + """
 SELECT ID_OFERTA_FORMATIVA, CURSO, HORAS_PROGRAMA, PUBLICO_OBJETIVO, TOTAL_INSCRITOS, SCORE_POPULARIDAD FROM catalog
 WHERE ID_OFERTA_FORMATIVA IN (SELECT id_oferta_formativa FROM det)""",
    "text_enrolments": _W(O.ENROL, O.TEXT_ENROL) + """
 SELECT * EXCLUDE (raw), round(least(greatest(raw, 0::DOUBLE), 5::DOUBLE), 4) AS RATING_COMPUESTO FROM text_enrol""",
    "recommend_requests": O.requests_sql(PARAMS),
    "constraint_violations": O.with_(O.LOG, O.DETAILS, O.DIRTY)
    + O.CONSTRAINTS.replace("FROM log", "FROM dirty_log").replace("FROM det", "FROM dirty_det"),
    "cascade_delete": O.with_(O.LOG, O.DETAILS) + """
 SELECT id, conversacion_id, posicion, score_final, curso FROM det
 WHERE conversacion_id NOT IN (SELECT id FROM log WHERE tokens_entrada % 2 = 0)""",
    "route_labelled": O.with_(*O.routing_ctes(ROUTER)) + """
 SELECT d.query_id, CASE WHEN x THEN lab ELSE kb END AS kb, CASE WHEN x THEN 'Nodo ' || n ELSE node END AS node,
   CASE WHEN x THEN 'Raiz > Nodo ' || n ELSE path END AS path, method, fast_path, score
 FROM (SELECT *, query_id % 40 AS n, 'kb_' || (query_id % 40) AS lab,
         NOT fast_path AND query_id % 40 IN (SELECT label FROM nodes) AS x FROM decision) d""",
    "search_with_fallback": O.with_(*O.routing_ctes(ROUTER), O.search_cte(ROUTER, general=True)) + " SELECT * FROM hits",
    "search_general": O.with_(*O.routing_ctes(ROUTER)) + """
 SELECT vec_id AS query_id, CASE WHEN g > 0 THEN 'qdrant' ELSE 'ninguna' END AS fuente_datos, CASE WHEN g > 0 THEN 'general' END AS nodo_navegacion,
   CAST(least(g, 3) AS INTEGER) AS n_ref FROM embeddings, (SELECT count(*) AS g FROM embeddings WHERE label % 3 = 0)""",
    "node_index": """
 SELECT 'kb_' || doc_id AS knowledge_base, 'Doc ' || doc_id AS name, 'Tema > Doc ' || doc_id AS path, lang || ',' || source AS keywords,
   'Doc ' || doc_id || '. Fuente ' || source || '. Palabras clave: ' || lang || ', ' || source || '.'
   || CASE WHEN doc_id % 2 = 0 THEN ' Preguntas que responde: q' || doc_id || ' | r' ELSE '' END AS embed_text
 FROM documents WHERE doc_id % 3 <> 0""",
}

SQL["chunk_search_cells"] = SQL["chunk_search"]
SQL["daily_metrics_by_batch"] = SQL["daily_metrics"]
SQL["search_texts"] = O.SEARCH_TEXTS
SQL["catalog_by_position"] = SQL["course_catalog"]
SQL["profile_by_key"] = SQL["user_profile"]
SQL["neighbours_by_batches"] = SQL["user_neighbours"]
SQL["profile_by_batches"] = SQL["user_profile"]
SQL["committed_history"] = SQL["recommendation_history"].replace("WHERE ca.tarea", "WHERE (ca.id % 4 = 0 OR ca.id % 4 = 1) AND ca.tarea")
