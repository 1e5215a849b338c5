import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aularank.operators import features as fe
from aularank.operators import logs as lg
from aularank.operators import retrieval as rt
from aularank.operators import scores as sc
from aularank.operators import similarity
from aularank.operators.similarity import user_neighbours
from aularank.sources import enrolments as en


def test_default_encoder_gives_unit_vectors(spark):
    df = spark.createDataFrame([(1, "hola mundo"), (2, None)], "id long, text string")
    rows = rt.embed(df, "text", "query: ", dim=64).collect()
    for r in rows:
        assert abs(np.linalg.norm(np.array(r.embedding)) - 1.0) < 1e-5


def test_schema_check_reports_missing_objects(spark):
    spark.createDataFrame([(1,)], "id int").createOrReplaceTempView("conversaciones_agente")
    got = {r.object: r.exists for r in lg.schema_check(spark).collect()}
    assert got["conversaciones_agente"] and not got["v_metricas_diarias"]


def test_audience_regex_mode(spark):
    cat = spark.createDataFrame([("c1", "PRIMARIA, INICIAL"), ("c2", "SECUNDARIA")],
                                "ID_OFERTA_FORMATIVA string, PUBLICO_OBJETIVO string")
    lv = spark.createDataFrame([("PRIM.*",), ("SECUNDARIA",)], "lvl string")
    got = {(r.lvl, r.ID_OFERTA_FORMATIVA) for r in sc.audience_matches(cat, lv, regex=True).collect()}
    assert got == {("PRIM.*", "c1"), ("SECUNDARIA", "c2")}
    lit = {(r.lvl, r.ID_OFERTA_FORMATIVA) for r in sc.audience_matches(cat, lv, regex=False).collect()}
    assert lit == {("SECUNDARIA", "c2")}


def test_empty_index_routes_to_general(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0], None)], "query_id long, embedding array<float>, llm_kb string")
    nodes = spark.createDataFrame([], "knowledge_base string, name string, description string, path string, node_vec_id long, embedding array<float>")
    r = rt.route_decision(rt.route_candidates(q, nodes), q, nodes).first()
    assert (r.kb, r.node, r.method, r.candidates, r.score) == ("general", "fallback", "sin_indice", [], None)


def test_similarity_universe_cap(spark):
    ratings = spark.createDataFrame(
        [("a", "c1", 2.5), ("a", "c2", 2.5), ("b", "c1", 1.0), ("c", "c1", 0.5), ("c", "c2", 0.5)],
        "USUARIO_DOCUMENTO string, ID_OFERTA_FORMATIVA string, rating double")
    full = {(r.USUARIO_DOCUMENTO, r.neighbour) for r in user_neighbours(ratings, 5).collect()}
    capped = {(r.USUARIO_DOCUMENTO, r.neighbour) for r in user_neighbours(ratings, 5, cap=2).collect()}
    # activity a=5, b=1, c=1: the cap of 2 keeps a and b (ties by id ascending)
    assert ("c", "a") in full and capped and all("c" not in p for p in capped)


@pytest.mark.parametrize("hot_raters", [1, 8, 1000])
def test_neighbours_with_hot_courses_equal_brute_force(spark, hot_raters):
    rng = random.Random(5)
    rows = {}
    for u in range(90):
        if u % 3 == 0:
            rows[(f"u{u:03d}", "hot")] = rng.choice([0.5, 2.5, 2.5])  # a course of a third of the users
        for _ in range(rng.randint(0, 3)):
            rows[(f"u{u:03d}", f"c{rng.randint(0, 30)}")] = rng.choice([0.0, 0.5, 1.5, 2.5])
    df = spark.createDataFrame([(u, c, r) for (u, c), r in rows.items()], "USUARIO_DOCUMENTO string, ID_OFERTA_FORMATIVA string, rating double")
    vec = {}
    for (u, c), r in rows.items():
        if r > 0:
            vec.setdefault(u, {})[c] = r
    want = {}
    for u, a in vec.items():
        sims = []
        for v, b in vec.items():
            dot = sum(x * b.get(c, 0.0) for c, x in a.items())
            if u != v and dot > 0:
                sims.append((-dot / (np.sqrt(sum(x * x for x in a.values())) * np.sqrt(sum(x * x for x in b.values()))), v))
        for rank, (_, v) in enumerate(sorted(sims)[:5], 1):
            want[(u, rank)] = v
    got = {(r.USUARIO_DOCUMENTO, r["rank"]): r.neighbour for r in user_neighbours(df, 5, hot_raters=hot_raters).collect()}
    assert got == want


def test_deep_tree_and_query_id_equal_to_node_id(spark):
    tree = {"name": "n79", "description": "d", "knowledge_base": "kb_deep"}
    for i in range(78, -1, -1):
        tree = {"name": f"n{i}", "description": "d", "children": [tree]}
    got = rt.flatten_tree(spark.createDataFrame([(json.dumps({"children": [tree]}),)], "json string")).collect()
    assert [r.knowledge_base for r in got] == ["kb_deep"] and len(got[0].path.split(" > ")) == 80
    nodes = spark.createDataFrame([("kb_7", "N7", "d", "p", 7, [1.0, 0.0]), ("kb_8", "N8", "d", "p", 8, [0.0, 1.0])],
                                  "knowledge_base string, name string, description string, path string, node_vec_id long, embedding array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert [r.knowledge_base for r in rt.route_candidates(q, nodes).orderBy("rank").collect()] == ["kb_7", "kb_8"]
    pair = spark.createDataFrame([(7, 7)], "left_id long, right_id long")
    assert [r.knowledge_base for r in rt.route_candidates(q, nodes, excluded=pair).collect()] == ["kb_8"]


def test_read_tree_missing_path_is_an_empty_index(spark, tmp_path):
    assert rt.read_tree(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "t.json").write_text('{"children": []}')
    assert rt.read_tree(spark, str(tmp_path / "t.json")).count() == 1


def test_encoder_is_loaded_once_a_task(spark):
    def load():
        return lambda s: s.map(lambda t: [float(len(t)), 1.0])

    rows = rt.embed(spark.createDataFrame([("ab",), (None,)], "text string"), "text", "q: ", encoder=load).collect()
    assert sorted(tuple(r.embedding) for r in rows) == [(3.0, 1.0), (5.0, 1.0)]


def test_point_lookups_and_new_courses(spark):
    cat = spark.createDataFrame([("c1", 1), ("c2", 1), ("c3", 0)], "ID_OFERTA_FORMATIVA string, ACTIVO int")
    taken = spark.createDataFrame([("u1", "c1"), ("u2", "c3")], "USUARIO_DOCUMENTO string, ID_OFERTA_FORMATIVA string")
    assert fe.course_info(cat, "c1").count() == 1 and fe.course_info(cat, "zz").count() == 0
    got = sorted(tuple(r) for r in fe.new_courses_for_users(taken, taken, cat).collect())
    assert got == [("u1", "c2"), ("u2", "c1"), ("u2", "c2")]
    assert [r.ID_OFERTA_FORMATIVA for r in fe.user_enrolments(taken, taken.limit(1)).collect()] == ["c1"]


def test_sources_fall_back_in_order(spark, tmp_path):
    spark.createDataFrame([(1,)], "a int").write.csv(str(tmp_path / "csv"), header=True)
    df, name = en.first_available([("table", lambda: en.read_table(spark, "no_such_table")), ("files", lambda: en.read_files(spark, str(tmp_path / "csv"), "csv"))])
    assert name == "files" and df.first().a == "1"
    with pytest.raises(RuntimeError):
        en.first_available([("table", lambda: en.read_table(spark, "no_such_table"))])
    seven = spark.createDataFrame([("u", "c", "x", 1, 1, "n", 2024)], "USUARIO_DOCUMENTO string, ID_OFERTA_FORMATIVA string, CURSO string, APROBACION int, ACTIVO int, NIVELNEXUS string, `AÑO` int")
    assert en.clean_enrolments(seven).first().CURSO == "x"  # no order column is required


def brute_neighbours(rows, n):
    vec = {}
    for u, c, r in rows:
        if r > 0:
            vec.setdefault(u, {})[c] = r
    out = set()
    for u, a in vec.items():
        sims = []
        for v, b in vec.items():
            dot = sum(x * b.get(c, 0.0) for c, x in a.items())
            if u != v and dot > 0:
                sims.append((-dot / (np.sqrt(sum(x * x for x in a.values())) * np.sqrt(sum(x * x for x in b.values()))), v))
        out |= {(u, v, rank) for rank, (_, v) in enumerate(sorted(sims)[:n], 1)}
    return out


def skewed_ratings(seed, users, courses):
    """Course popularity falls steeply, so a few courses are rated by most users and hardly two users are alike."""
    rng = random.Random(seed)
    rows = {}
    for u in range(users):
        for _ in range(rng.randint(1, 12)):
            rows[(f"u{u:03d}", f"c{int(courses * rng.random() ** 3):03d}")] = rng.choice([0.5, 1.0, 1.5, 2.0, 2.5])
    return [(u, c, r) for (u, c), r in rows.items()]


@pytest.mark.parametrize("seed, hot_raters, block", [(1, 3, 1024), (2, 10, 4), (3, 40, 16), (4, 0, 8)])
def test_pruned_neighbours_equal_brute_force(spark, monkeypatch, seed, hot_raters, block):
    monkeypatch.setattr(similarity, "BLOCK", block)
    rows = skewed_ratings(seed, 150, 60)
    df = spark.createDataFrame(rows, "USUARIO_DOCUMENTO string, ID_OFERTA_FORMATIVA string, rating double")
    got = {(r.USUARIO_DOCUMENTO, r.neighbour, r["rank"]) for r in user_neighbours(df, 5, hot_raters=hot_raters).collect()}
    assert got == brute_neighbours(rows, 5)


def test_one_course_of_all_users_makes_no_pairs_of_them_all(spark):
    """Every user rates the hot course, classes are users, and still each asks for few of the others."""
    rng = random.Random(6)
    rows = []
    for u in range(400):
        rows.append((f"u{u:03d}", "hot", 0.5))
        for k in range(6):
            rows.append((f"u{u:03d}", f"g{u // 8}-{k}", rng.choice([1.5, 2.0, 2.5])))
    df = spark.createDataFrame(rows, "USUARIO_DOCUMENTO string, ID_OFERTA_FORMATIVA string, rating double")
    got = {(r.USUARIO_DOCUMENTO, r.neighbour, r["rank"]) for r in user_neighbours(df, 5, hot_raters=20).collect()}
    assert got == brute_neighbours(rows, 5)
    n2 = {u: sum(r * r for v, _, r in rows if v == u) for u in {x[0] for x in rows}}
    classes = spark.createDataFrame([(u, [(400, "hot", 0.5)], n2[u], 1, 0.9) for u in n2], "cls string, sig array<struct<raters long, course string, rating double>>, nrm2 double, size long, kth double")
    assert similarity.hot_candidates(classes, 5).count() == 0  # all found among the cold pairs: nothing is asked
    alone = classes.selectExpr("cls", "sig", "nrm2", "size", "0.0D as kth")
    assert similarity.hot_candidates(alone, 5).count() < 0.1 * 400 * 400


def test_equal_users_are_one_class(spark):
    rows = [(f"u{u:03d}", "hot", 2.5) for u in range(300)] + [("x", "hot", 0.5), ("x", "z", 2.0)]
    df = spark.createDataFrame(rows, "USUARIO_DOCUMENTO string, ID_OFERTA_FORMATIVA string, rating double")
    got = {(r.USUARIO_DOCUMENTO, r.neighbour, r["rank"]) for r in user_neighbours(df, 5, hot_raters=2).collect()}
    assert got == brute_neighbours(rows, 5)
