import json

from pyspark.sql import functions as F

from aularank.operators import retrieval as rt
from aularank.params import RouterParams

TREE = {
    "name": "Raiz", "description": "r", "keywords": ["a"],
    "children": [
        {"name": "Nav", "description": "nav", "keywords": ["n"], "children": [
            {"name": "Hoja1", "description": "d1", "keywords": ["x", "y"],
             "hypothetical_questions": ["q1", "q2"], "knowledge_base": "kb_1", "children": []},
            {"name": "Interno", "description": "d2", "keywords": [], "knowledge_base": "kb_2", "children": [
                {"name": "Hoja3", "description": "d3", "keywords": ["z"], "knowledge_base": "kb_3"},
            ]},
            {"name": "SinKB", "description": "d4", "children": [
                {"name": "Hoja4", "description": "d5", "keywords": ["w"], "knowledge_base": "kb_4",
                 "children": []},
            ]},
        ]},
        {"name": "Ignorado", "description": "x", "knowledge_base": "kb_x", "children": []},
    ],
}


def test_flatten_tree_preorder_paths_and_text(spark):
    trees = spark.createDataFrame([(json.dumps(TREE),)], "json string")
    rows = rt.flatten_tree(trees).orderBy("ord").collect()
    assert [r.knowledge_base for r in rows] == ["kb_1", "kb_2", "kb_3", "kb_4"]
    assert rows[0].path == "Nav > Hoja1"
    assert rows[2].path == "Nav > Interno > Hoja3"
    assert rows[3].path == "Nav > SinKB > Hoja4"
    assert rows[0].embed_text == "Hoja1. d1. Palabras clave: x, y. Preguntas que responde: q1 | q2"
    assert rows[1].embed_text == "Interno. d2. Palabras clave: ."


def test_route_decision_boundaries(spark):
    # literal candidate scores: (query, rank, kb, score)
    cands = spark.createDataFrame(
        [(1, 1, "kb_a", 0.90), (1, 2, "kb_b", 0.10),
         (2, 1, "kb_a", 0.82), (2, 2, "kb_b", 0.81),
         (3, 1, "kb_a", 0.59), (3, 2, "kb_b", 0.10),
         (4, 1, "kb_a", 0.70), (4, 2, "kb_b", 0.69),
         (5, 1, "kb_a", 0.70), (5, 2, "kb_b", 0.60),
         (6, 1, "kb_a", 0.65)],
        "query_id long, rank int, knowledge_base string, score double",
    ).withColumn("name", F.concat(F.lit("N "), "knowledge_base")).withColumn("path", F.lit("p")) \
        .withColumn("description", F.lit("d"))
    nodes = spark.createDataFrame([("kb_a", "N kb_a", "p"), ("kb_b", "N kb_b", "p"), ("kb_c", "N kb_c", "p")],
                                  "knowledge_base string, name string, path string")
    queries = spark.createDataFrame([(1, None), (2, None), (3, " kb_c "), (4, "kb_b"), (5, "zzz"), (6, None)],
                                    "query_id long, llm_kb string")
    got = {r.query_id: r for r in rt.route_decision(cands, queries, nodes, RouterParams()).collect()}
    assert got[1].fast_path and got[1].method == "embeddings ⚡ (score alto (0.9000))"
    assert got[2].fast_path  # 0.82 exactly is fast
    assert not got[3].fast_path and got[3].kb == "kb_c" and got[3].method == "llm 🤖 (score bajo (0.5900))"
    assert not got[4].fast_path and got[4].kb == "kb_b" and "empate (diff=0.0100)" in got[4].method
    assert got[5].fast_path and got[5].kb == "kb_a" and "score ok" in got[5].method
    assert got[6].fast_path  # missing second candidate counts as 0.0


def test_search_falls_back_to_general_collection(spark):
    chunks = spark.createDataFrame(
        [(10, "general", "f1", 1, "t1", [1.0, 0.0]), (11, "general", None, None, None, [0.0, 1.0]),
         (12, "kb_a", "f3", 3, "t3", [0.6, 0.8])],
        "chunk_id long, kb string, filename string, chunk int, text string, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, embedding array<float>")
    routed = spark.createDataFrame([(1, "kb_empty"), (2, "kb_a")], "query_id long, kb string")
    hits = rt.search_chunks(routed, queries, chunks, RouterParams(chunk_top_k=2)).collect()
    by = {}
    for h in hits:
        by.setdefault(h.query_id, []).append(h)
    assert [h.kb for h in sorted(by[1], key=lambda h: h.rank)] == ["general", "general"]
    assert sorted(by[1], key=lambda h: h.rank)[1].filename == "" and sorted(by[1], key=lambda h: h.rank)[1].chunk == 0
    assert [h.kb for h in by[2]] == ["kb_a"] and by[2][0].score == 0.8
    ctx = {r.query_id: r.context for r in rt.context_text(spark.createDataFrame(hits)).collect()}
    assert ctx[1] == "[f1]\nt1\n\n\n[]\n\n"
