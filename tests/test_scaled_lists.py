"""Steps whose data moved must follow the input: neighbour lists, blocked search, first untaken, lists within reach."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from aularank.functions import ranking
from aularank.operators import scores, similarity, vectors
from aularank.operators.features import COURSE, USER
from aularank.plans import registry
from test_misc_ops import brute_neighbours, skewed_ratings


@pytest.mark.parametrize("odd", [False, True])
def test_neighbours_by_lists_and_by_products_equal_brute_force(spark, monkeypatch, odd):
    for name, value in (("DENSE", 6), ("MET", 500), ("SIDE", 40), ("TILE", 600), ("BLOCK", 8)):
        monkeypatch.setattr(similarity, name, value)
    rows = skewed_ratings(7, 150, 60)
    rows += [(f"x{i}", "c000", 2.5) for i in range(9)] + [(f"y{i}", f"z{i // 2}", 1.25 if odd else 1.0) for i in range(9)]  # equal users; ratings that no byte holds
    df = spark.createDataFrame(rows, "USUARIO_DOCUMENTO string, ID_OFERTA_FORMATIVA string, rating double")
    got = {(r.USUARIO_DOCUMENTO, r.neighbour, r["rank"]) for r in similarity.user_neighbours(df, 5, hot_raters=4).collect()}
    assert got == brute_neighbours(rows, 5)


def test_unasked_courses_count_in_the_product(spark):
    # one rare course of each group is far heavier than the common one, so the common one is not asked
    rows = [(f"u{u:02d}", f"g{u // 8}", 2.5) for u in range(48)] + [(f"u{u:02d}", "all", 0.5) for u in range(0, 48, 2)]
    df = spark.createDataFrame(rows, "USUARIO_DOCUMENTO string, ID_OFERTA_FORMATIVA string, rating double")
    got = {(r.USUARIO_DOCUMENTO, r.neighbour, r["rank"]) for r in similarity.user_neighbours(df, 5, hot_raters=10).collect()}
    assert got == brute_neighbours(rows, 5)
    _, classes = similarity._classes(df.selectExpr("USUARIO_DOCUMENTO user", "ID_OFERTA_FORMATIVA", "rating"), 2)
    entries = classes.select("nr", "n2", "size", F.explode("sig").alias("x")).select("nr", "n2", "size", "x.c", F.col("x.rating").alias("r"))
    asked = similarity._asked(entries, classes, 2, 10).collect()
    assert {r.asked for r in asked if r.hot} == {False} and {r.asked for r in asked if not r.hot} == {True}


def test_search_copies_a_row_for_few_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "", rng.normal(size=4).astype(np.float32).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, group string, vec array<float>")
    plan = vectors.top_k_dot(df, df, 3, block_rows=16)
    sides = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "/ 16384" in sides.replace("16384.0", "16384")  # not 38 x 38 pairs of blocks
    got = {(r.left_id, r["rank"]): r.right_id for r in plan.collect()}
    m = np.array([v for _, _, v in rows], np.float64)
    want = np.argsort(-(m @ m.T), axis=1, kind="stable")[:, :3]
    assert got == {(i, k + 1): int(want[i, k]) for i in range(600) for k in range(3)}


def test_first_untaken_gives_each_user_an_array(spark):
    ranking_ = spark.createDataFrame([(f"c{i}", i) for i in range(1, 9)], "c string, pos int")
    users = spark.createDataFrame([("a", 3), ("b", 20), ("z", 0)], "u string, _k int")
    taken = spark.createDataFrame([("a", "c1"), ("a", "c1"), ("a", "c3"), ("b", "c8"), ("a", "none")], "u string, c string")
    out = ranking.first_untaken(users, ranking_, taken, 1, "u", "c")
    assert "LeftAnti" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.u, r.slot, r.c) for r in out.collect())
    assert got == [("a", 1, "c2"), ("a", 2, "c4"), ("a", 3, "c5")] + [("b", i, f"c{i}") for i in range(1, 8)]


def test_only_rows_within_reach_are_ranked(spark):
    rng = np.random.default_rng(2)
    rows = [(s, f"i{i:04d}", float(x), float(min(1.0, x + 0.02))) for s in "ab" for i, x in enumerate(rng.random(500))]
    df = spark.createDataFrame(rows, "s string, i string, lo double, hi double")
    users = spark.createDataFrame([("u", "a", 5), ("v", "a", 9), ("w", "b", 600)], "u string, s string, _k int")
    kept = ranking.within_reach(df, users, ["s"], "lo", "hi")
    counts = {r.s: r["count"] for r in kept.groupBy("s").count().collect()}
    assert counts["a"] < 50 and counts["b"] == 500
    answer = lambda x: sorted((r.u, r.i) for r in ranking.possible_firsts(users, ranking.beaten_by(x, ["s"], "i", "lo", "hi"), ["s"], "u").collect())
    assert answer(kept) == answer(df)


def test_files_by_position_follow_the_rows(spark, tmp_path, monkeypatch):
    tables = {
        "region": spark.createDataFrame([(0, "R")], "r_regionkey int, r_name string"),
        "nation": spark.createDataFrame([(0, "N", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": spark.createDataFrame([(1, "c", 0, "M")], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"),
        "part": spark.createDataFrame([(1, "p", "b", "PROMO", 3)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int"),
        "orders": spark.range(300).selectExpr("id o_orderkey", "1L o_custkey", "date'2020-01-01' o_orderdate", "'1' o_orderpriority"),
        "lineitem": spark.range(300).selectExpr("id l_orderkey", "1 l_linenumber", "1L l_partkey", "1L l_suppkey", "10.0D l_quantity", "0.1D l_discount", "'A' l_returnflag"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    monkeypatch.setattr(registry, "FILE_ROWS", 25)
    catalog = registry.q_catalog_by_position(spark, str(tmp_path))
    assert len(set(catalog.inputFiles())) == 12  # eight or fewer before, whatever the rows
    assert [(r.ID_OFERTA_FORMATIVA, r.TOTAL_INSCRITOS) for r in catalog.collect()] == [("1", 300)]


def test_products_of_neighbours_travel_as_lists(spark):
    rng = random.Random(8)
    ids = [f"u{i}" for i in range(12)]
    near = [(u, v, rng.random()) for u in ids for v in rng.sample(ids, 4) if u != v]
    rated = [(u, f"c{j}", rng.randrange(0, 10) / 2) for u in ids for j in rng.sample(range(25), 9)] + [("u1", None, 2.0)]
    held = [(u, c) for u, c, _ in rated if rng.random() < 0.7] + [(None, "c3"), ("u2", "elsewhere"), ("u3", None)]
    df = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    out = scores.collaborative_scores(df(near, f"{USER} string, neighbour string, sim double"), df(rated, f"{USER} string, {COURSE} string, rating double"),
                                      df(held, f"{USER} string, {COURSE} string"), 5)
    want = {}
    for u in ids:
        sums = {}
        for who, v, sim in near:
            for w, c, r in rated:
                if who == u and w == v and r > 0 and (c is None or (u, c) not in held):
                    sums[c] = sums.get(c, 0.0) + sim * r
        ranked = sorted((-round(s / max(sums.values()), 9), c or "") for c, s in sums.items())
        want.update({(u, c, k + 1): -s for k, (s, c) in enumerate(ranked[:5])})
    assert {(r[USER], r[COURSE] or "", r["rank"]): round(r["score"], 9) for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(rf"hashpartitioning\({USER}#\d+, (_c|{COURSE})#", plan), plan  # sums need no shuffle of their own


def test_nearest_of_some_users_equals_brute_force(spark):
    rng = random.Random(3)
    rated = {f"u{i}": {f"c{j}": rng.randrange(1, 10) / 2 for j in rng.sample(range(14), rng.randrange(1, 6))} for i in range(40)}
    rated["twin"] = dict(rated["u7"])
    n2 = {u: sum(x * x for x in own.values()) for u, own in rated.items()}
    some = {"u7", "u8", "u9", "twin"}
    rows = spark.createDataFrame([(u, c, x, n2[u]) for u, own in rated.items() for c, x in own.items()], f"{USER} string, {COURSE} string, rating double, n2 double")
    mine = rows.where(rows[USER].isin(*some))
    for asking, posted, left, right in ((mine, rows, some, rated), (rows, mine, rated, some)):
        want = set()
        for u in left:
            sims = [(-sum(x * rated[v].get(c, 0.0) for c, x in rated[u].items()) / (n2[u] ** 0.5 * n2[v] ** 0.5), v) for v in right if v != u]
            want |= {(u, v, k + 1) for k, (s, v) in enumerate(sorted(x for x in sims if x[0] < 0)[:5])}
        out = similarity.nearest(asking, posted, 5)
        assert {(r[USER], r["neighbour"], r["rank"]) for r in out.collect()} == want
    assert similarity.nearest(mine.limit(0), rows, 5).count() == similarity.nearest(rows, mine.limit(0), 5).count() == 0
