import random

import pytest
from pyspark.sql import functions as F

from aularank.functions.ranking import beaten_by, possible_firsts
from aularank.operators import scores as sc
from aularank.operators.features import COURSE, USER


def intervals(seed, n):
    rng = random.Random(seed)
    rows = []
    for seg in ("a", "b"):
        for i in range(n):
            lo = rng.randrange(40) / 40  # many ties
            rows.append((seg, f"c{i:03d}", lo, min(1.0, lo + rng.choice([0.0, 0.0, 0.05, 0.2]))))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_beaten_counts_the_items_that_come_first_for_every_user(spark, seed):
    rows = intervals(seed, 60)
    df = spark.createDataFrame(rows, "seg string, item string, lo double, hi double")
    got = {(r["seg"], r["item"]): r["beaten"] for r in beaten_by(df, ["seg"], "item", "lo", "hi").collect()}
    for seg, item, _, hi in rows:
        assert got[seg, item] == sum(s == seg and (lo > hi or (lo == hi and i < item)) for s, i, lo, _ in rows)


def test_a_user_reads_what_the_own_number_needs(spark):
    rows = intervals(3, 200)
    ranked = beaten_by(spark.createDataFrame(rows, "seg string, item string, lo double, hi double"), ["seg"], "item", "lo", "hi").cache()
    def read(users):
        out = possible_firsts(spark.createDataFrame(users, "u string, seg string, _k int"), ranked, ["seg"], "u").collect()
        return {u: {r["item"] for r in out if r["u"] == u} for u, _, _ in users}
    small = [("one", "a", 1), ("five", "a", 5), ("none", "a", 0), ("other", "b", 7)]
    alone, beside = read(small), read([*small, ("heavy", "a", 10_000)])
    assert all(alone[u] == beside[u] for u in alone)  # a heavy user enlarges only the own list
    assert len(beside["heavy"]) == 200 and not alone["none"]
    held = {(r["seg"], r["item"]): r["beaten"] for r in ranked.collect()}
    for u, seg, k in small:
        assert alone[u] == {i for (s, i), b in held.items() if s == seg and b < k}
    # whatever scores the bounds allow, the first k are among them
    rng = random.Random(4)
    for _ in range(20):
        exact = sorted(((-rng.uniform(lo, hi), i) for s, i, lo, hi in rows if s == "a"))
        assert {i for _, i in exact[:5]} <= alone["five"]


def test_history_equals_every_course_scored_for_every_user(spark):
    rng = random.Random(9)
    cat = [(f"c{i:03d}", round(rng.random() * 4, 4), 1, rng.choice(["TODOS", "PRIMARIA", "SECUNDARIA, PRIMARIA", None])) for i in range(90)]
    users = [(f"u{i:02d}", rng.choice(["PRIMARIA", "SECUNDARIA", "", None]), rng.choice(["R1", "R2", None]), rng.choice([1, 4, 60]))
             for i in range(25)] + [("heavy", "PRIMARIA", "R1", 4)]
    taken = {u[0]: set(rng.sample([c[0] for c in cat], rng.choice([0, 3, 30]))) for u in users}
    taken["heavy"] = {c[0] for c in cat[:85]}  # nearly the whole catalog
    done = [(u[0], u[2], c, 40 if u[0] == "heavy" else 1) for u in users for c in sorted(taken[u[0]]) if u[0] == "heavy" or rng.random() < 0.5]
    pop = {c[0]: c[1] for c in cat}
    want = {}
    for u, level, region, k in users:
        free = [c for c in cat if c[0] not in taken[u]]
        top = max(c[1] for c in free)
        total = sum(n for v, r, _, n in done if region and r == region and v != u)
        scored = []
        for c, p, _, aud in free:
            hit = (aud or "").upper() == "TODOS" if level is None else level != "" and ((aud or "").upper() == "TODOS" or level in (aud or ""))
            base = min(min(p / (top if top > 0 else 1.0), 1.0) * (1.3 if hit else 1.0), 1.0)
            n = sum(m for _, r, d, m in done if region and r == region and d == c)
            scored.append((-min(base + (n / total * 0.5 if total > 0 and n else 0.0), 1.0), c))
        want[u] = [(c, -s) for s, c in sorted(scored)[:k]]
    catalog = spark.createDataFrame(cat, f"{COURSE} string, {sc.POP} double, ACTIVO int, PUBLICO_OBJETIVO string").withColumn(sc.NOV, F.lit(0.1))
    ids = spark.createDataFrame([(u[0], u[3]) for u in users], f"{USER} string, _e int")
    t = spark.createDataFrame([(u, c) for u, held in taken.items() for c in held], f"{USER} string, {COURSE} string")
    first = spark.createDataFrame([u[:3] for u in users], f"{USER} string, level string, region string")
    rank = sc.popularity_ranking(catalog)
    pops = sc.first_popular(ids.withColumn("_k", F.col("_e")), rank, t, 60)
    out = sc.history_scores(first, spark.createDataFrame(done, f"{USER} string, region string, {COURSE} string, n long"), ids, catalog, t, rank,
                            pops, sc.popularity_normaliser(pops), 60)
    got = {}
    for r in out.orderBy(USER, "rank").collect():
        got.setdefault(r[USER], []).append((r[COURSE], r["score"]))
    assert got == want


def test_ratings_of_a_hub_are_dealt_into_parts(spark):
    rng = random.Random(5)
    near = spark.createDataFrame([(f"u{i}", n, rng.random()) for i in range(40) for n in ("hub", f"n{i % 7}")], f"{USER} string, neighbour string, sim double")
    rated = spark.createDataFrame([(n, f"c{j}", rng.randrange(1, 10) / 2) for n in ["hub", *(f"n{i}" for i in range(7))] for j in rng.sample(range(30), 9)],
                                  f"{USER} string, {COURSE} string, rating double")
    none = spark.createDataFrame([], f"{USER} string, {COURSE} string")
    runs = [{tuple(r) for r in sc.collaborative_scores(near, rated, none, 5, hub_users=h).collect()} for h in (3, 1000)]
    assert {(u, c, round(s, 9), k) for u, c, s, k in runs[0]} == {(u, c, round(s, 9), k) for u, c, s, k in runs[1]} and len(runs[0]) == 200
