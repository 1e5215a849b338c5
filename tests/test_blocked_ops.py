"""Multi-block / multi-partition paths checked against brute force."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from aularank.functions.ranking import first_untaken, segment_positions
from aularank.operators.vectors import top_k_dot


def test_top_k_dot_many_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    left = [(i, f"g{i % 3}", rng.normal(size=8).astype(np.float32).tolist()) for i in range(60)]
    right = [(100 + j, f"g{j % 3}", rng.normal(size=8).astype(np.float32).tolist()) for j in range(90)]
    ldf = spark.createDataFrame(left, "id long, group string, vec array<float>")
    rdf = spark.createDataFrame(right, "id long, group string, vec array<float>")
    got = {(r.left_id, r.rank): r.right_id for r in top_k_dot(ldf, rdf, 4, block_rows=7).collect()}
    want = {}
    for i, g, v in left:
        cands = [(-float(np.dot(np.array(v, np.float64), np.array(w, np.float64))), j) for j, h, w in right if h == g]
        for rank, (_, j) in enumerate(sorted(cands)[:4], 1):
            want[(i, rank)] = j
    assert got == want


def test_segment_positions_and_first_untaken(spark):
    rng = np.random.default_rng(5)
    rows = [(f"s{s}", f"c{c:03d}", float(rng.integers(0, 20))) for s in range(3) for c in range(40)]
    df = spark.createDataFrame(rows, "seg string, course string, score double")
    ranked = segment_positions(df, ["seg"], [F.col("score").desc(), F.col("course").asc()], partitions=7)
    got = {(r.seg, r.course): r.pos for r in ranked.collect()}
    pdf = pd.DataFrame(rows, columns=["seg", "course", "score"]).sort_values(
        ["seg", "score", "course"], ascending=[True, False, True])
    pdf["pos"] = pdf.groupby("seg").cumcount() + 1
    assert got == {(a, b): p for a, b, p in pdf[["seg", "course", "pos"]].itertuples(index=False)}

    users = spark.createDataFrame([("u1", "s0"), ("u2", "s1")], "u string, seg string")
    top3 = pdf[pdf.seg == "s0"].course.tolist()[:3]
    taken = spark.createDataFrame([("u1", top3[0]), ("u1", top3[2])], "u string, course string")
    fu = first_untaken(users, ranked, taken, 2, "u", "course", ["seg"]).collect()
    got_u1 = [r.course for r in sorted((r for r in fu if r.u == "u1"), key=lambda r: r.slot)]
    s0 = [c for c in pdf[pdf.seg == "s0"].course if c not in (top3[0], top3[2])]
    assert got_u1 == s0[:2]
    assert len([r for r in fu if r.u == "u2"]) == 2


def test_pairs_of_blocks_are_dealt_over_as_many_tasks(spark, monkeypatch):
    from aularank.operators import vectors

    monkeypatch.setattr(vectors, "SIDE_ROWS", 8)
    rows = spark.range(400).selectExpr("id", "'g' as group", "array(cast(id % 17 as float), cast(id % 5 as float)) as vec")
    hits = vectors.top_k_dot(rows, rows, 3, block_rows=8)
    # 50 x 50 pairs of blocks: 625 tasks, however few partitions the session has.
    assert "hashpartitioning(group" in hits._jdf.queryExecution().toString() and ", 625), REPARTITION" in hits._jdf.queryExecution().toString()
    vec = [(i % 17, i % 5) for i in range(400)]
    first = sorted(range(400), key=lambda j: (-(vec[7][0] * vec[j][0] + vec[7][1] * vec[j][1]), j))[:3]
    assert [r["right_id"] for r in hits.where("left_id = 7").orderBy("rank").collect()] == first
