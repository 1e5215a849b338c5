import numpy as np
import pytest
from pyspark.sql import functions as F

from aularank.operators.vectors import cell_visits, centroid_index, top_k_dot, top_k_dot_cells


def table(spark, ids, groups, x):
    return spark.createDataFrame([(int(i), g, [float(v) for v in row]) for i, g, row in zip(ids, groups, x)], "id long, group string, vec array<float>")


def brute(lg, lx, rg, rx, k):
    out = {}
    for i, g in enumerate(lg):
        s = [(-round(float(np.float32(lx[i]).astype(float) @ np.float32(rx[j]).astype(float)), 9), j) for j in range(len(rg)) if rg[j] == g]
        out[i] = sorted(s)[:k]
    return out


@pytest.mark.parametrize("spread", [0.02, 5.0])
def test_equal_to_every_row_scored_and_cells_are_skipped(spark, spread):
    rng = np.random.default_rng(1)
    heads = rng.normal(size=(8, 6)) * 3
    rx = np.repeat(heads, 40, axis=0) + rng.normal(size=(320, 6)) * spread
    rx[5] = rx[7]  # a repeated vector
    rx[9] = 0.0
    rg = ["a" if j % 4 else "b" for j in range(320)]
    rg[11] = "one"
    lx = np.vstack([heads + rng.normal(size=(8, 6)) * 0.1, np.zeros((1, 6)), -heads[:2]])
    lg = ["a", "b", "a", "a", "b", "a", "one", "none", "a", "b", "a"]
    left, right = table(spark, range(11), lg, lx), table(spark, range(320), rg, rx)
    got = {i: [] for i in range(11)}
    for r in top_k_dot_cells(left, right, 5, 16, block_rows=50).orderBy("left_id", "rank").collect():
        got[r.left_id].append((-round(r.score, 9), r.right_id))
    assert got == brute(lg, lx, rg, rx, 5)
    index, cells = centroid_index(right, 16, 50)
    assert index.count() == 320
    held = {(r.group, r.cell): (np.array(r.centre, float), r.radius) for r in cells.collect()}
    for r in index.collect():
        centre, radius = held[r.group, r.cell]
        assert np.linalg.norm(np.array(r.vec, float) - centre) <= radius
    if spread < 1:
        seen = {r["round"]: r["n"] for r in cell_visits(left, index, cells, 5, 50)[1].groupBy("round").agg(F.count(F.lit(1)).alias("n")).collect()}
        assert seen[0] > seen.get(2, 0)  # most cells that are not the first are ruled out


def test_excluded_pairs_empty_sides_and_small_collections(spark):
    rng = np.random.default_rng(2)
    left, right = table(spark, range(3), ["a"] * 3, rng.normal(size=(3, 4))), table(spark, range(4), ["a"] * 4, rng.normal(size=(4, 4)))
    gone = spark.createDataFrame([(0, 1), (0, 2)], "left_id long, right_id long")
    rows = lambda df: {(r.left_id, r.right_id, round(r.score, 9), r["rank"]) for r in df.collect()}
    assert rows(top_k_dot_cells(left, right, 10, 3, excluded=gone)) == rows(top_k_dot(left, right, 10, excluded=gone))
    assert top_k_dot_cells(left, right.limit(0), 2, 3).count() == 0
    assert top_k_dot_cells(left.limit(0), right, 2, 3).count() == 0
