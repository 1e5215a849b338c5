import math
import random

import numpy as np
import pytest

from aularank.llm import op13_negatives as m

SCHEMA = "vec_id long, embedding array<float>, label int, rid int, cell string, score double"


def brute(rows, p):
    sound = []
    for i, v, c in rows:
        if i is None or v is None or c is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        sound.append((i, [math.floor(256 * float(np.float32(x))) for x in v], (c + 1) % 10 if i % 7 == 0 else c))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a in sound:
        if a[0] % p.anchor_mod:
            continue
        scored = sorted(((-dot(a[1], b[1]), b[0], k) for k, b in enumerate(sound) if b is not a))
        for s, i, k in [x for x in scored if sound[x[2]][2] == a[2]][: p.positives]:
            own = [(-t, j) for t, j, q in scored if sound[q][2] != a[2] and 30 * -s <= 100 * -t <= 90 * -s][: p.negatives]
            out += [(a[0], i, rank, j, -s, t) for rank, (t, j) in enumerate(own, 1)]
    return sorted(out)


def run(spark, rows, **params):
    p = m.MiningParams(**params)
    df = spark.createDataFrame([(*r, 3, "x", 0.5) for r in rows], SCHEMA)
    got = sorted(tuple(r) for r in m.hard_negatives(df, p).collect())
    assert got == brute(rows, p)
    return got


def vectors(n, dims, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.4, (6, dims))
    return [(i, [float(np.float32(x)) for x in centres[i % 6] + rng.normal(0, spread, dims)], int(rng.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("dims, first", [(8, 1), (8, 50), (5, 10), (1, 10)])
def test_equals_brute_force(spark, dims, first):
    assert run(spark, vectors(400, dims, dims + first), codewords=4, piece_rows=16, first_rows=first, anchor_mod=20)


def test_hot_vector_ties_and_repeated_scores(spark):
    rows = vectors(150, 4, 9) + [(1000 + i, [0.5, 0.25, 0.0, -0.5], i % 3) for i in range(150)]
    assert run(spark, rows, codewords=3, piece_rows=20, first_rows=5, anchor_mod=50)


def test_nulls_nonfinite_short_and_huge(spark):
    rows = vectors(60, 4, 2)
    rows += [(None, [1.0] * 4, 1), (200, None, 1), (300, [1.0] * 4, None), (400, [1.0, None, 0.0, 0.0], 1), (500, [float("nan")] * 4, 1),
             (600, [float("inf")] * 4, 1), (700, [0.5, 0.5], 1), (701, [0.4, 0.4], 2), (800, [], 2), (801, [1000.0, 3.0, 0.0, 0.0], 2)]
    assert run(spark, rows, codewords=4, anchor_mod=10)


def test_repeated_rows_are_rows_of_their_own(spark):
    rows = [(100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (3, [0.5, 0.0], 2)]
    got = [tuple(r) for r in m.hard_negatives(spark.createDataFrame([(*r, 3, "x", 0.5) for r in rows], SCHEMA)).collect()]
    assert got == [(100, 100, 1, 3, 256 * 256, 128 * 256)] * 2


def test_empty_and_lonely(spark):
    assert m.hard_negatives(spark.createDataFrame([], SCHEMA)).collect() == []
    assert run(spark, [(100, [1.0, 2.0], 1)]) == []


def test_components_beyond_the_limit_count_as_the_limit(spark):
    rows = [(100, [1e30, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.0], 2)]
    got = [tuple(r) for r in m.hard_negatives(spark.createDataFrame([(*r, 3, "x", 0.5) for r in rows], SCHEMA)).collect()]
    assert got == [(100, 1, 1, 2, m.LIMIT * 256, m.LIMIT * 128)]


def test_cells_come_by_falling_bounds_and_once():
    rng = random.Random(1)
    a, b = np.array([rng.random() for _ in range(7)]), np.array([rng.random() for _ in range(5)])
    got = list(m.in_order(a, b))
    assert [x[0] for x in got] == sorted((x + y for x in a for y in b), reverse=True)
    assert len({x[1:] for x in got}) == 35


def test_a_search_leaves_out_cells(spark):
    """Far clusters are certified away: anchors ask for few of the cells."""
    rng = np.random.default_rng(4)
    rows = [(i, (np.eye(4)[i % 4] * (1 if i % 8 < 4 else -1) + rng.normal(0, 0.01, 4)).tolist(), i % 3) for i in range(800)]
    p = m.MiningParams(codewords=6, first_rows=1)
    built = m.build_index(m.prepare(spark.createDataFrame([(*r, 3, "x", 0.5) for r in rows], SCHEMA), p), p)
    _, pieces, cells = built
    anchors = built[0].where("vec_id % 100 = 0").selectExpr("rid", "label", "vec", "array(50000L) as lo", "array(80000L) as hi", "array(50000L) as need")
    asked = sum(len(r["a_rid"]) // 8 for second in (False, True) for r in m.requests(anchors, cells, p, second).collect())
    assert 0 < asked < 0.5 * anchors.count() * (cells.rows > 0).sum()
