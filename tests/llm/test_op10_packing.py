import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from aularank.llm import op10_packing as P


def slow(length, source, cluster, capacity):
    bins, out = [], []
    for n, s, c in zip(length, source, cluster):
        fit = [b for b in bins if b[0] >= n and (s < 0 or s not in b[1]) and (c < 0 or c not in b[2])]
        b = min(fit, key=lambda x: x[0], default=None)
        if b is None:
            b = [capacity, set(), set(), len(bins)]
            bins.append(b)
        b[0] -= n
        b[1].add(s)
        b[2].add(c)
        out.append(b[3])
    return out, bins


def test_best_fit_takes_a_tightest_compatible_bin():
    rng = random.Random(6)
    for _ in range(40):
        n = rng.randint(0, 200)
        length = np.array(sorted((rng.randint(1, 100) for _ in range(n)), reverse=True), np.int64)
        source = np.array([rng.choice([-1, 0, 0, 0, *range(1, 90)]) for _ in range(n)], np.int64)
        cluster = np.array([rng.randint(-1, 40) for _ in range(n)], np.int64)
        got = P.best_fit(length, source, cluster, 100)
        left, s_of, c_of = defaultdict(lambda: 100), defaultdict(set), defaultdict(set)
        for i, b in enumerate(got):
            ok = [left[x] for x in list(left) if left[x] >= length[i] and (source[i] < 0 or source[i] not in s_of[x]) and (cluster[i] < 0 or cluster[i] not in c_of[x])]
            if b in left:  # the tightest of all compatible bins
                assert left[b] == min(ok)
            else:
                assert not ok
            left[b] -= length[i]
            s_of[b].add(source[i])
            c_of[b].add(cluster[i])


def test_rows(spark, docs_of):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 150), f"s{rng.choice([0, 0, 0, rng.randint(1, 40)])}") for i in range(1500)]
    rows += [(2000 + i, "copy one two", f"t{i}") for i in range(30)] + [(3000, None, None), (3001, "", "s0"), (3002, "x " * 1000, "s0"), (None, "y", "s1"), (4005, "same", "s9"), (4005, "same", "s9")]
    for group in (16384, 200):
        got = P.pack_documents(docs_of(rows), P.PackingParams(capacity=128, group_rows=group)).collect()
        used, sources, texts, total = defaultdict(int), defaultdict(list), defaultdict(list), defaultdict(int)
        of = {i: (t, s) for i, t, s in rows}
        for r in got:
            t, s = of[r["doc_id"]]
            used[r["bin"]] += r["length"]
            if r["length"] < 128:
                sources[r["bin"]].append(s)
                texts[r["bin"]].append(t)
            total[r["doc_id"]] += r["length"]
            assert r["start"] == 128 * r["piece"] and 0 < r["length"] <= 128
        assert max(used.values()) <= 128
        assert all(len(x) == len(set(x)) for x in [*sources.values(), *texts.values()])
        for i, t, _ in rows:
            assert total[i] == (len((t or "").split()) + 1) * (2 if i == 4005 else 1)
    assert P.pack_documents(docs_of(rows).limit(0)).count() == 0


def test_lengths_below_one(spark, docs_of):
    got = P.pack(docs_of([(1, "a"), (2, "b")]), F.lit(None), F.lit(None)).collect()
    assert [r["length"] for r in got] == [1, 1] and len({r["bin"] for r in got}) == 2  # one source


def test_equal_rows_do_not_meet_in_one_group(spark, docs_of):
    docs = docs_of([(7, "one and the same row", "s")] * 1500 + [(100 + i, f"text {i}", f"s{i % 40}") for i in range(1500)])
    packed = P.pack_documents(docs, P.PackingParams(group_rows=200))
    assert packed.count() == 3000
    sizes = [r["n"] for r in packed.groupBy(F.shiftright("bin", 32).alias("g")).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 2 * 200
    assert packed.where("doc_id = 7").groupBy("bin").count().agg(F.max("count")).first()[0] == 1  # copies never share a bin


def test_a_very_long_text_is_packed_whole(spark, docs_of):
    got = P.pack_documents(docs_of([(1, "w " * 300_000), (2, "x")])).collect()
    assert sum(r["length"] for r in got if r["doc_id"] == 1) == 300_001
