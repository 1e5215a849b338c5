import random
import zlib
from collections import defaultdict

import numpy as np

from aularank.llm import op6_sharding


def test_laws(spark, docs_of):
    rng = random.Random(5)
    rows = [(i, "w" * rng.randint(0, 400) + " x" * rng.randint(0, 50)) for i in range(3000)]
    rows += [(10_000 + i, "copy of one text") for i in range(1500)] + [(20_000 + i, "pair") for i in range(2)] + [(40_000 + i, "many copies") for i in range(150)]
    rows += [(30_000, None), (30_001, ""), (None, "no id"), (30_002, "twice"), (30_002, "twice")]
    got = op6_sharding.shard(docs_of(rows), shards=8).collect()
    assert len(got) == len(rows)
    text = defaultdict(list)
    for i, t in rows:
        text[i].append(t or "")
    slots, size = defaultdict(list), defaultdict(int)
    for r in got:
        t = text[r["doc_id"]][0]
        assert (r["size"], r["text_crc32"]) == (len(t.encode()) + 16, zlib.crc32(t.encode()))
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
    assert set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) - min(size.values()) < 0.02 * max(size.values())
    by_text = defaultdict(set)
    for r in got:
        by_text[text[r["doc_id"]][0]].add(r["shard"])
    assert len(by_text["many copies"]) == 1  # over a sixty-fourth of a shard, under half of one
    assert len(by_text["pair"]) == 1 and len(by_text["twice"]) == 1
    assert len(by_text["copy of one text"]) > 4  # a third of all rows: split


def test_place_takes_the_highest_dot_product():
    at = op6_sharding.place(np.array([[4.0, 1, 1], [3, 3, 1], [2, 1, 1], [1, 1, 1]]), 2)
    assert sorted(np.bincount(at, [4, 3, 2, 1])) == [5, 5]


def test_empty(spark, docs_of):
    assert op6_sharding.shard(docs_of([(1, "a")]).limit(0)).count() == 0
    assert op6_sharding.shard(docs_of([(1, "a")])).first()["slot"] == 0


def test_equal_rows_are_dealt_apart(spark, docs_of):
    """Half of all rows are one identical row: shards still have equal sizes, also with a very long text among them."""
    rows = [(7, "one and the same row")] * 1500 + [(100 + i, f"text {i}") for i in range(1500)]
    got = op6_sharding.shard(docs_of(rows), shards=10).collect()
    size, slots = defaultdict(int), defaultdict(list)
    for r in got:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(got) == 3000 and max(size.values()) < 1.1 * min(size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    long = op6_sharding.shard(docs_of([(1, "w " * 500_000), (2, "x")]), shards=2).collect()
    assert sorted((r["doc_id"], r["size"], r["n_tokens"]) for r in long) == [(1, 1_000_016, 500_000), (2, 17, 1)]
