import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aularank.llm import op12_toxic as m

BAD = ["idiot", "Moron,", "scumbag", "scummy"]


def corpus(n=240, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(80)]
    rows, labels = [], []
    for i in range(n):
        body = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        if i % 3 == 0:
            for _ in range(4):
                body.insert(rng.randrange(len(body)), rng.choice(BAD))
        rows.append((i, " ".join(body)))
        labels.append((i, int(i % 3 == 0)))
    return rows, labels


def brute(e, first, chain, start):
    """Marginals by the sum over all taggings of each text."""
    out, at = [], np.flatnonzero(first).tolist() + [len(e)]
    for a, b in zip(at, at[1:]):
        total, hot = 0.0, np.zeros(b - a)
        for tags in itertools.product((0, 1), repeat=b - a):
            w = start[tags[0]] + sum(chain[x][y] for x, y in zip(tags, tags[1:])) + sum(x * t for x, t in zip(e[a:b], tags))
            total += np.exp(w)
            hot += np.exp(w) * np.array(tags)
        out += (hot / total).tolist()
    return np.array(out)


@pytest.mark.parametrize("block", [1, 3, 128])
def test_marginals_are_sums_over_all_taggings(monkeypatch, block):
    monkeypatch.setattr(m, "BLOCK", block)
    rng = np.random.default_rng(block)
    for lengths in ([1], [7], [2, 1, 9, 4]):
        e = rng.normal(0, 3, sum(lengths))
        first = np.zeros(sum(lengths), bool)
        first[np.cumsum([0, *lengths[:-1]])] = True
        chain, start = rng.normal(0, 1, (2, 2)), rng.normal(0, 1, 2)
        assert np.allclose(m.marginals(e, first, chain, start), brute(e, first, chain, start), atol=1e-9)


def test_a_very_long_chain_stays_finite():
    e = np.tile([30.0, -30.0, 0.0], 50_000)
    p = m.marginals(e, np.arange(len(e)) == 0, np.array([[1.0, -5.0], [-5.0, 1.0]]), np.zeros(2))
    assert np.isfinite(p).all() and p[0] > 0.99 and p[1] < 0.01


def test_spans_are_code_point_offsets():
    text = "è  idiot moron ok\tscum"
    got = m.spans(text.encode(), np.array([0.1, 0.9, 0.7, 0.2, 0.6]), 0.5)
    assert [(text[s["start"] : s["end"]], s["p"]) for s in got] == [("idiot moron", 0.9), ("scum", 0.6)]


@pytest.fixture(scope="module")
def fitted(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return rows, dict(labels), m.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_held_out_documents_and_their_offsets(spark, fitted):
    rows, label, model = fitted
    got = m.judge(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 30
    assert sum(r["predicted"] == label[r["doc_id"]] for r in held) >= 0.95 * len(held)
    for r in held:
        for s in r["spans"]:
            assert all(w in BAD for w in r["text"][s["start"] : s["end"]].split())
        assert r["n_spans"] == len(r["spans"]) and 0 <= r["score"] <= 1
    # a beginning that was learned carries to a word that was not
    unseen = m.judge(spark.createDataFrame([(1, "abc scummiest de scummer fgh scumland a b scums ha")], "doc_id long, text string"), model).first()
    assert unseen["n_spans"] >= 2


def test_held_out_labels_are_never_read(spark):
    rows, labels = corpus(120)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    turned = table.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = m.fit(docs, table), m.fit(docs, turned)
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.gather, b.gather)


def test_null_empty_long_texts_and_clashing_names(spark, fitted):
    _, _, model = fitted
    rows = [(1, None, 0.5, "k", 7, 9), (2, "", 0.5, "k", 7, 9), (None, "idiot " * 100_000, 0.5, "k", 7, 9), (2, "", 0.5, "k", 7, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, _score string, body int, c0 int")
    out = m.judge(docs, model)
    assert out.columns[:6] == ["doc_id", "text", "__score", "_score", "body", "c0"]
    got = out.collect()
    assert [(r["__score"], r["_score"], r["body"], r["c0"]) for r in got] == [(0.5, "k", 7, 9)] * 4
    assert [r["n_words"] for r in got] == [0, 0, 100_000, 0] and got[0]["score"] == got[1]["score"] < 0.5
    assert got[2]["predicted"] == 1 and got[2]["held_out"] is True
    assert m.judge(docs.limit(0), model).collect() == []


def test_without_labels_nothing_is_toxic(spark):
    docs = spark.createDataFrame([(1, "idiot")], "doc_id long, text string")
    got = m.toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int")).first()
    assert (got["score"], got["predicted"], got["n_words"]) == (0.0, 0, 1)
