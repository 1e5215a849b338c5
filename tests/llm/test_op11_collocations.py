import random
import re
from collections import Counter

import numpy as np
import pytest

from aularank.llm import op11_collocations as m


def brute(rows, p):
    """The definition, phrase by phrase."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(low)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for z in range(1, p.longest + 1):
                for i in range(len(words) - z + 1):
                    f[lang, tuple(words[i : i + z])] += 1
    f = {k: c for k, c in f.items() if c >= p.least}
    found = []
    for (lang, v), a in f.items():
        if len(v) < 2:
            continue
        score, _, l, r = min((p.scale * a // (f[lang, v[:k]] + f[lang, v[k:]]), k, f[lang, v[:k]], f[lang, v[k:]]) for k in range(1, len(v)))
        inside = [c for (o, w), c in f.items() if o == lang and len(w) > len(v) and any(w[i : i + len(v)] == v for i in range(len(w)))]
        if not any(100 * c >= p.inside_percent * a for c in inside):
            found.append((lang, score, a, " ".join(v), l, r))
    out = []
    for lang in {x[0] for x in found}:
        own = sorted((x for x in found if x[0] == lang), key=lambda x: (-x[1], -x[2], x[3].encode()))[: p.top]
        out += [(lang, i, x[3], x[2], x[4], x[5], n[lang], x[1]) for i, x in enumerate(own, 1)]
    return sorted(out)


def frame(spark, rows):
    """With extra columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, t, g, "x", 1, 2, "y") for i, (g, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, suffix string, n int, rank int, phrase string")


def run(spark, rows, **params):
    p = m.CollocationParams(**params)
    got = sorted(tuple(r) for r in m.collocations(frame(spark, rows), p).collect())
    assert got == brute(rows, p)
    return got


def texts(seed, n):
    rng = random.Random(seed)
    words = ["a", "B", "été", "x\x01", "\x1f", "d-e", "zz", "日本", "q"]
    out = []
    for _ in range(n):
        body = "".join(rng.choice(words[: rng.randint(2, 9)]) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", "!", ","]) for _ in range(rng.randint(0, 60)))
        out.append((rng.choice(["en", "en", "de", None, "und"]), body))
    return out


@pytest.mark.parametrize("budget", [10, 100_000])
def test_equals_brute_force_with_small_and_large_groups(spark, budget):
    assert run(spark, texts(budget, 60), least=3, budget_rows=budget, most_groups=10_000)


def test_top_is_cut_after_ties_in_byte_order(spark):
    rows = [("en", "zz é. zz b. zz é. zz b. q a. q a")] * 3
    got = run(spark, rows, least=3, top=2)
    assert [r[1] for r in got] == [1, 2]


def test_null_empty_long_and_repeated_texts(spark):
    long = "over and under. " * 20_000
    rows = [(None, None), ("en", ""), ("en", " \t. ,"), ("en", long), ("und", "to be or not"), (None, "to be or not"), (None, "to be or not")]
    got = run(spark, rows, least=3)
    assert ("und", 1, "to be or not", 3, 3, 3, 12, 1_000_000) in got


def test_empty_table(spark):
    assert m.collocations(frame(spark, []).limit(0)).collect() == []


def test_rare_words_are_cut_but_counted(spark):
    """Slots only ever keep too much: with every slot taken nothing is cut, and counts stay."""
    text = [b"the cat sat. the cat ran"]
    all_, none = np.full(m.BUCKETS * m.BITS // 8, 255, np.uint8), np.zeros(m.BUCKETS * m.BITS // 8, np.uint8)
    for table in (all_, none):
        assert sum(int(n.sum()) for _, n, _ in m.suffix_counts(text, "en", table, 4)) == 6
    kept = {s: int(c) for suffix, n, _ in m.suffix_counts(text, "en", all_, 4) for s, c in zip(suffix, n)}
    assert kept == {b"the cat sat ": 1, b"cat sat ": 1, b"sat ": 1, b"the cat ran ": 1, b"cat ran ": 1, b"ran ": 1}


def test_every_frequent_word_and_pair_keeps_its_bit(spark):
    rows = texts(7, 80)
    docs = frame(spark, rows).selectExpr("coalesce(lang, 'und') as lang", "coalesce(text, '') as text")
    table = m.often(docs, 5)
    assert 0 < np.unpackbits(table).sum() < 500
    f = {}
    for lang in {"und" if g is None else g for g, _ in rows}:
        x, words, h = m.words_of([(t or "").encode() for g, t in rows if (g or "und") == lang], lang)
        word, pair = m._bits(table, m.word_keys(h)), {}
        for k, n in enumerate(np.bincount(x, minlength=len(h))):
            assert k == 0 or n < 5 or word[k]
        for a, b in zip(x, x[1:]):
            if a and b:
                pair[a, b] = pair.get((a, b), 0) + 1
        for (a, b), n in pair.items():
            assert n < 5 or m._bits(table, m.pair_keys(h[[a]], h[[b]]))[0]
            f[lang, a, b] = n
    assert max(f.values()) >= 5


def test_subtree_totals():
    rows = [(0, 2, "en", s, n) for s, n in [(b"a ", 1), (b"a b ", 2), (b"a b c ", 3), (b"a d ", 1)]]
    assert sorted(m.subtree(iter(rows), 3)) == [("en", 1, b"a", 7), ("en", 2, b"a b", 5), ("en", 3, b"a b c", 3)]
