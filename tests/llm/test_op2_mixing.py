import math
import random
import zlib
from collections import Counter

import numpy as np

from aularank.llm import op2_mixing


def corpus():
    rng = random.Random(3)
    parts = ["er", "th", "an", "ou", "tion", "st", "re", "in"]
    words = ["the", "of", "and", "Is"]
    rows = []
    for i in range(300):
        text = " ".join(rng.choice(words) if rng.random() < 0.5 else "".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(rng.randint(1, 120)))
        rows.append((i, text))
    return rows + [(300, None), (301, ""), (None, "the of"), (5, rows[5][1]), (5, rows[5][1])]


def test_scores(spark, docs_of):
    rows = corpus()
    got = op2_mixing.score(docs_of(rows).repartition(3), op2_mixing.LmParams(chunk_bytes=8000)).collect()
    assert len(got) == len(rows)
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if i is None else i, held(i), len(tokens(t)), sum(w in c for w in tokens(t)), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in rows)
    assert want == sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got)
    assert {r["train_tokens"] for r in got} == {n}
    held_rows = [r for r in got if r["held_out"]]
    # unseen texts cost less than the letters' plain code, and frequent words much less
    assert sum(r["score"] for r in held_rows) > -0.7 * sum(len(t or "") for i, t in rows if held(i))
    assert all(r["score"] < 0 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 5}) == 1


def test_token_probabilities_sum_to_one():
    words = [b"the", b"then", b"of", op2_mixing.END]
    zeros, ones, frequent = np.zeros(op2_mixing.SLOTS + 1), np.zeros(op2_mixing.SLOTS + 1), op2_mixing.beginnings(words)
    op2_mixing.bit_counts(words, np.array([50, 5, 30, 9]), zeros, ones, frequent)
    m = op2_mixing.Mixer.fresh()
    m.learn((zeros, ones, frequent), words, np.array([50, 5, 30, 9]))
    ready = (op2_mixing._stretch(zeros, ones).astype(np.float16), (zeros + ones).astype(np.float16), frequent)
    first = m.score(ready, [bytes([x]) for x in range(256) if x not in (10, 32)])
    # a byte and the space after it: no more than the byte alone, so all of them leave room for longer words
    assert (10 ** first).sum() + (10 ** m.score(ready, [op2_mixing.END])).sum() < 1
    assert m.score(ready, [b"the"])[0] > m.score(ready, [b"thq"])[0]


def test_text_score_is_online():
    logp = np.array([-1.0, -4.0])
    assert op2_mixing.text_score(np.array([1] * 50 + [0]), logp, np.zeros(2)) > -4 * 50 - 1  # repeated tokens get cheap
    assert op2_mixing.text_score(np.array([0]), logp, np.zeros(2)) <= -1.0 + 1e-9


def test_long_unbroken_token_pays_for_all_its_bytes(spark, docs_of):
    logp, share = np.array([-40_000.0, -1.0]), np.zeros(2)
    assert abs(op2_mixing.text_score(np.array([0, 1]), logp, share) - -40_001) < 2  # no floor: within the mixture's own cost
    rng = random.Random(4)
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    unbroken = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n))
    got = {r["doc_id"]: r["score"] for r in op2_mixing.score(docs_of([*corpus()[:50], (held[0], unbroken(20_000)), (held[1], unbroken(10_000))])).collect()}
    assert got[held[0]] < -20_000 and 1.8 < got[held[0]] / got[held[1]] < 2.2


def test_every_context_is_counted_at_any_size(spark):
    # 70,000 words, equally frequent: no word is too rare for the whole-word predictor, and all batches' counts add up
    words = [b"w%05d" % i for i in range(70_000)]
    vocabulary = spark.createDataFrame([(bytearray(w), 3, 2) for w in words] + [(bytearray(b"w0held"), 0, 0)], "word binary, c long, texts long").repartition(3)
    p = op2_mixing.LmParams(batch_bytes=100_000, bucket_bytes=50_000)
    packed = op2_mixing.batches_of(vocabulary, p)
    sums = packed.groupBy().sum("n", "v", "size").first()
    assert tuple(sums) == (210_000, 70_000, 7 * 70_001)
    answers = op2_mixing.count_paths(packed, sums[2], p).toArrow()
    assert len(set(answers["bucket"].to_pylist())) == 10
    whole = Counter(w[:i] for w in (x + b" " for x in words) for i in range(len(w) + 1))
    for r in packed.select("batch", "body").collect()[:2]:
        _, own, times = op2_mixing.opened(bytes(r["body"]))
        got = op2_mixing.answered(own, answers.filter(op2_mixing.pa.compute.equal(answers["batch"], r["batch"])))
        place, at = got.place[3], 0
        for w in own[:2000]:
            for i in range(len(w) + 1):
                # all that went on from this beginning, and all that went on with the same byte
                assert got.path[0][place[at]] == 2 * whole[w[:i]]
                assert got.path[8][place[at]] == 2 * whole[(w + b" ")[: i + 1]]
                at += 1


def test_empty_and_untrained(spark, docs_of):
    assert op2_mixing.score(docs_of([(1, "a")]).limit(0)).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = op2_mixing.score(docs_of([(only, "a b")])).first()
    assert r["held_out"] and r["train_tokens"] == 0 and r["base_score"] == 0 and r["n_known"] == 0


def test_counts_of_a_batch_take_32_bits_where_they_fit():
    words, pa = [b"one", b"on", b"two", b"\n"], op2_mixing.pa
    for most, kind in ((3, np.int32), (2**31, np.int64)):
        asked = op2_mixing.Paths(words, times=np.array([1, 2, most, 1]))
        path = op2_mixing.path_counts(asked.every, asked.n)
        steps = [path[0], *(path[:-1] - path[1:])]
        bodies = [op2_mixing.to_ipc(pa.RecordBatch.from_arrays([pa.array(x[part]) for x in steps], list("abcdefghi"))) for part in (slice(0, 7), slice(7, None))]
        got = op2_mixing.answered(words, pa.table([pa.array([1, 0]), pa.array(bodies[::-1], pa.binary())], ["bucket", "body"]))
        assert got.path.dtype == kind and np.array_equal(got.path, path)
