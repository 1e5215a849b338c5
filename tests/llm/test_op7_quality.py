import random
import re
from collections import Counter

from hypothesis import given
from hypothesis import strategies as st

from aularank.llm import op7_quality as Q


def brute(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i: i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i: i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@given(st.text(alphabet="ab é\n\t#*\x0b\x1c\u00a0|", max_size=120))
def test_counts(s):
    assert Q.counts(s.encode(), s.encode().split()) == brute(s)


def make(rng, good):
    words = ["".join(rng.choices(["er", "th", "an", "ou", "st"], k=rng.randint(1, 4))) for _ in range(rng.randint(60, 120))]
    return " ".join(words if good else [w + rng.choice(["***", "$$$", "&&&"]) for w in words])


def test_rules_and_model(spark, docs_of):
    rng = random.Random(2)
    rows = [(i, make(rng, i % 3 > 0)) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 200)], "doc_id long, quality int, toxic int")
    odd = [(1000, None), (1001, ""), (1002, "a b"), (1003, "a b c " * 100), (None, rows[1][1]), (4, rows[4][1])]
    df = docs_of(rows + odd)
    got = Q.quality_rules(df, labels).collect()
    assert len(got) == len(rows) + len(odd) and "_kept" in got[0].asDict()
    for r in got:
        if r["doc_id"] is not None and 200 <= r["doc_id"] < 300:
            assert r["kept"] == (r["doc_id"] % 3 > 0)  # held-out rows
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["base_failed"] and not by[i]["kept"] for i in (1000, 1001, 1002, 1003)) and by[None]["kept"]


def test_no_labels(spark, docs_of):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    rng = random.Random(2)
    got = Q.quality_rules(docs_of([(1, make(rng, True)), (2, "few")]), empty).collect()
    assert {r["doc_id"]: r["kept"] for r in got} == {1: True, 2: False}
    assert Q.quality_rules(docs_of([(1, "x")]).limit(0), empty).count() == 0


def test_any_column_names_are_kept(spark):
    rows = [(1, "word " * 60, "a", "b", 5, 6, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, _kept string, text__ int, n_words int, c0 int")
    judged = Q.judge(docs, Q.QualityModel(None, 0.0, 1.0, 0.0, 0.25))
    assert judged.columns[:7] == ["doc_id", "text", "__kept", "_kept", "text__", "_n_words", "c0"]
    r = judged.first()
    assert (r["__kept"], r["_kept"], r["text__"], r["_n_words"], r["c0"]) == ("a", "b", 5, 6, 7)
    assert r["n_words"] == 60 and r["kept"] is False  # its three-word windows repeat


def test_a_very_long_text_is_counted_whole(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(200_000)))], "doc_id long, text string")
    r = Q.judge(docs, Q.QualityModel(None, 0.0, 1.0, 0.0, 0.25)).first()
    assert (r["n_words"], r["n_repeat_words"], r["kept"]) == (200_000, 0, True)
