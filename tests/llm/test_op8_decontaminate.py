import math
import random
import re

from aularank.llm import op8_decontaminate as D


def shingles(text):
    words = re.findall("[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return set() if not words else {" ".join(words)} if len(words) <= 5 else {" ".join(words[i: i + 5]) for i in range(len(words) - 4)}


def held(text, item):
    """Shingles of the item that the text holds; an item below five words is a run of its own length."""
    words = re.findall("[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    n = len(next(iter(item)).split()) if len(item) == 1 else 5
    return item & (shingles(text) | {" ".join(words[i: i + n]) for i in range(len(words) - n + 1)})


def key(i):
    return -1 if i is None else i


def test_all_contained_items_are_found(spark, docs_of):
    rng = random.Random(9)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randint(0, 40))
    items = [(j, " ".join(word() for _ in range(rng.choice([3, 5, 6, 9, 20, 60, 200])))) for j in range(60)]
    items += [(100, items[3][1]), (101, None), (102, "")]
    docs = []
    for i in range(120):
        words = [word() for _ in range(rng.choice([0, 5, 50, 3000]))]
        if i % 2:
            own = items[rng.randrange(60)][1].split()
            for _ in range(rng.randint(0, 3)):  # some near copies, some too far
                own[rng.randrange(len(own))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() + "," for w in own]
        docs.append((i, " ".join(words)))
    docs += [(500, None), (501, items[0][1]), (501, items[0][1]), (None, items[5][1])]
    table = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    ids = {}
    for j, x in items:
        if x is not None:
            ids[x] = min(ids.get(x, j), j)
    want = sorted((key(i), ids[x], len(shingles(x)), len(held(t, shingles(x)))) for i, t in docs for x in ids
                  if shingles(x) and len(held(t, shingles(x))) >= math.ceil(0.8 * len(shingles(x)) - 1e-9))
    for p in (D.DecontaminateParams(), D.DecontaminateParams(block_bytes=2000)):
        got = sorted((key(r["doc_id"]), r["item_id"], r["n_shingles"], r["n_found"]) for r in D.contaminated(docs_of(docs), table, p).collect())
        assert got == want and len(want) > 20
    clean = D.decontaminate(docs_of(docs), table)
    assert clean.columns == docs_of(docs).columns
    hit = {r[0] for r in want}
    assert sorted(key(r["doc_id"]) for r in clean.collect()) == sorted(key(i) for i, _ in docs if key(i) not in hit)


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(docs_of([(1, "a b c d e f")]), none).count() == 0
    assert D.decontaminate(docs_of([(1, "a b c d e f")]), none).count() == 1
    assert D.decontaminate(docs_of([(1, "a")]).limit(0), none).count() == 0


def test_short_items_are_found_inside_long_documents(spark, docs_of):
    items = spark.createDataFrame([(1, "Blue whale song"), (2, "whale"), (3, "song of the sea"), (4, "five words in a row")], "item_id long, text string")
    docs = docs_of([(1, "we heard a blue, WHALE song by night"), (2, "blue whale"), (3, "a songof the sea"), (4, "x " * 50_000 + "song of the sea"), (5, "five words in a")])
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(docs, items).collect()}
    assert got == {(1, 1), (1, 2), (2, 2), (4, 3)}
    assert {r["doc_id"] for r in D.decontaminate(docs, items).collect()} == {3, 5}
