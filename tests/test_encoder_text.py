import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aularank.functions.columns import text_from_bytes, text_sanitise
from aularank.operators import retrieval as rt
from aularank.operators import scores as sc
from aularank.plans import publish as pb


def vectors(df):
    return {r.text: np.array(r.embedding) for r in df.collect()}


def test_a_text_has_one_vector_in_any_table(spark, tmp_path):
    passages = spark.createDataFrame([("red apple",), ("red pear",), ("blue sky",), (None,), ("",)], "text string")
    pb.publish_encoder(spark, rt.fit_encoder(passages, "text", dim=64), str(tmp_path), 1)
    model = pb.load_encoder(spark, str(tmp_path))
    one = spark.createDataFrame([("red apple",)], "text string")
    for m in (model, None):
        among, alone = (vectors(rt.embed(df, "text", rt.PASSAGE_PREFIX, dim=64, model=m)) for df in (passages, one))
        assert (among["red apple"] == alone["red apple"]).all()
        assert all(abs(np.linalg.norm(v) - 1) < 1e-6 for v in among.values())
    # rare words weigh more: the apple is nearer to a text that shares its rare word (buckets enough to keep the words apart)
    asked = spark.createDataFrame([("red apple",), ("red sky",), ("blue apple",)], "text string")
    got = vectors(rt.embed(asked, "text", model=rt.fit_encoder(passages, "text", dim=4096)))
    assert got["red apple"] @ got["blue apple"] > got["red apple"] @ got["red sky"]


def test_newest_encoder_is_loaded_and_a_missing_one_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        pb.load_encoder(spark, str(tmp_path / "none"))
    texts = [spark.createDataFrame([(t,)], "text string") for t in ("a b", "c d")]
    for v, df in enumerate(texts):
        pb.publish_encoder(spark, rt.fit_encoder(df, "text", dim=16), str(tmp_path), v)
    want = vectors(rt.embed(texts[0], "text", model=rt.fit_encoder(texts[1], "text", dim=16)))
    assert (vectors(rt.embed(texts[0], "text", model=pb.load_encoder(spark, str(tmp_path))))["a b"] == want["a b"]).all()


def test_an_empty_table_has_an_encoder_without_weights(spark):
    empty = spark.createDataFrame([], "text string")
    assert rt.embed(empty, "text", model=rt.fit_encoder(empty, "text", dim=8)).count() == 0


def test_bytes_are_read_as_python_does_with_errors_ignored(spark):
    rng = random.Random(7)
    pieces = [b"abc", "ñandú".encode(), "日本".encode(), "😀".encode(), "�".encode(), b"\xed\xa0\x80", b"\xc0\xaf", b"\xf4\x90\x80\x80",
              b"\xe0\x80\x80", b"\xff", b"\x80", b"\xe2\x82", b"\xf0\x9f\x98", b"\n\x00", b"$1\\"]
    rows = [b"".join(rng.choices(pieces, k=rng.randrange(9))) for _ in range(200)]
    rows += [rng.randbytes(rng.randrange(40)) for _ in range(300)] + ["é".encode() * 200_000 + b"\xff" + b"x" * 200_000]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(rows)] + [(-1, None)], "i int, b binary")
    for c in (text_from_bytes(F.col("b")), text_sanitise(F.col("b"))):
        got = {r.i: r.t for r in df.select("i", c.alias("t")).collect()}
        assert got.pop(-1) == ""
        assert got == {i: b.decode("utf-8", "ignore") for i, b in enumerate(rows)}


def test_audience_blocks_find_every_contained_level(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("ABÑ ,", k=rng.randrange(1, 5)))
    auds = [None, "", *("".join(word() for _ in range(rng.randrange(1, 8))) for _ in range(60))]
    levels = sorted({word() for _ in range(80)})
    cat = spark.createDataFrame([(f"c{i}", a) for i, a in enumerate(auds)], "ID_OFERTA_FORMATIVA string, PUBLICO_OBJETIVO string")
    lv = spark.createDataFrame([(x,) for x in levels], "lvl string")
    want = {(f"c{i}", x) for i, a in enumerate(auds) for x in levels if a and x in a}
    for blocks in ((7, 11), (1000, 1000)):
        got = [tuple(r) for r in sc.audience_matches(cat, lv, block_levels=blocks[0], block_texts=blocks[1]).collect()]
        assert set(got) == want and len(got) == len(want)
    assert sc.audience_matches(cat, lv.limit(0)).count() == 0
