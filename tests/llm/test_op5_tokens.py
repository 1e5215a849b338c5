import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from aularank.llm import op5_tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
RANKS = op5_tokens.read_ranks(PATH)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab the</s>in\n\t ▁é你🙂\u0301", max_size=80)))
def test_counts_equal_the_library(s):
    assert op5_tokens.Counts(RANKS).tokens(s) == len(LIBRARY.encode(s))


@pytest.mark.parametrize("s", ["", " ", "   ", "a" * 3000, "<s> x </s> <unk> <0x41>", " a  b ", "x\x00y", "thth" * 500, "= " * 200])
def test_odd_texts(s):
    assert op5_tokens.Counts(RANKS).tokens(s) == len(LIBRARY.encode(s))


def test_rows(spark, docs_of):
    rows = [(1, "héé the thing"), (2, None), (3, ""), (4, "the thing " * 5000), (4, "the thing " * 5000), (None, "x")]
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in op5_tokens.token_counts(docs_of(rows), PATH).collect())
    assert got == sorted((i or 0, len((t or "").encode()), len(LIBRARY.encode(t or "")), len(LIBRARY.encode(t or "")) > 4096) for i, t in rows)
    assert op5_tokens.token_counts(docs_of(rows).limit(0), PATH).count() == 0
