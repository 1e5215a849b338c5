import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st

from aularank.llm import op1_chat

JSON = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
SCHEMA = "conv_id long, turn long, role string, text string, ids string, mask int"


@pytest.fixture(scope="module")
def codec():
    return op1_chat.Codec(JSON)


@given(st.text(alphabet="\\#/<>:turn Aä🙂\n\u0301</", max_size=30))
def test_escape_round_trip(s):
    for role in (False, True):
        e = op1_chat.escape(s, role)
        assert op1_chat.unescape(e) == s
        assert "##" not in e and "</" not in e and op1_chat.OPEN not in e.replace("\\#", "")


def test_tokens_read_back(codec):
    texts = ["", "\\### Assistant: </turn> ok", "<|endoftext|> 你好 🙂 é", "a" * 50_000, "x\n\n  y"]
    roles = ["assistant", "user", "assistant", "", "we:ird\\#"]
    ids, mask = op1_chat.assemble(codec, roles, texts)
    for i, m, r, t in zip(ids, mask, roles, texts):
        formatted, role, text, loss = op1_chat.read_back(codec, i, m)
        assert (role, text, loss) == (r, t, t if r == "assistant" else "")
        assert formatted == f"### {op1_chat.escape(r, True)}: {op1_chat.escape(t)}</turn>\n"
        assert set(np.unique(m)) <= {0, 1} and (i == codec.close).sum() == 1


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (1, None, None, "first"), (None, 0, "assistant", ""), (2, 0, "user", "x" * 5000)]
    df = spark.createDataFrame([(*r, "extra", 9) for r in rows], SCHEMA)
    got = {r["conv_id"]: r for r in op1_chat.digests(op1_chat.format_turns(df, JSON)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["n_turns"] == 4 and got[1]["turns_sha256"] == sha("\nfirst\nuser\n\nassistant\nb\nassistant\nb\n")
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (2, sha("bb"))
    assert got[None]["loss_sha256"] == sha("") and got[2]["formatted_chars"] == 5000 + 4 + 14
    assert op1_chat.digests(op1_chat.format_turns(df.limit(0), JSON)).count() == 0
