"""Chat formatting at token level: segments encoded apart, reserved ids spliced in, masks from prefix sums.

A turn reads ``### Role: text</turn>\\n``.  ``### ``, ``: `` and ``</turn>\\n`` are single reserved ids past the
vocabulary, so no text can produce them; in the readable form they cannot occur in a text either, because control
characters inside roles and texts are escaped by a backslash, reversibly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aularank.llm.common import slices

OPEN, NAMED, CLOSE = "### ", ": ", "</turn>\n"
LOSS_ROLE = "assistant"

_ESCAPE = re.compile(r"[\\#]|(?<=<)/")
_ESCAPE_ROLE = re.compile(r"[\\#:]|(?<=<)/")
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str, role: bool = False) -> str:
    """A backslash before each ``\\``, ``#``, the ``/`` of ``</`` and, in a role, ``:``; no control string remains."""
    return (_ESCAPE_ROLE if role else _ESCAPE).sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


class Codec:
    """A byte-level BPE tokenizer with three reserved ids after its vocabulary."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        n = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.open, self.named, self.close = n, n + 1, n + 2

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def decode(self, ids: list[int]) -> str:
        """Readable form of a token list, reserved ids included."""
        out, held = [], []
        marks = {self.open: OPEN, self.named: NAMED, self.close: CLOSE}
        for i in [*ids, None]:
            if i is None or i in marks:
                if held:
                    out.append(self.tokenizer.decode(held, skip_special_tokens=False))
                    held = []
                out.append(marks.get(i, ""))
            else:
                held.append(i)
        return "".join(out)


def assemble(codec: Codec, roles: list[str], texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Token ids and loss mask of each turn.

    The batch's segments stand in one flat array; their starts are prefix sums of their lengths, and the mask is
    the prefix sum of +1 where a trained text begins and -1 where it ends.
    """
    n = len(roles)
    head = codec.encode([escape(r, role=True) for r in roles])
    body = codec.encode([escape(t) for t in texts])
    sizes = np.array([[1, len(h), 1, len(b), 1] for h, b in zip(head, body)], np.int64).reshape(n, 5)
    ends = np.cumsum(sizes.ravel()).reshape(n, 5)
    starts = ends - sizes
    total = int(ends[-1, -1]) if n else 0
    flat, step = np.zeros(total, np.int32), np.zeros(total + 1, np.int8)
    flat[starts[:, 0]], flat[starts[:, 2]], flat[starts[:, 4]] = codec.open, codec.named, codec.close
    for i in range(n):
        flat[starts[i, 1]: ends[i, 1]] = head[i]
        flat[starts[i, 3]: ends[i, 3]] = body[i]
    trained = np.flatnonzero([r == LOSS_ROLE for r in roles])
    np.add.at(step, starts[trained, 3], 1)
    np.add.at(step, ends[trained, 3], -1)
    mask = np.cumsum(step[:-1]).astype(np.int8)
    cuts = ends[:-1, 4] if n else []
    return np.split(flat, cuts), np.split(mask, cuts)


def read_back(codec: Codec, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str, str]:
    """Formatted text, role, text and trained text, all from the tokens."""
    tokens = ids.tolist()
    named = tokens.index(codec.named)
    role = unescape(codec.decode(tokens[1:named]))
    text = unescape(codec.decode(tokens[named + 1: -1]))
    return codec.decode(tokens), role, text, unescape(codec.decode(ids[mask > 0].tolist()))


TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
                      T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("mask", T.ArrayType(T.ByteType())), T.StructField("formatted", T.StringType()), T.StructField("loss", T.StringType())])


def format_turns(turns: DataFrame, tokenizer_json: str) -> DataFrame:
    """(conv_id, turn, role, text, ids, mask, formatted, loss): one row a turn; all but ids and mask are read back
    from them.  Null roles and texts are empty; repeated rows stay; other columns are not read; an empty table gives
    an empty one.  Turns are encoded wherever they lie, before any grouping."""
    cell = turns.sparkSession.sparkContext.broadcast(tokenizer_json)  # the tokenizer's file: its size is not the data's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for part in slices(batches, "text"):
            codec = codec or Codec(cell.value)
            ids, mask = assemble(codec, [x or "" for x in part.column(2).to_pylist()], [x or "" for x in part.column(3).to_pylist()])
            back = [read_back(codec, i, m) for i, m in zip(ids, mask)]
            own = [pa.array([b[k] for b in back], pa.string()) for k in range(4)]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(i) for i in ids])]), pa.int32())
            tokens = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids) if ids else [], pa.int32()))
            trained = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(mask) if mask else [], pa.int8()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), own[1], own[2], tokens, trained, own[0], own[3]], TURNS.names)

    source = turns.select(*[F.col(n).cast(k).alias(n) for n, k in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))])
    return source.mapInArrow(run, TURNS)


def digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, n_loss_tokens) by conversation.

    Rows go by turn (null first), ties by role and text.  A conversation's digest is a running hash, so its turns
    pass through one task in order, as a stream: a conversation of any length needs the memory of one batch.
    """
    rows = formatted.select("conv_id", "turn", "role", "text", "loss", F.length("formatted").alias("chars"), F.size("ids").alias("n"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("trained"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "n_loss_tokens"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_ = None, False

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        def closed() -> tuple:
            return now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), *now[5:]

        for batch in batches:
            done = []
            for conv, _, role, text, loss, chars, n, trained in zip(*(c.to_pylist() for c in batch.columns)):
                if not open_ or now[0] != conv:
                    if open_:
                        done.append(closed())
                    now, open_ = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0], True
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                now[3] += len(loss)
                now[4].update(loss.encode())
                now[5] += chars
                now[6] += n
                now[7] += trained
            if done:
                yield out(done)
        if open_:
            yield out([closed()])

    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long")
