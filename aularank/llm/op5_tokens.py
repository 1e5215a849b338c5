"""Token counts by heap-and-linked-list byte-pair merging, without emitting identifiers.

The text's symbols form a linked list; a heap yields the adjacent pair of the lowest rank, the leftmost of equal
ones; each merge takes one symbol away, so the count is the initial symbols minus the merges.  No piece of the
vocabulary holds a space mark after another character (checked when it is read), so merges never cross such a
place, and a text is counted in stretches whose counts are remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aularank.llm.common import slices

SPACE = "▁"
STRETCH = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
REMEMBERED = 400_000


def read_ranks(path: str) -> dict[str, float]:
    """Piece to rank (lower merges first) of a sentencepiece BPE model with byte fallback and no unused pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    if any(sp.is_unused(i) for i in ids):
        raise ValueError("unused pieces are not supported")
    ranks = {sp.id_to_piece(i): -sp.get_score(i) for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    if any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece in ranks):
        raise ValueError("a piece holds a space mark after another character")
    return ranks


def count_merged(text: str, ranks: dict[str, float]) -> int:
    """Tokens of one stretch."""
    symbols: list[str] = list(text)
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        both = symbols[i] + symbols[i + 1]
        rank = ranks.get(both)
        if rank is not None:
            heap.append((rank, i, i + 1, both))
    heapify(heap)
    merges = 0
    while heap:
        _, i, j, both = heappop(heap)
        if after[i] != j or symbols[i] + symbols[j] != both:  # one side has changed since
            continue
        symbols[i], symbols[j] = both, ""
        merges += 1
        k = after[i] = after[j]
        after[j] = -1
        if k < n:
            before[k] = i
            new = both + symbols[k]
            rank = ranks.get(new)
            if rank is not None:
                heappush(heap, (rank, i, k, new))
        h = before[i]
        if h >= 0:
            new = symbols[h] + both
            rank = ranks.get(new)
            if rank is not None:
                heappush(heap, (rank, h, i, new))
    # a character that stayed alone and is no piece becomes a token for each of its bytes
    return n - merges + sum(len(s.encode()) - 1 for s in symbols if len(s) == 1 and s not in ranks)


class Counts(dict):
    """Stretch to its tokens; emptied when it holds REMEMBERED stretches.  Long stretches are not kept."""

    def __init__(self, ranks: dict[str, float]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, stretch: str) -> int:
        n = count_merged(stretch, self.ranks)
        if len(stretch) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[stretch] = n
        return n

    def tokens(self, text: str) -> int:
        """Tokens of a whole text, with the space mark that the model puts before it; an empty text has none."""
        return sum(map(self.__getitem__, STRETCH.findall(SPACE + text.replace(" ", SPACE)))) if text else 0


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row.

    The vocabulary is read once on the driver and broadcast (its size is the model's, not the data's).  A null text
    counts as empty: no bytes, no tokens.  Repeated rows are counted one by one, long texts whole; other columns are
    not read; an empty table gives an empty one.
    """
    cell = docs.sparkSession.sparkContext.broadcast(read_ranks(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(cell.value)
        for part in slices(batches, "text"):
            texts = [x or "" for x in part.column(1).to_pylist()]
            n = [counts.tokens(x) for x in texts]
            size = pa.compute.fill_null(pa.compute.binary_length(part.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
