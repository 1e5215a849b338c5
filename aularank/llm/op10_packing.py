"""Best-fit packing with conflicts: residual-ordered bins that carry source and duplicate-cluster bitmaps.

Documents are dealt by hash into groups of a bounded size, and each group is packed on its own: longest first, a
binary search finds the fullest bin with room, and the search goes on to its successors until one has neither the
document's source nor its cluster.  A text longer than a bin is cut at multiples of the capacity; only its last
part shares a bin.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aularank.llm.common import cut

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class PackingParams:
    """``capacity``: units of length in a bin; ``group_rows``: documents that one group holds on average."""

    capacity: int = 2048
    group_rows: int = 16384


def _bitmaps(codes: np.ndarray, least: int, bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's (bitmap word or -1, bit), and empty bitmaps; codes below 0 and those of fewer than ``least`` rows have no bit."""
    uniq, inverse, times = np.unique(codes, return_inverse=True, return_counts=True)
    wanted = (times >= least) & (uniq >= 0)
    bit = np.where(wanted, np.cumsum(wanted) - 1, -1)[inverse]
    return np.where(bit >= 0, bit // 64, -1), np.uint64(1) << (np.maximum(bit, 0) % 64).astype(np.uint64), np.zeros((bins, max(1, math.ceil(wanted.sum() / 64))), np.uint64)


def best_fit(length: np.ndarray, source: np.ndarray, cluster: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each row, taken in the given order.  Codes are numbers from 0; -1 conflicts with nothing."""
    n = len(length)
    s_word, s_bit, s_map = _bitmaps(source, 2, n)
    c_word, c_bit, c_map = _bitmaps(cluster, 2, n)
    residual, bins = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)  # open bins, smallest residual first
    used, opened, out = 0, 0, np.zeros(n, np.int64)
    for i in range(n):
        need, sw, cw = length[i], s_word[i], c_word[i]
        at, width, found = int(residual[:used].searchsorted(need)), 16, -1
        while at < used:
            own = bins[at: at + min(width, used - at)]
            clash = np.zeros(len(own), bool)
            if sw >= 0:
                clash |= (s_map[own, sw] & s_bit[i]) != 0
            if cw >= 0:
                clash |= (c_map[own, cw] & c_bit[i]) != 0
            first = int(clash.argmin())
            if not clash[first]:
                found = at + first
                break
            at, width = at + len(own), width * 4
        if found < 0:
            b, left = opened, capacity - need
            opened += 1
        else:
            b, left = int(bins[found]), int(residual[found]) - need
            residual[found: used - 1] = residual[found + 1: used]
            bins[found: used - 1] = bins[found + 1: used]
            used -= 1
        if left > 0:
            at = int(residual[:used].searchsorted(left, side="right"))
            residual[at + 1: used + 1] = residual[at:used].copy()
            bins[at + 1: used + 1] = bins[at:used].copy()
            residual[at], bins[at] = left, b
            used += 1
        if sw >= 0:
            s_map[b, sw] |= s_bit[i]
        if cw >= 0:
            c_map[b, cw] |= c_bit[i]
        out[i] = b
    return out


def pack(docs: DataFrame, length, cluster, params: PackingParams = PackingParams(), doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """(doc_id, piece, start, length, bin): every document's pieces and their bins; no bin over the capacity.

    ``length`` and ``cluster`` are column expressions over ``docs``: the units of a text (null or less than 1
    counts as 1, so empty and null texts take one unit) and its duplicate cluster.  No two rows of a bin share a
    source or a cluster; a null source or cluster conflicts with nothing.  Repeated rows are packed one by one.
    Ties in length go by cluster, doc_id and source.  An empty table gives an empty one; other columns are not read.
    """
    rows = cut(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"),
                           cluster.cast("long").alias("cluster"), F.greatest(F.coalesce(length.cast("long"), F.lit(1)), F.lit(1)).alias("n"),
                           F.monotonically_increasing_id().alias("rid")))
    groups = max(1, math.ceil(rows.count() / params.group_rows))
    rows = rows.withColumn("pack", F.pmod(F.xxhash64("doc_id", "cluster", "source", "rid"), F.lit(groups))).drop("rid")  # equal rows are dealt apart too
    capacity = params.capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).sort_by([("n", "descending"), ("cluster", "ascending"), ("doc_id", "ascending"), ("source", "ascending")])
        if not t.num_rows:
            return
        n = t["n"].to_numpy()
        code = lambda name: t[name].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        full, rest = n // capacity, n % capacity
        shared = np.flatnonzero(rest)
        shared = shared[np.argsort(-rest[shared], kind="stable")]
        bins = best_fit(rest[shared], code("source")[shared], code("cluster")[shared], capacity)
        first = int(bins.max()) + 1 if len(bins) else 0
        whole = np.repeat(np.arange(len(n)), full)  # one bin each
        piece = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        row = np.concatenate([shared, whole])
        part = np.concatenate([full[shared], piece])
        size = np.concatenate([rest[shared], np.full(len(whole), capacity)])
        number = np.concatenate([bins, first + np.arange(len(whole))]) + (int(t["pack"][0].as_py()) << 32)
        yield pa.RecordBatch.from_arrays([t["doc_id"].combine_chunks().take(pa.array(row)), pa.array(part), pa.array(part * capacity), pa.array(size), pa.array(number)],
                                         ["doc_id", "piece", "start", "length", "bin"])

    return rows.groupBy("pack").applyInArrow(lambda t: _one(run, t), "doc_id long, piece long, start long, length long, bin long")


def _one(run, t: pa.Table) -> pa.Table:
    return pa.Table.from_batches(run(iter(t.to_batches())))


def pack_documents(docs: DataFrame, params: PackingParams = PackingParams()) -> DataFrame:
    """Packs ``documents`` rows by their words and one end mark; equal texts are one cluster."""
    length = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)) + 1
    return pack(docs, length, F.xxhash64("text"), params)
