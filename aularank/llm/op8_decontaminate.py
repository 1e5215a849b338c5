"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are short and documents long, so the sketch is taken of the item (containment MinHash): its ``k``
smallest shingle hashes.  Items are partitioned by size, and each size class has its own ``k``: with n shingles and
a bound c, a document that holds c of them misses at most n - ceil(c n), so with k one larger it must hold one of
the sketch.  The candidate search therefore loses nothing.  Every candidate is verified on the shingles themselves.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aularank.llm.common import slices, utf8

#: Letters, digits and all bytes outside ASCII are word characters; A-Z are lower-cased; the rest separates.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class DecontaminateParams:
    """``block_bytes``: item text that one broadcast holds at most (and one item more); further items go to further blocks."""

    shingle: int = 5
    containment: float = 0.8
    block_bytes: int = 8 << 20


def shingles(data: bytes, width: int) -> list[bytes]:
    """All word shingles in order; with fewer words the whole sequence, with none nothing."""
    words = data.translate(_FOLD).split()
    if not words:
        return []
    if len(words) <= width:
        return [b" ".join(words)]
    joined = b" ".join(words)
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = starts[width:] + [at]
    return [joined[s:e - 1] for s, e in zip(starts, ends)]


def needed(n: int, containment: float) -> int:
    """Shingles of n that a document must hold."""
    return max(1, math.ceil(containment * n - 1e-9))


class ItemIndex:
    """A block of items: sketch hash -> item numbers; the items' own shingles for the exact check."""

    def __init__(self, items: list[tuple], p: DecontaminateParams):
        self.p, self.items, self.sets = p, [], []
        self.index: dict[int, list[int]] = {}
        sizes: dict[int, int] = {}
        for item_id, text in items:
            own = set(shingles((text or "").encode(), p.shingle))
            if own:
                self.items.append(item_id)
                self.sets.append(own)
                n = len(own)
                part = n.bit_length()
                sizes[part] = max(sizes.get(part, 0), n - needed(n, p.containment) + 1)
        for at, own in enumerate(self.sets):
            k = sizes[len(own).bit_length()]  # the signature length of the size class, enough for each of its items
            for h in sorted(xxhash.xxh64_intdigest(x, 42) for x in own)[:k]:
                self.index.setdefault(h, []).append(at)
        self.keys = self.index.keys()
        #: Lengths of the items that are shorter than a shingle: those are looked up among the text's runs of that length.
        self.short = sorted({n for own in self.sets if len(own) == 1 for x in own if (n := x.count(b" ") + 1) < p.shingle})

    def find(self, data: bytes) -> list[tuple]:
        """(item_id, shingles, found) of all items of which the text holds enough."""
        own = set(shingles(data, self.p.shingle))
        for n in self.short:
            own.update(shingles(data, n))
        digest = xxhash.xxh64_intdigest
        hits = self.keys & {digest(x, 42) for x in own} if own else ()
        out = []
        for at in sorted({a for h in hits for a in self.index[h]}):
            want = self.sets[at]
            found = len(want & own)
            if found >= needed(len(want), self.p.containment):
                out.append((self.items[at], len(want), found))
        return out


_built: dict[str, ItemIndex] = {}


def _index(key: str, items: list[tuple], values: tuple) -> ItemIndex:
    """The block's index, built once in a Python worker; the last one stays."""
    if key not in _built:
        _built.clear()
        _built[key] = ItemIndex(items, DecontaminateParams(*values))
    return _built[key]


def blocks(items: DataFrame, p: DecontaminateParams) -> Iterator[list[tuple]]:
    """Items with different texts, in blocks of about ``block_bytes``; of equal texts the smallest item_id stands for all."""
    own = (items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
           .where("text is not null").groupBy("text").agg(F.min("item_id").alias("item_id")))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(2 * total / p.block_bytes)) if total > p.block_bytes else 1
    placed = own.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(n)))
    for k in range(n if total else 0):
        yield [(r["item_id"], r["text"]) for r in placed.where(F.col("block") == k).orderBy("item_id", "text").collect()]


HITS = "array<struct<item_id:long,n_shingles:long,n_found:long>>"


def with_hits(docs: DataFrame, items: DataFrame, params: DecontaminateParams = DecontaminateParams(), carry: list[str] | None = None, clean_only: bool = False) -> DataFrame:
    """The ``carry`` columns (all by default) of every row and ``hits__``: the items that the text holds.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased; shingles are distinct runs of five
    words; an item of fewer words is one run of its own length, found wherever a text holds it.  Null and empty
    texts and items have no shingles and meet nothing.  Equal items count once under their smallest item_id; rows
    are judged one by one, repeated or not; long texts whole; empty tables give empty results.  Carried columns keep
    their names.  With ``clean_only``, the rows that hold no item, without ``hits__``.
    """
    carry = docs.columns if carry is None else carry
    fields = [T.StructField(n, docs.schema[n].dataType) for n in carry]
    inner = [f"c{i}" for i in range(len(carry))]
    hits_type = T._parse_datatype_string(HITS)
    out = docs.select(*[F.col(f"`{n}`").alias(i) for n, i in zip(carry, inner)], F.col("text").cast("string").alias("text__"))
    struct = pa.list_(pa.struct([("item_id", pa.int64()), ("n_shingles", pa.int64()), ("n_found", pa.int64())]))
    schema = T.StructType([T.StructField(i, f.dataType) for i, f in zip(inner, fields)] + [T.StructField("text__", T.StringType()), T.StructField("hits__", hits_type)])
    out = out.withColumn("hits__", F.array().cast(hits_type))
    values = (params.shingle, params.containment, params.block_bytes)
    for block in blocks(items, params):
        cell = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], cell=cell, key=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            index = None
            for part in slices(batches, "text__"):
                index = index or _index(key, cell.value, values)
                found = [[dict(zip(("item_id", "n_shingles", "n_found"), x)) for x in index.find(data)] for data in utf8(part, "text__")]
                before = part.column(part.num_columns - 1).to_pylist()
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([(a or []) + b for a, b in zip(before, found)], struct)], part.schema.names)

        out = out.mapInArrow(run, schema)
    kept = [F.col(i).alias(n) for n, i in zip(carry, inner)]
    if clean_only:
        return out.where("size(hits__) = 0").select(*kept)
    return out.select(*kept, F.col("hits__"))


def contaminated(docs: DataFrame, items: DataFrame, params: DecontaminateParams = DecontaminateParams()) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment): one row for each document row and item that it holds."""
    rows = with_hits(docs, items, params, carry=["doc_id"]).where("size(hits__) > 0").select("doc_id", F.explode("hits__").alias("x"))
    return rows.select("doc_id", "x.item_id", "x.n_shingles", "x.n_found", (F.col("x.n_found") / F.col("x.n_shingles")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, params: DecontaminateParams = DecontaminateParams()) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    return with_hits(docs, items, params, clean_only=True)
