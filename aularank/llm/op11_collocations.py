"""Phrase collocation mining over depth-truncated suffix subtrees, partitioned vertically by word prefixes.

Every word begins a suffix (the words up to the end of its piece, at most ``longest``).  Suffixes are cut where a word, pair or
triple is too rare to stand in any candidate (hashed counts of all texts, which only ever err towards keeping), counted within a slice
of text, and filed under hashed prefixes.  Prefixes are counted, those beyond a memory budget are made longer by a word, and
the rest are packed into groups of about that budget.  Each group builds its own subtree from its sorted suffixes,
keeping only the path to the newest leaf; a node's count is the total of its leaves.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aularank.functions.ranking import segment_positions
from aularank.llm.common import cut, slices, use_checkpoint_dir

#: Words, pairs and triples are counted under 32 bits of their hash: 10 name a bucket, 22 a counter in it.  What reaches the
#: other tasks is a bit for every 32 counters: 2**27 bits, 16 MB, whatever the input.
BUCKETS = 1 << 10
COUNTERS = 1 << 22
BITS = 1 << 17
#: Text bytes counted together before rows leave a task.
COUNT_BYTES = 8 << 20
UNKNOWN = "und"
_BREAK = b"."
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + _BREAK * 9)


@dataclass(frozen=True)
class CollocationParams:
    """``budget_rows``: suffix rows that a group holds about; it grows so that there are at most some ``most_groups`` groups."""

    longest: int = 4
    least: int = 30
    scale: int = 2_000_000
    inside_percent: int = 80
    top: int = 2000
    budget_rows: int = 50_000
    most_groups: int = 8192


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = got = len(self)
        return got


def words_of(texts: list[bytes], lang: str) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(numbers of the words of all texts, 0 between pieces; the words by number; their hashes)."""
    ids = _Ids({_BREAK: 0})
    tokens = b".".join(texts).translate(_FOLD).replace(_BREAK, b" . ").split()
    x = np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens))
    seed = zlib.crc32(lang.encode("utf-8", "replace"))
    return x, list(ids), np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in ids), np.uint64, len(ids))


def word_keys(h: np.ndarray) -> np.ndarray:
    """32 bits of each word's hash."""
    return h & np.uint64(0xFFFFFFFF)


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))
        return (mixed * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(32)


def triple_keys(pair: np.ndarray, h: np.ndarray) -> np.ndarray:
    """32 bits of three words, of the first two's key and the third's hash."""
    return pair_keys(pair + np.uint64(0x27D4EB2F165667C5), h)


def by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(lang, whole texts) of slices of Arrow batches (lang, text)."""
    for part in slices(batches, "text", COUNT_BYTES):
        held: dict[str, list[bytes]] = {}
        for lang, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
            held.setdefault(lang, []).append(text)
        yield from held.items()


def often(docs: DataFrame, least: int) -> np.ndarray:
    """Bits that tell of a key whether the words, pairs and triples that share its bit may occur ``least`` times."""
    most = min(least, 255)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in by_lang(batches):
            x, _, h = words_of(texts, lang)
            both = np.flatnonzero((x[:-1] > 0) & (x[1:] > 0))
            found = [(word_keys(h[1:]), np.bincount(x, minlength=len(h))[1:])]
            pair = pair_keys(h[x[both]], h[x[both + 1]])
            found.append(np.unique(pair, return_counts=True))
            next_ = np.flatnonzero(np.diff(both) == 1)  # pairs that go on by a word
            found.append(np.unique(triple_keys(pair[next_], h[x[both[next_] + 2]]), return_counts=True))
            keys, n = (np.concatenate(c) for c in zip(*found))
            order = np.argsort(keys)
            new = np.flatnonzero(np.diff(keys[order], prepend=~keys[order[:1]]))  # a word and a pair may share one
            keys, n = keys[order][new], np.minimum(np.add.reduceat(n[order], new) if len(new) else n, most).astype(np.uint8)
            ends = np.searchsorted(keys, np.arange(1, BUCKETS + 1, dtype=np.uint64) * np.uint64(COUNTERS))
            own = (keys & np.uint64(COUNTERS - 1)).astype(np.int32)
            out = []
            for k, (start, end) in enumerate(zip([0, *ends[:-1]], ends)):
                if start < end:  # steps between sorted counters and how often: small numbers
                    out.append((k, int(end - start), pa.compress(np.diff(own[start:end], prepend=np.int32(0)).tobytes() + n[start:end].tobytes(), codec="zstd", asbytes=True)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary()))], ["bucket", "n", "body"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, np.zeros(COUNTERS, np.uint8)

        def bits() -> pa.RecordBatch:
            reached = (held >= most).reshape(-1, BITS).any(0)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(reached).tobytes()], pa.binary())], ["bucket", "bits"])

        for batch in batches:
            for bucket, n, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if bucket != at:
                    if at is not None:
                        yield bits()
                    at, held = bucket, np.zeros(COUNTERS, np.uint8)
                plain = pa.decompress(body.as_buffer(), 5 * n, codec="zstd")
                slots, times = np.cumsum(np.frombuffer(plain, np.int32, n)), np.frombuffer(plain, np.uint8, n, 4 * n)
                held[slots] = np.minimum(most, held[slots] + times.astype(np.int32))
        if at is not None:
            yield bits()

    sums = (docs.mapInArrow(count, "bucket int, n int, body binary").repartition("bucket").sortWithinPartitions("bucket")
            .mapInArrow(total, "bucket int, bits binary"))
    out = np.zeros((BUCKETS, BITS // 8), np.uint8)
    for r in sums.collect():  # BUCKETS rows of BITS bits, whatever the input
        out[r["bucket"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def _bits(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit of each key is set."""
    k = keys.astype(np.int64)
    at = k // COUNTERS * BITS + k % BITS
    return (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def suffix_counts(texts: list[bytes], lang: str, table: np.ndarray, longest: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """(suffixes, every word followed by a blank; their counts; hashes of their first three words, 0 where there is none).

    Each word occurrence is in exactly one count: that of its suffix, cut before what ``table`` tells to be rare.
    """
    x, words, h = words_of(texts, lang)
    known = _bits(table, word_keys(h))
    known[0] = False
    small = np.cumsum(known) * known  # numbers of the words that stay
    x = np.concatenate([x, np.zeros(longest, np.int64)])
    ok = known[x]
    pair = np.zeros(len(x), bool)
    at = np.flatnonzero(ok[:-1] & ok[1:])
    keys = pair_keys(h[x[at]], h[x[at + 1]])
    fits = _bits(table, keys)
    at, keys = at[fits], keys[fits]
    pair[at] = True
    triple = np.zeros(len(x), bool)
    two = np.flatnonzero(np.diff(at) == 1)
    triple[at[two]] = _bits(table, triple_keys(keys[two], h[x[at[two] + 2]]))
    depth = ok.astype(np.int64) + pair
    run = pair.copy()
    for k in range(longest - 2):  # one word more needs the triple that it ends
        run[: len(x) - k] &= triple[k:]
        run[len(x) - k :] = False
        depth += run
    size = int(known.sum()) + 1
    nothing = int(((x > 0) & (depth == 0)).sum())
    if nothing:
        yield [b""], np.array([nothing]), np.zeros((1, 3), np.int64)
    for d in range(1, longest + 1):
        p = np.flatnonzero(depth == d)
        if not len(p):
            continue
        code, room = small[x[p]], size
        for k in range(1, d):
            if room * size >= 1 << 62:  # numbers of the distinct beginnings in place of the beginnings
                code = np.unique(code, return_inverse=True)[1].astype(np.int64)
                room = len(p)
            code, room = code * size + small[x[p + k]], room * size
        _, where, n = np.unique(code, return_index=True, return_counts=True)
        p = p[where]
        own = [x[p + k] for k in range(d)]
        hashes = np.zeros((len(p), 3), np.int64)
        for k in range(min(3, d)):
            hashes[:, k] = (h[own[k]] >> np.uint64(48)).astype(np.int64) if k == 0 else 1 + (h[own[k]] >> np.uint64(56)).astype(np.int64)
        yield [b"".join([words[i] + b" " for i in row]) for row in np.stack(own, 1).tolist()], n, hashes


def suffixes(docs: DataFrame, table: np.ndarray, longest: int) -> DataFrame:
    """(lang, suffix, n, h1, h2, h3), written to the shared folder."""
    spark = docs.sparkSession
    cell = spark.sparkContext.broadcast(table)  # 16 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in by_lang(batches):
            for suffix, n, h in suffix_counts(texts, lang, cell.value, longest):
                columns = [pa.array([lang] * len(suffix), pa.string()), pa.array(suffix, pa.binary()), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(h[:, k], pa.int32()) for k in range(3)], ["lang", "suffix", "n", "h1", "h2", "h3"])

    path = f"{use_checkpoint_dir(spark)}/suffixes-{uuid.uuid4().hex}"
    docs.mapInArrow(run, "lang string, suffix binary, n long, h1 int, h2 int, h3 int").write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def grouped(rows: DataFrame, p: CollocationParams) -> DataFrame:
    """``rows`` with ``group`` and ``deep`` (hashed words of the group's prefix).

    Prefixes are counted; one beyond the budget is extended by the next word, three words at most; neighbouring light
    prefixes share a group.  At most 65,536 first slots, and 257 more for each of fewer than ``most_groups`` heavy ones, reach the driver.
    """
    spark = rows.sparkSession
    keys, group, heavy, tables = ["h1", "h2", "h3"], 0, None, []
    budget = 0
    for level in range(1, 4):
        own = keys[:level]
        code = F.lit(0) if level == 1 else sum(F.col(k).cast("long") * (1 << 20 * i) for i, k in enumerate(own[:-1]))
        part = rows if heavy is None else rows.where(code.isin(heavy))  # fewer than most_groups prefixes
        counts = part.groupBy(*own).agg(F.count("*").alias("rows")).toArrow().sort_by([(k, "ascending") for k in own]).to_pylist()
        budget = budget or max(p.budget_rows, sum(r["rows"] for r in counts) // p.most_groups)
        filled, out, over = 0, [], []
        for r in counts:
            key = tuple(r[k] for k in own)
            if r["rows"] > budget and level < 3:
                over.append(key)
                continue
            if filled and filled + r["rows"] > budget:
                group, filled = group + 1, 0
            out.append((*key, group))
            filled += r["rows"]
        group += 1
        tables.append(spark.createDataFrame(pa.table({n: pa.array([x[k] for x in out], pa.int32()) for k, n in enumerate([*own, f"g{level}"])})))
        if not over:
            break
        heavy = [sum(x << 20 * i for i, x in enumerate(key)) for key in over]
    for level, t in enumerate(tables, 1):
        rows = rows.join(F.broadcast(t), keys[:level], "left")  # bounded as above
    found = [F.col(f"g{k}") for k in range(1, len(tables) + 1)]
    deep = F.coalesce(*[F.when(F.col(f"g{k}").isNotNull(), F.lit(k)) for k in range(1, len(tables) + 1)])
    return rows.select("lang", "suffix", "n", F.coalesce(*found).alias("group"), deep.alias("deep"))


def subtree(rows: Iterator[tuple[int, int, str, bytes, int]], least: int) -> Iterator[tuple[str, int, bytes, int]]:
    """(lang, words, phrase, count) of the nodes of the subtrees of sorted (group, deep, lang, suffix, n) rows.

    A node at least as deep as its group's prefix is complete, so it leaves only if it is frequent; one above is a part, and leaves as it is.
    """
    path: list[list] = []  # [word, total] from the root's child to the newest leaf
    own: tuple = ()

    def close(depth: int) -> Iterator[tuple[str, int, bytes, int]]:
        while len(path) > depth:
            n = path[-1][1]
            if n >= least or len(path) < own[1]:
                yield own[2], len(path), b" ".join([x[0] for x in path]), n
            path.pop()
            if path:
                path[-1][1] += n

    for group, deep, lang, suffix, n in rows:
        if own != (group, deep, lang):
            if own:
                yield from close(0)
            own = (group, deep, lang)
        words = suffix.split(b" ")[:-1]
        same = 0
        while same < len(path) and same < len(words) and path[same][0] == words[same]:
            same += 1
        if same < len(path):
            yield from close(same)
        path.extend([w, 0] for w in words[same:])
        if path:
            path[-1][1] += n
    if own:
        yield from close(0)


def frequent(rows: DataFrame, p: CollocationParams) -> DataFrame:
    """(lang, words, phrase, f) of all phrases of up to ``longest`` words that occur ``least`` times."""
    least = p.least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sorted_rows = (row for b in batches for row in zip(*(b.column(k).to_pylist() for k in range(5))))
        held: list = []
        for node in subtree(sorted_rows, least):
            held.append(node)
            if len(held) == 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    names, kinds = ["lang", "words", "phrase", "f"], [pa.string(), pa.int32(), pa.binary(), pa.int64()]
    order = ["group", "deep", "lang", "suffix"]
    nodes = (grouped(rows, p).select(*order, "n").repartition("group").sortWithinPartitions(*order)
             .mapInArrow(run, "lang string, words int, phrase binary, f long"))
    total = nodes.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return cut(total.withColumn("phrase", F.col("phrase").cast("string")))


SCHEMA = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"


def collocations(docs: DataFrame, params: CollocationParams = CollocationParams()) -> DataFrame:
    """The ``SCHEMA`` columns: each lang's first ``top`` candidate phrases by score, count (falling) and phrase.

    A null lang is ``und`` (together with rows that say so), a null or empty text has no words; very long texts are counted
    whole, repeated rows count as often as they stand; equal scores and counts are told apart by the phrase's UTF-8
    bytes; further columns are not read; an empty table gives an empty one.
    """
    p = params
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = suffixes(docs, often(docs, p.least), p.longest)
    f = frequent(rows, p)
    wide = F.col("a").cast("decimal(20,0)")
    cuts = (f.where("words > 1").withColumnRenamed("f", "a").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
            .withColumn("left", F.expr("substring_index(phrase, ' ', k)"))
            .withColumn("right", F.expr("substring_index(phrase, ' ', k - words)")))
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    # whole numbers of up to 38 digits: no rounding, no overflow
    score = F.expr(f"(cast({p.scale} as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    parts = f.where("words > 2").select("lang", F.split("phrase", " ").alias("v"), "words", "f").withColumn("z", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    parts = parts.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("z") + 1)))
    inside = parts.groupBy("lang", F.array_join(F.slice("v", F.col("i"), F.col("z")), " ").alias("phrase")).agg(F.max("f").alias("most"))
    held = (F.col("most").cast("decimal(20,0)") * 100) >= (wide * p.inside_percent)
    kept = best.join(inside, ["lang", "phrase"], "left").where(~F.coalesce(held, F.lit(False)))
    kept = kept.select("lang", "phrase", "a", F.col("low.l").alias("l"), F.col("low.r").alias("r"), F.col("low.score").alias("score"))
    ranked = segment_positions(kept, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], "rank").where(F.col("rank") <= p.top)
    total = rows.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
