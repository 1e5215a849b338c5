"""SimHash near-duplicates by the general pigeonhole principle (Qin et al., "GPH", 2018).

Fingerprints are made whole text by whole text, then collapsed to distinct values, so copies cost one row.
Correlated bits are grouped into partitions; a dynamic program gives each partition a threshold of its own from
the counts of all distinct fingerprints; masked partition values are the probe keys; every candidate is verified
by its full bit distance inside the task that holds the key, and only a spanning forest of the links leaves it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aularank.llm.common import cut, row_hash, slices, utf8
from aularank.llm.components import components

BITS = 64
#: Distinct fingerprints that share a key and are compared in one block; a larger group is split into block pairs.
BLOCK = 8192


def fingerprint(data: bytes, shingle: int = 4, seed: int = 42) -> int:
    """A bit is 1 if set in over half of the XXH64 of all word shingles (repeats counted); no words: 0."""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[shingle - 1:] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(joined[s:e], seed) for s, e in zip(starts[:n].tolist(), last.tolist())], np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(h[at: at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints_with(source: DataFrame, carry: list[str], shingle: int) -> DataFrame:
    """(doc_id, carry..., fp) for every row of ``source`` (doc_id, text, carry...); the carried columns are longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            fp = np.array([fingerprint(x, shingle) for x in utf8(part, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array(fp, pa.int64())], ["doc_id", *carry, "fp"])

    return source.select("doc_id", "text", *carry).mapInArrow(run, ", ".join(f"{n} long" for n in ("doc_id", *carry, "fp")))


def fingerprints(docs: DataFrame, shingle: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): a signed 64-bit fingerprint for every row."""
    return fingerprints_with(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")), [], shingle)


def bit_pairs(distinct: DataFrame) -> np.ndarray:
    """How many fingerprints have bits i and j set, over all of them (64 x 64)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            x = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint8).reshape(-1, 8)
            for at in range(0, len(x), 1 << 14):
                bits = np.unpackbits(x[at: at + (1 << 14)], axis=1, bitorder="little").astype(np.float32)
                total += (bits.T @ bits).astype(np.int64)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "n"])

    rows = distinct.select("fp").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()  # 4,096 at most
    out = np.zeros((BITS, BITS), np.int64)
    for r in rows:
        out[r["i"], r["j"]] = r["n"]
    return out


def group_bits(pairs: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of near equal width, each grown by the bit that correlates most with the group."""
    p = np.diag(pairs) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((pairs / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    left, groups = list(range(BITS)), []
    for k in range(parts):
        width = len(left) // (parts - k)
        group = [max(left, key=lambda b: (p[b] * (1 - p[b]), -b))]
        left.remove(group[0])
        while len(group) < width:
            best = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def gather(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The named bits of each fingerprint, packed."""
    out = np.zeros(len(fp), np.uint64)
    for k, b in enumerate(bits):
        out |= (fp >> np.uint64(b) & np.uint64(1)) << np.uint64(k)
    return out


def _collisions(distinct: DataFrame, plans: dict[int, list[list[int]]]) -> dict[tuple[int, int], int]:
    """Pairs of fingerprints that agree on a partition, for every partition of every plan, over all of them."""
    todo = [(m, i, bits) for m, groups in plans.items() for i, bits in enumerate(groups)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint64)
            for at, (m, i, bits) in enumerate(todo):
                value, times = np.unique(gather(fp, bits), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), at, np.int32)), pa.array(value.view(np.int64)), pa.array(times.astype(np.int64))], ["at", "value", "n"])

    rows = (distinct.select("fp").mapInArrow(run, "at int, value long, n long").groupBy("at", "value").agg(F.sum("n").alias("n"))
            .groupBy("at").agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2).alias("pairs")).collect())  # a row for each partition
    found = {r["at"]: r["pairs"] for r in rows}
    return {(m, i): found.get(at, 0.0) for at, (m, i, _) in enumerate(todo)}


def allocate(groups: list[list[int]], same: list[float], p: np.ndarray, n: int, distance: int) -> tuple[float, list[int]]:
    """Thresholds (-1 or more) that sum to distance - parts + 1, cheapest by a dynamic program.

    The cost of threshold t in a partition: the candidates (pairs that agree there, from counts, times the ratio
    of pairs within t to pairs at 0 under independent bits) and the keys that each fingerprint sends.
    """
    def cost(g: list[int], agree: float, t: int) -> float:
        if t < 0:
            return 0.0
        differ = [1.0] + [0.0] * t
        for b in g:
            d = 2 * p[b] * (1 - p[b])
            differ = [differ[k] * (1 - d) + (differ[k - 1] * d if k else 0.0) for k in range(t + 1)]
        within = sum(differ) / max(differ[0], 1e-300)
        return agree * within * math.comb(len(g), t) ** 0.5 + 40.0 * n * math.comb(len(g), t)

    total = distance + 1  # the sum of t + 1
    best: list[tuple[float, list[int]]] = [(0.0, [])] + [(math.inf, [])] * total
    for g, agree in zip(groups, same):
        new = []
        for s in range(total + 1):
            new.append(min(((best[s - t - 1][0] + cost(g, agree, t), best[s - t - 1][1] + [t]) for t in range(-1, min(s, len(g) + 1))), key=lambda x: x[0]))
        best = new
    return best[total]


def masks(groups: list[list[int]], thresholds: list[int]) -> list[int]:
    """One 64-bit mask for each probe key: a partition's bits without ``t`` of them.  Two fingerprints within t bits
    of one another in the partition agree under at least one of its masks."""
    out = []
    for g, t in zip(groups, thresholds):
        if t >= 0:
            whole = sum(1 << b for b in g)
            out += [whole & ~sum(1 << b for b in drop) for drop in combinations(g, min(t, len(g)))]
    return out


def _forest(key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, local root) for all links between neighbours under equal keys; rows sorted by key, then side.

    Row i is compared with row i + d for every d within its group.  Links inside a component already known are
    dropped as they are found, so memory follows the rows, not the pairs.
    """
    n = len(fp)
    uniq, node = np.unique(fp, return_inverse=True)
    root = np.arange(len(uniq))
    same_until = np.searchsorted(key, key, side="right") if n else np.zeros(0, np.int64)
    at, d = np.arange(n), 1
    while True:
        at = at[at + d < same_until[at]]
        if not len(at):
            break
        near = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= distance]
        u, v = node[near], node[near + d]
        while True:
            a, b = root[u], root[v]
            open_ = a != b
            if not open_.any():
                break
            u, v, a, b = u[open_], v[open_], a[open_], b[open_]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
        d += 1
    moved = np.flatnonzero(root != np.arange(len(uniq)))
    return uniq[moved], uniq[root[moved]]


def links(distinct: DataFrame, distance: int = 4, block: int = BLOCK) -> DataFrame:
    """(a, b) fingerprint links whose components are those of all pairs within ``distance`` bits.

    Keys that more than ``block`` distinct fingerprints share are found by counting and split into pairs of blocks,
    so no task gets an unbounded group and no pair is lost.
    """
    n = distinct.count()
    pairs = bit_pairs(distinct)
    plans = {m: group_bits(pairs, n, m) for m in range(max(1, distance - 1), distance + 2)}
    same = _collisions(distinct, plans)
    p = np.diag(pairs) / max(n, 1)
    chosen = min(((*allocate(g, [same[m, i] for i in range(m)], p, n, distance), m) for m, g in plans.items()), key=lambda x: (x[0], x[2]))
    probe = np.array(masks(plans[chosen[2]], chosen[1]), np.uint64)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint64)
            for at in range(0, len(fp), 1 << 14):
                own = fp[at: at + (1 << 14)]
                value = (own[:, None] & probe[None, :]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(len(probe), dtype=np.int32), len(own))), pa.array(value.ravel()), pa.array(np.repeat(own, len(probe)).view(np.int64))], ["mask", "value", "fp"])

    keyed = distinct.select("fp").mapInArrow(keys, "mask int, value long, fp long")
    hot = cut(keyed.groupBy("mask", "value").agg(F.count("*").alias("n")).where(F.col("n") > block)
              .select("mask", "value", F.ceil(F.col("n") / (block // 2)).cast("int").alias("blocks")))
    # A hot key's block pairs (x, y), x <= y: every fingerprint goes to the pairs that hold its own block.
    if hot.limit(1).count():
        joined = keyed.join(hot, ["mask", "value"], "left")
        own = F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))).cast("int")
        other = F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)
        keyed = (joined.withColumn("own", own).select("mask", "value", "fp", "own", F.explode(other).alias("other"))
                 .select("mask", "value", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fp"))
    else:
        keyed = keyed.select("mask", "value", F.lit(0).alias("x"), F.lit(0).alias("y"), "fp")
    rows = keyed.select(F.xxhash64("mask", "value", "x", "y").alias("key"), "mask", "value", "x", "y", "fp")
    parts = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n * len(probe) / 2_000_000))
    rows = rows.select("key", "fp").repartition(parts, "key").sortWithinPartitions("key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            a, b = _forest(k, f, distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            k = np.concatenate([held_k, batch.column(0).to_numpy(zero_copy_only=False)])
            f = np.concatenate([held_f, np.ascontiguousarray(batch.column(1).to_numpy(zero_copy_only=False)).view(np.uint64)])
            done = int(np.searchsorted(k, k[-1], side="left")) if len(k) else 0  # the last key may go on
            if done:
                yield out(k[:done], f[:done])
            held_k, held_f = k[done:], f[done:]
        if len(held_k):
            yield out(held_k, held_f)

    return rows.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row.

    component_id is the smallest doc_id of all rows reachable over links of ``distance`` bits or fewer, the row's
    own included.  Null and empty texts have fingerprint zero and link like any other; rows with a null doc_id are
    placed like others, and component_id is null only where the whole component has no id; repeated rows and
    repeated ids stay as rows; other columns are not read; an empty table gives an empty one.
    """
    rows = cut(fingerprints(docs, shingle, doc_id, text))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    tree = components(links(distinct, distance))
    placed = distinct.join(tree.select(F.col("u").alias("fp"), "m"), "fp", "left").withColumn("m", F.coalesce("m", "fp"))
    least = placed.groupBy("m").agg(F.min("first").alias("component_id"))
    known = placed.join(least, "m").select("fp", "component_id")
    return rows.join(known, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, distance: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with the columns of ``docs``.

    The row stays that has the smallest doc_id (null last) and, of those, the smallest row hash; of rows that are
    equal in every column one stays.  Texts move through one shuffle, as the last join and the removal of equal
    rows use the same key.
    """
    digest = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), row_hash(docs).alias("row"))
    rows = cut(fingerprints_with(digest, ["row"], shingle))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    distinct = cut(rows.groupBy("fp").agg(F.min(order).alias("first")))
    tree = components(links(distinct.select("fp"), distance))
    placed = distinct.join(tree.select(F.col("u").alias("fp"), "m"), "fp", "left").withColumn("m", F.coalesce("m", "fp"))
    key = ["id", "row"]
    keep = placed.groupBy("m").agg(F.min("first").alias("first")).select(F.coalesce("first.doc_id", F.lit(-1)).alias("id"), F.col("first.row").alias("row"))
    own = [f"c{k}" for k in range(len(docs.columns))]  # whatever the columns are called
    marked = docs.select(*[F.col(f"`{n}`").alias(c) for n, c in zip(docs.columns, own)],
                         F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(-1)).alias("id"), row_hash(docs).alias("row"))
    return marked.join(keep.distinct(), key, "left_semi").dropDuplicates(key).select(*[F.col(c).alias(n) for n, c in zip(docs.columns, own)])
