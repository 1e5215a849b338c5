"""Hard-negative mining over an inverted multi-index.

Vectors are cut in two halves, each with a codebook of its own; a pair of codewords is a cell.  The bound of an anchor's
score with any row of a cell is the sum of two half bounds, each the product with the codeword plus the anchor's length
times the codeword's radius (its farthest row).  A multi-sequence heap visits an anchor's cells by falling bounds and
stops when no cell left can hold a row of a window that is still open, so results are exact.

In Spark: rows lie in packed pieces of a cell; anchors send themselves to the cells that their heap reaches, pieces and
requests meet in a join on the cell, and each search runs twice: a first round over the nearest rows sets every window's
threshold, a second one goes on in the same order until the thresholds certify the windows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aularank.llm.common import cut

#: Quantised components are held within this, so that scores of up to 2,048 components fit 63 bits.
LIMIT = 1 << 26
FAR = (1 << 63) - 1
#: Numbers of anchors that one request row holds at most.
REQUEST_ANCHORS = 256


@dataclass(frozen=True)
class MiningParams:
    """``sample_rows``: rows (smallest hash of vec_id) that the codebooks are fitted on; every row is indexed."""

    codewords: int = 16
    sample_rows: int = 8192
    iterations: int = 8
    piece_rows: int = 2048
    first_rows: int = 1024  # rows that the first round of a search reads for an anchor, or a little more
    scale: int = 256
    anchor_mod: int = 100
    relabel_mod: int = 7
    classes: int = 10
    positives: int = 5
    negatives: int = 10
    low_percent: int = 30
    high_percent: int = 90


def prepare(rows: DataFrame, p: MiningParams, vector: str = "embedding") -> DataFrame:
    """(rid, vec_id, label, q): the rows that take part, labels moved, components as integers."""
    x = F.col(f"`{vector}`")
    sound = x.isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    moved = F.when(F.col("vec_id") % p.relabel_mod == 0, (F.col("label").cast("long") + 1) % p.classes).otherwise(F.col("label").cast("long"))
    q = F.transform(x, lambda v: F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), F.floor(F.lit(float(p.scale)) * v.cast("double")).cast("double"))).cast("int"))
    return rows.where(sound).where(F.coalesce(whole, F.lit(False))).select(
        F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), q.alias("q"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of integers as rows of one matrix; shorter lists end in zeros."""
    sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return flat.reshape(len(column), dims)
    out = np.zeros((len(column), dims), np.int32)
    ends = np.cumsum(sizes)
    for i, (end, n) in enumerate(zip(ends, sizes)):
        out[i, :n] = flat[end - n : end]
    return out


def codebook(x: np.ndarray, k: int, iterations: int) -> np.ndarray:
    """k-means of the rows of ``x``: first centres are far from one another, rounds are a fixed number."""
    rng = np.random.default_rng(13)
    centres = x[:1].astype(float)
    near = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < min(k, len(x)) and near.sum() > 0:
        new = x[rng.choice(len(x), p=near / near.sum())].astype(float)
        centres = np.vstack([centres, new])
        near = np.minimum(near, ((x - new) ** 2).sum(1))
    for _ in range(iterations):
        own, _ = nearest(x, centres)
        times = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(times[:, None] > 0, sums / np.maximum(times, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and a distance that is never too small."""
    x = x.astype(float)
    own = ((centres**2).sum(1)[None, :] - 2 * x @ centres.T).argmin(1) if len(x) else np.zeros(0, int)
    return own, np.sqrt(((x - centres[own]) ** 2).sum(1)) * (1 + 1e-9) + 1e-9


@dataclass(frozen=True)
class Cells:
    """Both codebooks; of every cell its rows, its two radii; of every codeword its radius."""

    books: tuple[np.ndarray, np.ndarray]
    rows: np.ndarray
    cell_radii: np.ndarray  # (2, cells)
    radii: tuple[np.ndarray, np.ndarray]
    dims: int

    def bounds(self, vectors: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """Of each half: products with the codewords, upper bounds (anchor x codeword), and the anchors' lengths."""
        half = self.dims // 2
        products, upper, lengths = [], [], []
        for part, book, radius in zip((vectors[:, :half], vectors[:, half:]), self.books, self.radii):
            part = part.astype(float)
            lengths.append(np.sqrt((part**2).sum(1)))
            products.append(part @ book.T)
            upper.append(products[-1] + lengths[-1][:, None] * radius[None, :])
        return products, upper, lengths


def in_order(upper1: np.ndarray, upper2: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(bound, codeword, codeword) of all cells by falling sum of the two half bounds: a multi-sequence heap."""
    first, second = np.argsort(-upper1, kind="stable"), np.argsort(-upper2, kind="stable")
    heap = [(-(upper1[first[0]] + upper2[second[0]]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, int(first[i]), int(second[j])
        if j == 0 and i + 1 < len(first):
            heapq.heappush(heap, (-(upper1[first[i + 1]] + upper2[second[0]]), i + 1, 0))
        if j + 1 < len(second):
            heapq.heappush(heap, (-(upper1[first[i]] + upper2[second[j + 1]]), i, j + 1))


def build_index(rows: DataFrame, p: MiningParams) -> tuple[DataFrame, DataFrame, Cells] | None:
    """(index rows, packed pieces, cells); None for an empty table."""
    spark = rows.sparkSession
    rows = cut(rows)
    dims = rows.agg(F.max(F.size("q"))).first()[0]
    if dims is None:
        return None
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "rid").limit(p.sample_rows).select("q").collect()  # bounded by sample_rows
    x = np.zeros((len(sample), dims))
    for i, r in enumerate(sample):
        x[i, : len(r["q"])] = r["q"]
    half = dims // 2
    books = codebook(x[:, :half], p.codewords, p.iterations), codebook(x[:, half:], p.codewords, p.iterations)
    cell = spark.sparkContext.broadcast((books, dims))  # 2 * codewords centres

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (one, two), d = cell.value
        for batch in batches:
            q = matrix(batch.column(3), d)
            (i, a), (j, b) = nearest(q[:, : d // 2], one), nearest(q[:, d // 2 :], two)
            vec = pa.array([v.tobytes() for v in np.ascontiguousarray(q, np.int32)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(i * len(two) + j, pa.int32()), pa.array(a), pa.array(b), vec],
                                             ["rid", "vec_id", "label", "cell", "d1", "d2", "vec"])

    indexed = cut(rows.mapInArrow(assign, "rid long, vec_id long, label long, cell int, d1 double, d2 double, vec binary"))
    found = indexed.groupBy("cell").agg(F.count("*").alias("n"), F.max("d1").alias("d1"), F.max("d2").alias("d2")).collect()  # a row a cell
    k1, k2 = len(books[0]), len(books[1])
    count, far = np.zeros(k1 * k2, np.int64), np.zeros((2, k1 * k2))
    for r in found:
        count[r["cell"]], far[0, r["cell"]], far[1, r["cell"]] = r["n"], r["d1"], r["d2"]
    cells = Cells(books, count, far, (far[0].reshape(k1, k2).max(1), far[1].reshape(k1, k2).max(0)), dims)
    sizes = F.broadcast(spark.createDataFrame([(int(c), int(-(-n // p.piece_rows))) for c, n in enumerate(count) if n], "cell int, pieces int"))  # a row a cell
    dealt = indexed.join(sizes, "cell").withColumn("piece", F.pmod(F.xxhash64("rid"), F.col("pieces")).cast("int"))

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        body = b"".join(t.column("vec").combine_chunks().to_pylist())
        one = [np.ascontiguousarray(t.column(n).to_numpy(), np.int64).tobytes() for n in ("rid", "vec_id", "label")]
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int32()), "p_rid": pa.array(one[:1], pa.binary()), "p_id": pa.array(one[1:2], pa.binary()),
                         "p_label": pa.array(one[2:], pa.binary()), "p_vec": pa.array([body], pa.binary())})

    pieces = cut(dealt.select("cell", "piece", "rid", "vec_id", "label", "vec").groupBy("cell", "piece")
                 .applyInArrow(pack, "cell int, p_rid binary, p_id binary, p_label binary, p_vec binary"))
    return indexed, pieces, cells


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of ``a`` with those of ``b``."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def requests(anchors: DataFrame, cells: Cells, p: MiningParams, second: bool) -> DataFrame:
    """The cells that each anchor's heap reaches in a round, as packed rows (cell, anchors).

    ``anchors``: (rid, label, vec, lo, hi, need): arrays with an entry a window; ``need`` is the score that a row must reach
    to matter still.  The first round stops after ``first_rows`` rows, the second goes on behind it.
    """
    cell = anchors.sparkSession.sparkContext.broadcast(cells)

    def reached(upper, products_, lengths, i, need, hi) -> Iterator[int]:
        c = cell.value
        seen, least, most = 0, min(need, default=FAR), max(hi, default=-FAR)
        for bound, one, two in in_order(upper[0][i], upper[1][i]):
            slack = 1e-9 * (abs(bound) + lengths[0][i] * lengths[0][i] + lengths[1][i] * lengths[1][i]) + 1e-3
            if bound + slack < least:
                return  # every window is certified
            at = one * len(c.books[1]) + two
            if not c.rows[at]:
                continue
            middle, reach = products_[0][i, one] + products_[1][i, two], lengths[0][i] * c.cell_radii[0, at] + lengths[1][i] * c.cell_radii[1, at]
            if middle - reach - slack > most or middle + reach + slack < least:
                continue  # all its rows lie above every window, or below what is still looked for
            early, seen = seen < p.first_rows, seen + c.rows[at]
            if early != second:
                yield at
            elif not second:
                return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = cell.value
        for whole in batches:
            for start in range(0, whole.num_rows, REQUEST_ANCHORS):
                part = whole.slice(start, REQUEST_ANCHORS)
                vecs = np.frombuffer(b"".join(part.column(2).to_pylist()), np.int32).reshape(part.num_rows, c.dims)
                lo, hi, need = (part.column(k).to_pylist() for k in (3, 4, 5))
                inner, upper, lengths = c.bounds(vecs)
                asked: dict[int, list[int]] = {}
                for i in range(part.num_rows):
                    for at in reached(upper, inner, lengths, i, need[i], hi[i]):
                        asked.setdefault(at, []).append(i)
                rid, label = part.column(0).to_numpy(), part.column(1).to_numpy()
                wide = max(map(len, lo), default=0)
                windows = np.zeros((part.num_rows, wide, 2), np.int64)
                windows[:, :, 0] = FAR  # no row is in a window that is not there
                for i, (a, b) in enumerate(zip(need, hi)):
                    windows[i, : len(a), 0], windows[i, : len(a), 1] = a, b
                out = [(at, rid[own].tobytes(), label[own].tobytes(), vecs[own].tobytes(), windows[own].tobytes()) for at, own in asked.items()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if k == 0 else pa.binary()) for k, x in enumerate(zip(*out))],
                                                     ["cell", "a_rid", "a_label", "a_vec", "a_windows"])

    return anchors.select("rid", "label", "vec", "lo", "hi", "need").mapInArrow(run, "cell int, a_rid binary, a_label binary, a_vec binary, a_windows binary")


def score(met: DataFrame, dims: int, same: bool, k: int) -> DataFrame:
    """(rid, w, other, id, score): of every piece and anchor the best ``k`` rows of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a_rid", "a_label", "a_vec", "a_windows", "p_rid", "p_id", "p_label", "p_vec"]
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            for r in range(batch.num_rows):
                a_rid, a_label, a_vec, windows, p_rid, p_id, p_label, p_vec = (
                    np.frombuffer(c[r].as_buffer(), np.int32 if n.endswith("vec") else np.int64) for c, n in zip(columns, names))
                got = products(a_vec.reshape(len(a_rid), dims), p_vec.reshape(len(p_rid), dims))
                fits = (a_label[:, None] == p_label[None, :]) == same
                if same:
                    fits &= a_rid[:, None] != p_rid[None, :]
                windows = windows.reshape(len(a_rid), -1, 2)
                out: list[list[np.ndarray]] = [[], [], [], [], []]
                for i in range(len(a_rid)):
                    for w, (low, high) in enumerate(windows[i]):
                        at = np.flatnonzero(fits[i] & (got[i] >= low) & (got[i] <= high))
                        if len(at) > k:
                            at = at[np.lexsort((p_rid[at], p_id[at], -got[i][at]))[:k]]
                        if len(at):
                            for column, x in zip(out, (np.full(len(at), a_rid[i]), np.full(len(at), w), p_rid[at], p_id[at], got[i][at])):
                                column.append(x)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out], ["rid", "w", "other", "id", "score"])

    return met.mapInArrow(run, "rid long, w long, other long, id long, score long")


def search(anchors: DataFrame, pieces: DataFrame, cells: Cells, p: MiningParams, same: bool, k: int) -> DataFrame:
    """(rid, w, rank, other, id, score): of every anchor and window (``lo`` <= score <= ``hi``) its first ``k`` rows
    of the same or of another label, by falling score, then by smaller id."""
    order = Window.partitionBy("rid", "w").orderBy(F.desc("score"), "id", "other")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = cut(best(score(requests(anchors.withColumn("need", F.col("lo")), cells, p, False).join(pieces, "cell"), cells.dims, same, k)))
    full = first.where(F.col("rank") == k).groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("kth"))  # an entry a window
    raised = F.transform("lo", lambda x, w: F.coalesce(F.try_element_at("kth", w.cast("long")), x))
    later = anchors.join(full, "rid", "left").withColumn("need", raised)
    second = score(requests(later, cells, p, True).join(pieces, "cell"), cells.dims, same, k)
    return best(first.drop("rank").unionByName(second))


SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(rows: DataFrame, params: MiningParams = MiningParams()) -> DataFrame:
    """The ``SCHEMA`` columns: for each anchor and each of its positives the first negatives whose score lies in the
    positive's window.

    Rows with a null vec_id, label or vector, or a null or non-finite component take no part; shorter vectors count as ending
    in zeros; components beyond 2**26 after scaling count as 2**26; rows that share a vec_id are rows of their own (equal
    scores: smaller vec_id first, then the order in which rows were read); an anchor without positives, or a positive
    without rows in its window (so any with a negative score), gives no row; further columns are not read; an empty
    table gives an empty one.
    """
    p = params
    built = build_index(prepare(rows, p), p)
    if built is None:
        return rows.sparkSession.createDataFrame([], SCHEMA)
    indexed, pieces, cells = built
    anchors = indexed.where(F.col("vec_id") % p.anchor_mod == 0).select("rid", "vec_id", "label", "vec")
    everything = anchors.withColumns({"lo": F.array(F.lit(-FAR)), "hi": F.array(F.lit(FAR))})
    positives = cut(search(everything, pieces, cells, p, True, p.positives)
                    .groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("pos")))  # at most ``positives`` entries
    # 30 * positive <= 100 * negative <= 90 * positive, in whole numbers
    lo = F.transform("pos", lambda x: -F.floor(-(x["score"].cast("decimal(20,0)") * p.low_percent) / F.lit(100).cast("decimal(3,0)")).cast("long"))
    hi = F.transform("pos", lambda x: F.floor((x["score"].cast("decimal(20,0)") * p.high_percent) / F.lit(100).cast("decimal(3,0)")).cast("long"))
    windows = cut(anchors.join(positives, "rid").withColumns({"lo": lo, "hi": hi}))
    found = search(windows, pieces, cells, p, False, p.negatives)
    named = windows.select("rid", F.col("vec_id").alias("anchor_id"), F.posexplode("pos").alias("w", "p"))
    return found.join(named.withColumn("w", F.col("w").cast("long")), ["rid", "w"]).select(
        "anchor_id", F.col("p.id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))
