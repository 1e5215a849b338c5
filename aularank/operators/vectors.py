"""Exact top-k dot-product search as a blocked product (VEC-2, VEC-3, VEC-7).

Left rows (queries) and right rows (nodes or chunks) carry a ``group`` (the collection).  Inside a group both sides
are hashed into blocks of about ``SIDE_ROWS`` rows (``block_rows``, if that is more); the numbers of blocks come from a count per
group that is part of the plan, so one path serves every size.  Pairs of blocks grow with the product of both sides, so their total
is counted beforehand and dealt over as many tasks (``TASK_PAIRS`` a task): a task's rows do not grow with the input.  Each (group, left block, right
block) is one ``applyInArrow`` group that multiplies the two dense blocks with numpy, ``block_rows`` left rows or fewer at a
time, and keeps the top-k per left row.  A final window keeps the top-k per left row over all right blocks.  No group holds more
than two blocks, a row is copied once for each block of the other side, and no (query, chunk) pair is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aularank.session import only_row

HIT_SCHEMA = "left_id long, right_id long, score double"


#: Rows of one side that a group holds at least, and products of one tile.
SIDE_ROWS = 16_384
TILE = 1 << 22
#: Pairs of blocks that a task is dealt, about.
TASK_PAIRS = 4


def _matrix(t: pa.Table) -> np.ndarray:
    vec = t["vec"].combine_chunks()
    vec = vec.combine_chunks() if isinstance(vec, pa.ChunkedArray) else vec
    return vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)


def _block_top_k(k: int, block_rows: int):
    def run(t: pa.Table) -> pa.Table:
        left = t.filter(pa.compute.equal(t["side"], 0))
        right = t.filter(pa.compute.equal(t["side"], 1)).sort_by("id")
        out = [[], [], []]
        if left.num_rows and right.num_rows:
            lv, rv = _matrix(left), _matrix(right).T
            lid, rid, skips = left["id"].to_numpy(), right["id"].to_numpy(), left["skip"]
            tile, kk = max(1, min(block_rows, TILE // len(rid))), min(k, len(rid))
            for at in range(0, len(lid), tile):
                s = lv[at: at + tile] @ rv
                if skips.null_count < len(skips):
                    for row, skip in enumerate(skips.slice(at, tile).to_pylist()):
                        if skip:
                            s[row, np.isin(rid, np.asarray(skip, np.int64))] = -np.inf
                thr = -np.partition(-s, kk - 1, axis=1)[:, kk - 1]
                r, c = np.nonzero((s >= thr[:, None]) & np.isfinite(s))
                sc = s[r, c]
                order = np.lexsort((c, -sc, r))
                r, c, sc = r[order], c[order], sc[order]
                start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, np.int64)
                keep = np.arange(len(r)) - np.repeat(start, np.diff(np.r_[start, len(r)])) < k
                for column, x in zip(out, (lid[at + r[keep]], rid[c[keep]], sc[keep])):
                    column.append(x)
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.chunked_array([pa.array(x, kind) for x in xs], kind) for xs, kind in zip(out, kinds)], ["left_id", "right_id", "score"])

    return run


def top_k_dot(left: DataFrame, right: DataFrame, k: int, block_rows: int = 4096, excluded: DataFrame | None = None) -> DataFrame:
    """Top-``k`` right rows per left row by dot product within the same group.

    left, right: ``(id long, group string, vec array<float>)``; ``excluded``: optional pairs
    ``(left_id, right_id)`` that must not meet (a few per left row).
    Returns ``(left_id, right_id, score, rank)``; ties: right id ascending.
    """
    left = left.select("id", "group", "vec")
    if excluded is None:
        left = left.withColumn("skip", F.lit(None).cast("array<long>"))
    else:
        skip = excluded.groupBy(F.col("left_id").alias("id")).agg(F.collect_set(F.col("right_id").cast("long")).alias("skip"))
        left = left.join(skip, "id", "left")
    blocks = lambda df, name: df.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / F.lit(max(block_rows, SIDE_ROWS))).cast("int").alias(name))
    size = blocks(left, "bl").join(blocks(right, "br"), "group")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    l_rows = left.join(size, "group").select("id", "group", "vec", "skip", F.lit(0).alias("side"), own("bl").alias("lb"), each("br").alias("rb"))
    r_rows = right.join(size, "group").select("id", "group", "vec", F.lit(None).cast("array<long>").alias("skip"),
                                              F.lit(1).alias("side"), each("bl").alias("lb"), own("br").alias("rb"))
    pairs = only_row(size.agg(F.sum(F.col("bl").cast("long") * F.col("br"))))[0] or 0
    both, tasks = l_rows.unionByName(r_rows), -(-pairs // TASK_PAIRS)
    if tasks > int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        both = both.repartition(tasks, "group", "lb", "rb")
    hits = both.groupBy("group", "lb", "rb").applyInArrow(_block_top_k(k, block_rows), HIT_SCHEMA)
    w = Window.partitionBy("left_id").orderBy(F.col("score").desc(), F.col("right_id").asc())
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def centroid_index(right: DataFrame, cells: int, block_rows: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Rows filed under their nearest centroid, and the cells.

    Centroids are about ``cells`` rows of each group, picked by the hash of their id (the smallest hash always).  Returns
    ``(id, group, vec, cell)`` and ``(group, cell, centre, radius)``; ``cell`` is the centroid's id, ``radius`` at least the
    distance of any of its rows.
    """
    pick = F.xxhash64("id", F.lit(13))
    size = right.groupBy("group").agg(F.count(F.lit(1)).alias("_n"), F.min_by("id", pick).alias("_first"))
    chosen = right.join(size, "group").where(
        (F.col("id") == F.col("_first")) | (F.pmod(pick, F.ceil(F.col("_n") / F.lit(cells))) == 0)).select("id", "group", "vec")
    wide = lambda last: F.concat(F.transform("vec", lambda x: x.cast("double")), F.array(last)).alias("vec")
    # |x - c|^2 = |x|^2 - 2 (x c - |c|^2 / 2): the nearest centroid has the largest product of the widened vectors.
    near = top_k_dot(right.select("id", "group", wide(F.lit(1.0))), chosen.select("id", "group", wide(_square("vec") / -2)), 1, block_rows)
    filed = right.join(near.select(F.col("left_id").alias("id"), F.col("right_id").alias("cell"), F.col("score").alias("_s")), "id")
    norm = _square("vec")
    # Slack for rounding: a radius may be too large, never too small.
    far = F.sqrt(F.greatest(norm - 2 * F.col("_s"), F.lit(0.0))) + (F.sqrt(norm) + 1) * 1e-6
    radius = filed.groupBy("group", "cell").agg(F.max(far).alias("radius"))
    centres = chosen.select("group", F.col("id").alias("cell"), F.col("vec").alias("centre"))
    return filed.drop("_s"), radius.join(centres, ["group", "cell"])


def _square(vec: str):
    return F.aggregate(vec, F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))


def cell_visits(left: DataFrame, index: DataFrame, cells: DataFrame, k: int, block_rows: int = 4096,
                excluded: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Hits of both rounds and the (left_id, cell, round) visited; a cell of round 0 is one whose bound rules it out.

    A row of a cell scores at most ``q c + |q| radius``.  Round 1 visits each query's cell of the largest bound; round 2 every
    other cell whose bound reaches the k-th score of round 1 (all of them, where round 1 found fewer than k rows).
    """
    key = lambda: F.concat_ws("/", "group", F.col("cell").cast("string"))
    rows = index.select("id", key().alias("group"), "vec").checkpoint()
    centres = cells.select(F.col("cell").alias("id"), "group", F.col("centre").alias("vec"))
    many = cells.groupBy("group").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    near = top_k_dot(left, centres, int(many), block_rows).select("left_id", F.col("right_id").alias("cell"), F.col("score").alias("_qc"))
    q = left.select(F.col("id").alias("left_id"), "group", "vec", F.sqrt(_square("vec")).alias("_q"))
    pairs = near.join(q.drop("vec"), "left_id").join(cells.select("group", "cell", "radius"), ["group", "cell"])
    bound = F.col("_qc") + F.col("_q") * F.col("radius") + (F.col("_q") + 1) * 1e-6
    order = Window.partitionBy("left_id").orderBy(F.col("_b").desc(), F.col("cell").asc())
    pairs = pairs.withColumn("_b", bound).withColumn("_r", F.row_number().over(order)).select("left_id", "group", "cell", "_b", "_r").checkpoint()
    search = lambda p: top_k_dot(
        p.join(q.select("left_id", "vec"), "left_id").select(F.col("left_id").alias("id"), key().alias("group"), "vec"), rows, k, block_rows, excluded)
    first = search(pairs.where(F.col("_r") == 1)).checkpoint()
    kth = first.where(F.col("rank") == k).select("left_id", F.col("score").alias("_t"))
    round_ = F.when(F.col("_r") == 1, 1).when(F.col("_t").isNull() | (F.col("_b") >= F.col("_t")), 2).otherwise(0)
    visits = pairs.join(kth, "left_id", "left").withColumn("round", round_)
    hits = first.unionByName(search(visits.where(F.col("round") == 2).select("left_id", "group", "cell"))).drop("rank")
    return hits, visits.select("left_id", "cell", "round")


def top_k_dot_cells(left: DataFrame, right: DataFrame, k: int, cells: int, block_rows: int = 4096,
                    excluded: DataFrame | None = None) -> DataFrame:
    """``top_k_dot`` through a centroid index: the same rows, without the cells that a query's bound rules out.

    A query is sent to the cells it visits instead of to every block of its collection.  It pays where vectors have clusters;
    where they have none, every cell is visited and the assignment of rows to cells is extra work.  Vectors must be finite.
    Left and right ids are unique.
    """
    index, found = centroid_index(right.select("id", "group", "vec"), cells, block_rows)
    hits, _ = cell_visits(left.select("id", "group", "vec"), index.checkpoint(), found.checkpoint(), k, block_rows, excluded)
    w = Window.partitionBy("left_id").orderBy(F.col("score").desc(), F.col("right_id").asc())
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
