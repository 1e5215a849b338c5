"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly, equal texts kept together.

Groups of equal texts are dealt by hash into a fixed number of cells, so what is packed on the driver never grows
with the data: one vector a cell.  A group that holds a notable share of all rows, bytes or tokens is first dealt into
pieces that are cells of their own, so no task numbers a whole hot group.  Its pieces are placed together, unless
the group would fill over half a shard: then each is placed by itself.  Units go largest first to the shard whose
residual capacity has the highest dot product with them, among those that still have room for their bytes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from aularank.llm.common import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Cells for each shard, the share of a shard that a group may have before it is dealt into pieces, and the share
#: beyond which its pieces need not stay together.
CELLS_PER_SHARD = 1024
SPLIT_SHARE = 1 / 64
WHOLE_SHARE = 1 / 2
PIECES = 1 << 16


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each vector (rows: bytes, tokens, rows), largest bytes first, ties in the given order."""
    capacity = np.maximum(vectors.sum(0) / shards, 1e-9)
    left = np.ones((shards, vectors.shape[1]))
    unit = vectors / capacity
    out = np.zeros(len(vectors), np.int64)
    for i in np.argsort(-vectors[:, 0], kind="stable"):
        v = unit[i]
        room = left[:, 0] >= v[0]
        if room.any():
            score = np.where(room, left @ v, -np.inf)
            s = int(score.argmax())
        else:
            s = int(left[:, 0].argmax())
        left[s] -= v
        out[i] = s
    return out


def units(cells: np.ndarray, vectors: np.ndarray, first_piece: int, shards: int) -> np.ndarray:
    """The unit that each cell is placed with: the pieces of a group that is not too large go together."""
    out = np.arange(len(cells))
    group = np.where(cells >= first_piece, (cells - first_piece) // PIECES, -1)
    share = vectors / np.maximum(vectors.sum(0), 1e-9)
    _, of = np.unique(group, return_inverse=True)
    total = np.zeros((of.max() + 1 if len(of) else 0, vectors.shape[1]))
    np.add.at(total, of, share)
    together = (group >= 0) & (total[of].max(1) <= WHOLE_SHARE / shards)
    first = np.full(len(total), len(cells))
    np.minimum.at(first, of, out)
    return np.where(together, first[of], out)


def shard(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, n_tokens, shard, slot) for every row.

    size: UTF-8 bytes plus 16; a null text counts as an empty one.  slot numbers a shard's rows from 0 without
    gaps, ties (repeated rows) in any order.  Rows of equal text travel together, unless there are so many that they are
    dealt apart by a row number (fixed by a checkpoint), equal rows too; other columns are not read; an empty table gives an empty one.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = cut(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
                           F.regexp_count(body, F.lit(WORD)).cast("long").alias("n_tokens"), F.xxhash64(body).alias("group"),
                           F.monotonically_increasing_id().alias("rid")))
    spark, cells = docs.sparkSession, shards * CELLS_PER_SHARD
    total = rows.agg(F.count("*").alias("rows"), F.sum("size").alias("size"), F.sum("n_tokens").alias("n_tokens")).first()
    schema = "doc_id long, size long, text_crc32 long, n_tokens long, shard int, slot long"
    if not total["rows"]:
        return spark.createDataFrame([], schema)
    key = ["group", "text_crc32", "size"]
    share = F.greatest(*[F.col(c) / F.lit(max(total[d], 1)) for c, d in (("n", "rows"), ("b", "size"), ("t", "n_tokens"))])
    sums = rows.groupBy(*key).agg(F.count("*").alias("n"), F.sum("size").alias("b"), F.sum("n_tokens").alias("t"))
    # at most 3 * shards / SPLIT_SHARE groups can have such a share
    hot = sums.where(share > SPLIT_SHARE / shards).select(*key, F.ceil(share * (2 * shards / SPLIT_SHARE)).cast("long").alias("pieces"))
    rows = rows.join(F.broadcast(hot), key, "left")
    own = F.pmod(F.xxhash64("group", "text_crc32", "size"), F.lit(cells))
    piece = F.lit(cells) + F.pmod(F.xxhash64("group", "text_crc32", "size"), F.lit(1 << 40)) * PIECES + F.pmod(F.xxhash64("rid"), F.col("pieces"))
    rows = cut(rows.withColumn("cell", F.when(F.col("pieces").isNull(), own).otherwise(piece)).drop("pieces", "group", "rid"))
    held = rows.groupBy("cell").agg(F.sum("size").alias("b"), F.sum("n_tokens").alias("t"), F.count("*").alias("n")).orderBy("cell").collect()  # a row a cell
    vectors = np.array([[r["b"], r["t"], r["n"]] for r in held], float)
    _, unit = np.unique(units(np.array([r["cell"] for r in held]), vectors, cells, shards), return_inverse=True)
    whole = np.zeros((unit.max() + 1, 3))
    np.add.at(whole, unit, vectors)
    at = place(whole, shards)[unit]
    base = np.zeros(len(held), np.int64)
    for s in range(shards):
        own_cells = np.flatnonzero(at == s)
        n = vectors[own_cells, 2].astype(np.int64)
        base[own_cells] = np.cumsum(n) - n
    table = spark.createDataFrame([(r["cell"], int(s), int(b)) for r, s, b in zip(held, at, base)],
                                  T.StructType([T.StructField("cell", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("base", T.LongType())]))
    order = Window.partitionBy("cell").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("at", F.row_number().over(order) - 1)
    return (numbered.join(F.broadcast(table), "cell")
            .select("doc_id", "size", "text_crc32", "n_tokens", "shard", (F.col("base") + F.col("at")).alias("slot")))
