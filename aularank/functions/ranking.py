"""Distributed ranking primitives.

``segment_positions`` numbers rows 1..n within a segment under a total order
without moving a whole segment into one task: rows are range-partitioned on
``(segment, order)``, numbered inside each range partition, and shifted by the
row counts of the earlier partitions of the same segment (a table of at most
``partitions + segments`` rows).

``first_untaken`` returns, per user, the first ``k`` positions of the user's
segment ranking whose item the user has not taken: the first ``k`` of the
positions ``1 .. k + t(u)`` (``t(u)`` = the user's taken items that appear in
the ranking) that are not among the user's taken positions, one array per user:
work is ``k`` rows per user plus one row per taken item, never users x items.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segment_positions(df: DataFrame, seg_cols: Sequence[str], order: Sequence[Column],
                      name: str = "pos", partitions: int | None = None, weight: str | None = None) -> DataFrame:
    """Consecutive 1-based position per segment; ``order`` must be a total order.

    With ``weight`` (an integer column) the running sum of that column, the row itself included, takes the place of the position.
    """
    from aularank.session import kept

    seg = [F.col(c) for c in seg_cols]
    # The partition id is read by two branches below; checkpointing fixes the
    # sampled range bounds and the ids once (no reliance on exchange reuse).
    # Without an explicit count AQE may coalesce adjacent range partitions,
    # which keeps every partition a contiguous, ordered key range.
    ranged = (df.repartitionByRange(partitions, *seg, *order) if partitions
              else df.repartitionByRange(*seg, *order))
    ranged = kept(ranged.withColumn("_pid", F.spark_partition_id()))
    w = Window.partitionBy("_pid", *seg_cols).orderBy(*order)
    so_far = F.row_number().over(w) if weight is None else F.sum(weight).over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = ranged.withColumn("_lpos", so_far)
    total = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = ranged.groupBy("_pid", *seg_cols).agg(total.alias("_cnt"))
    before = Window.partitionBy(*seg_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", *seg_cols, F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    cols = [c for c in df.columns]
    return local.join(offsets, ["_pid", *seg_cols]).select(
        *cols, (F.col("_off") + F.col("_lpos")).cast("int").alias(name))


#: Copies of a ranking that a join by position or item is spread over (many users ask for the same few positions).
SALTS = 16


def _salted(rows: DataFrame, user: str, salts: int) -> DataFrame:
    return rows.withColumn("_salt", F.pmod(F.xxhash64(user), F.lit(salts)).cast("int"))


def _copies(ranking: DataFrame, salts: int) -> DataFrame:
    return ranking.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def first_untaken(users: DataFrame, ranking: DataFrame, taken: DataFrame, k: int,
                  user: str, item: str, seg_cols: Sequence[str] = (), pos: str = "pos", salts: int = SALTS) -> DataFrame:
    """First ``k`` untaken ranking positions per user.

    users:   (user, *seg_cols[, _k]) - one row per user; ``_k``: the user's own ``k``.
    ranking: (*seg_cols, item, pos, ...) - positions 1..n per segment.
    taken:   (user, item).
    ``salts``: copies of the ranking (1 where a segment has few users).
    Returns ``ranking`` columns plus ``user`` and ``slot`` (1..k).
    """
    seg = list(seg_cols)
    own_k = F.col("_k") if "_k" in users.columns else F.lit(k)
    wanted = users.select(user, *seg, own_k.cast("int").alias("_k"))
    # A hot course, and the first positions, are asked for by very many users: both joins are salted by user.
    taken_pos = (
        _salted(taken.select(user, item).join(wanted.drop("_k"), user), user, salts)
        .join(_copies(ranking.select(*seg, item, pos), salts), [*seg, item, "_salt"])
        .select(user, pos)
    )
    t = taken_pos.groupBy(user).agg(F.collect_set(pos).alias("_t"))
    need = wanted.join(t, user, "left")
    length = ranking.groupBy(*seg).agg(F.max(pos).alias("_n"))  # a row a segment; one row without segments
    need = need.join(length, seg) if seg else need.crossJoin(length)
    held = F.coalesce(F.col("_t"), F.array().cast("array<int>"))
    upto = F.least(F.col("_k") + F.size(held), F.col("_n"))
    free = F.slice(F.array_except(F.sequence(F.lit(1), upto), held), 1, F.col("_k"))
    first = need.where((upto >= 1) & (F.col("_k") >= 1)).select(user, *seg, F.posexplode(free).alias("_i", pos)) \
        .select(user, *seg, pos, (F.col("_i") + 1).alias("slot"))
    return _salted(first, user, salts).join(_copies(ranking, salts), [*seg, pos, "_salt"]).drop("_salt")


def beaten_by(rows: DataFrame, seg_cols: Sequence[str], item: str, lo: str, hi: str, name: str = "beaten") -> DataFrame:
    """Adds how many items of the segment come before the item whatever the exact scores are.

    A row's exact score differs from user to user but lies in ``[lo, hi]``; order: score desc, ``item`` asc.  Item a
    surely comes before b where ``a.lo > b.hi``, or they are equal and ``a < b``.  So b is among the first ``k`` of some
    user only if ``beaten < k``.
    """
    ends = reduce(DataFrame.unionByName, [
        rows.withColumn("_v", F.col(lo)).withColumn("_w", F.lit(1)),
        rows.withColumn("_v", F.col(hi)).withColumn("_w", F.lit(0))])
    counted = segment_positions(ends, seg_cols, [F.col("_v").desc(), F.col(item).asc(), F.col("_w").asc()], name, weight="_w")
    return counted.where(F.col("_w") == 0).drop("_v", "_w")


#: Steps of one that scores are counted by in ``within_reach``.
STEPS = 4096


def within_reach(rows: DataFrame, users: DataFrame, seg_cols: Sequence[str], lo: str, hi: str) -> DataFrame:
    """The rows of a segment that can be among the first ``_k`` of one of its users, before any ranking.

    Rows are counted by steps of ``lo``; where the rows from a step on are as many as the segment's largest ``_k``, all of them come
    before a row whose ``hi`` lies below that step.  What is left out beats no row that stays, so ``beaten_by`` counts the same.
    """
    seg = list(seg_cols)
    step = lambda c: F.floor(F.col(c) * STEPS)
    most = users.groupBy(*seg).agg(F.max("_k").alias("_most"))
    above = Window.partitionBy(*seg).orderBy(F.col("_step").desc())
    counted = rows.groupBy(*seg, step(lo).alias("_step")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_n", F.sum("_n").over(above))
    least = most.join(counted.join(most, seg).where(F.col("_n") >= F.col("_most")).groupBy(*seg).agg(F.max("_step").alias("_step")), seg, "left")
    return rows.join(least.drop("_most"), seg).where(F.col("_step").isNull() | (step(hi) >= F.col("_step"))).drop("_step")


def possible_firsts(users: DataFrame, rows: DataFrame, seg_cols: Sequence[str], user: str, beaten: str = "beaten",
                    salts: int = SALTS) -> DataFrame:
    """Every row of the user's segment that can be among the user's first ``_k`` (``beaten < _k``).

    Rows are filed by the power of two of ``beaten + 1``, and a user asks only for the powers up to the own ``_k``: what
    is joined for a user depends on that user's number, not on the largest of the segment.
    """
    power = lambda n: F.floor(F.log2(n.cast("double") + F.lit(0.5))).cast("int")
    seg = list(seg_cols)
    most = users.groupBy(*seg).agg(F.max("_k").alias("_most"))
    rows = rows.join(most, seg).where(F.col(beaten) < F.col("_most")).drop("_most")  # only these are copied
    asked = users.where(F.col("_k") >= 1).withColumn("_power", F.explode(F.sequence(F.lit(0), power(F.col("_k")))))
    filed = _copies(rows.withColumn("_power", power(F.col(beaten) + 1)), salts)
    return _salted(asked, user, salts).join(filed, [*seg, "_power", "_salt"]) \
        .where(F.col(beaten) < F.col("_k")).drop("_power", "_salt")
