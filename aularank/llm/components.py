"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aularank.llm.common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("m").alias("u"), F.col("u").alias("m")))
    low = both.groupBy("u").agg(F.min("m").alias("low")).withColumn("low", F.least("u", "low"))
    return (both.join(low, "u").where("m > u").select(F.col("m").alias("u"), F.col("low").alias("m"))
            .where("u <> m").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "m").alias("u"), F.least("u", "m").alias("m"))
    low = down.groupBy("u").agg(F.min("m").alias("low"))
    moved = down.join(low, "u").select(F.col("m").alias("u"), F.col("low").alias("m"))
    return moved.union(low.select("u", F.col("low").alias("m"))).where("u <> m").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, m): for every node that has a smaller node in its component, that component's smallest node.

    ``edges`` has two long columns (a, b).  A node absent from the result is its component's smallest.  Nulls
    and loops are dropped; repeated edges count once; an empty table gives an empty one.  Each round is cut by a
    checkpoint; only counts reach the driver.
    """
    a, b = edges.columns
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("m")).where("u <> m").distinct()
    links = cut(links)
    while True:
        # A finished forest is made of stars: no centre is a leaf too, and no leaf has two centres.
        low = links.groupBy("u").agg(F.min("m").alias("low"), F.count("*").alias("n"))
        many = low.where("n > 1").limit(1).count()
        if not many and not links.join(links.select(F.col("u").alias("m")), "m", "left_semi").limit(1).count():
            return links
        links = cut(_small_star(_large_star(links)))
