"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorica.llm.common import stored


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("u", "m")).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node reachable.

    Each step groups by node with map-side combining and joins the minima back, so a node with
    very many neighbours is split by the skew join. Every round is written to the shared folder.
    Only a count and a checksum reach the driver. Loops and repeated edges are ignored; without
    edges the result is empty.
    """
    now = stored(edges.toDF("a", "b").where("a <> b").distinct(), "edges")
    mark = _mark(now)
    while True:
        now = stored(_small_star(stored(_large_star(now), "large")), "small")
        before, mark = mark, _mark(now)
        if before == mark:
            break
    return now.select("a", "b").union(now.select("b", "b")).distinct().toDF("node", "root")
