"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickerloom.llm.arrow import stored


def large_star(edges: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a node to the least node around it."""
    ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = edges.select(F.inline(ends))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def small_star(edges: DataFrame) -> DataFrame:
    """Connect a node and its smaller neighbours to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
    return down.join(least, "a").select(F.inline(moved))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); a component is named by its least node.

    Alternates large and small stars until the edges stay the same, which takes about as many rounds as
    the logarithm of the longest path. Each round is a few shuffles of the edges, written to
    the shared checkpoint folder; nothing is gathered in one place.
    """
    def tidy(e: DataFrame) -> DataFrame:
        return stored(e.toDF("a", "b").where(F.col("a") != F.col("b")).distinct())

    def print_of(e: DataFrame) -> tuple:
        row = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    now = tidy(edges.select("a", "b"))
    mark = print_of(now)
    while True:
        now = tidy(small_star(large_star(now).toDF("a", "b").distinct()))
        seen, mark = mark, print_of(now)
        if seen == mark:
            break
    top = F.least("a", "b")
    return now.select(F.explode(F.array("a", "b")).alias("node"), top.alias("component")).distinct()
