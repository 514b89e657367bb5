"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from treegrain.session import discard, spill_table


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) of every node with an edge to another; edges: two long columns. The component is its smallest node.

    Each round is written to the shared folder, so a lost executor costs that round's tasks, not the history. Rounds grow as the
    logarithm of the components' diameters; a node of any degree is joined, never gathered.
    """
    spark = edges.sparkSession
    a, b = edges.columns
    now = spill_table(spark, edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b").distinct(), label)
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = mark(now)
    while before[0]:
        last, now = now, spill_table(spark, _small_star(_large_star(now)), label)
        discard(last)
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
