"""Connected components by alternating large and small stars, all on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import drop_written, written


def _stars(edges: DataFrame) -> DataFrame:
    """One large star, then one small star. edges: a > b."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    large = both.join(least, F.col("a") == F.col("k")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
    linked = large.join(low, F.col("a") == F.col("k")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.union(low.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge (a, b): the smallest node that it reaches.

    Each round is written to the shared folder, so a lost executor costs that round
    only; rounds grow with the logarithm of a component's diameter.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    sums = F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    mark = now.agg(*sums).first()
    while mark[0]:
        new = written(_stars(now), "edges")
        drop_written(now)
        now, last, mark = new, mark, new.agg(*sums).first()
        if last == mark:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
