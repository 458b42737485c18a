"""Connected components of a graph whose edges are a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (longs ``a``, ``b``); root is the smallest.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until the edges are
    stars around the smallest node.  Each step only groups for a minimum, which is combined
    before the shuffle, and joins it back; no neighbourhood is gathered.  Edges and minima are
    written tables, so a lost executor repeats one step, and the edges of a hub, which meet in one
    join key, are split by Spark's skew join.
    """
    current = saved(_tidy(edges, "a", "b"), "edges")
    before = None
    while True:
        state = current.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if state == before:
            break
        before = state
        # Every edge has a > b.  Large star: a meets the smallest node around b, which is b itself
        # unless b has a smaller neighbour.
        least = saved(current.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "b"), "minima")
        large = saved(_tidy(current.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("m")), "a", "m"), "large")
        # Small star: the smaller neighbours of a meet at the smallest.
        least = saved(large.groupBy("a").agg(F.min("b").alias("m")), "minima")
        small = large.join(least, "a").select(
            F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")
        )
        current = saved(_tidy(small.select("e.b", "e.m"), "b", "m"), "edges")
    roots = current.select(F.col("b").alias("node")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        roots.select("node", F.col("node").alias("root"))
    )


def _tidy(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct edges without loops, the larger end first."""
    return (
        edges.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .distinct()
    )
