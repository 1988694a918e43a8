"""Connected components by alternating large and small stars, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


#: Edges up to which the least neighbours of their nodes are sent to every executor.
BROADCAST_EDGES = 200_000


def _joinable(low: DataFrame, edges: int) -> DataFrame:
    """Least neighbours, for a join with edges of which one node may have a great share.

    Few are sent to all executors. Many are written first: a join of two scans is one whose skewed partitions
    Spark splits, which it can't where the aggregate feeds the join.
    """
    return F.broadcast(low) if edges <= BROADCAST_EDGES else stored(low, "least")


def _stars(edges: DataFrame, n: int) -> DataFrame:
    """One large-star and one small-star step over ``n`` edges ``u > v``."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(_joinable(low, n), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    # the node itself keeps its edge to the minimum
    large = large.unionByName(low.where(F.col("m") < F.col("u")).select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(_joinable(low, n), "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the smallest node of its component) for each node of the edges ``a``, ``b``.

    Loops and edges with a null end are left out. Every round is written to the shared folder, and ends when a
    round changes nothing. Rounds grow with the logarithm of the longest path.
    """
    now = stored(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    mark = None
    while True:
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(new) == mark or new[0] == 0:
            break
        mark = tuple(new)
        then = stored(_stars(now, new[0]), "stars")
        drop_stored(now)
        now = then
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots.select("node", F.col("node").alias("label")))
