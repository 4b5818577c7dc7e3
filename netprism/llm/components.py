"""Connected components of a link table, by alternating star steps on Spark.

Each round links every vertex to the smallest vertex near it (first towards
larger neighbours, then towards smaller ones), which keeps the components and
flattens them to stars in a logarithmic number of rounds.  Minima are partial
aggregates, written once per step; joins meet plain written tables, so that
adaptive execution can split a vertex that holds a third of all links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links(a, b) with a > b, distinct.  Large star: each vertex's larger
    neighbours go to its smallest neighbour or itself; small star: its smaller
    neighbours and itself."""
    if large:
        # links in both directions: the minimum over all neighbours and the vertex itself
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "star-min")
        # larger neighbours a of u = b
        moved = links.select(F.col("b").alias("u"), "a").join(least, "u").select("a", F.col("m").alias("b"))
    else:
        least = stored(links.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "star-min")
        moved = links.select(F.col("a").alias("u"), F.col("b").alias("a")).join(least, "u")
        moved = moved.select("a", F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def connected_components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(vertex, root) for every vertex of ``links(a, b)``; ``root`` is the
    smallest vertex of its component and its own root.  Self links, repeated
    and turned links do no harm; null ends are left out."""
    links = links.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = stored(links.where(F.col("a") != F.col("b")).distinct(), "links")
    before = None
    for _ in range(rounds):
        links = stored(_star(links, large=True), "links")
        links = stored(_star(links, large=False), "links")
        now = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return links.select(F.col("a").alias("vertex"), F.col("b").alias("root")).unionByName(
        links.select(F.col("b").alias("vertex"), F.col("b").alias("root")).distinct())
