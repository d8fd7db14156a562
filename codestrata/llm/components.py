"""Connected components by alternating large and small stars; no vertex's neighbours are gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW, stored, tidy


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u > v). Large: each vertex's greater neighbours go to its least one; small: the lesser ones do."""
    if large:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        met = edges.join(least, "u")
        out = met.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


@tidy
def components(links: DataFrame) -> DataFrame:
    """(id, component) of every vertex of links (a, b): the least vertex it can reach. Loops and repeats are allowed.

    Each round writes its edges to the shared folder, so lineage stays short; a few edges are one task's. Rounds grow as
    the logarithm of the longest chain, and only two sums a round reach the driver.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    edges = stored(edges, "edges")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        if state[0] <= FEW:
            edges = edges.coalesce(1)
        edges = stored(_star(_star(edges, True), False), "edges")
    roots = edges.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots)
