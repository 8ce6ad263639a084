"""Connected components as alternating star operations on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.session import written


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of edges (a, b): component is the smallest id it is connected to.

    Each round every node hands its neighbours above it to the smallest node of its neighbourhood, then
    the same for those below it; the edges end as one star for each component. Rounds grow with the logarithm
    of the longest path and end when the edges are stars. Minima are aggregated before the shuffle and nothing is gathered by node; each round is a
    written table. Loops and repeated edges do no harm; no edges give no rows.
    """
    stars = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while not _are_stars(stars):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        stars = written(small, "edges")
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node is the upper end of one edge (u, v) at most, and of none if it is a lower end: one count for each node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty()


def joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """components() of all links that gave `found` and of the new `links` (a, b): only what the new ones join is worked out anew.

    Each end stands for its component, so the edges left are those between different components. Links whose ends were
    in one component already change nothing; ends that `found` does not have are components of their own until now.
    """
    ends = links.select("a", "b")
    for end in ("a", "b"):
        known = found.select(F.col("id").alias(end), F.col("component").alias(f"{end}_"))
        ends = ends.join(known, end, "left").withColumn(f"{end}_", F.coalesce(f"{end}_", end))
    moved = components(ends.select(F.col("a_").alias("a"), F.col("b_").alias("b")))
    to = moved.select(F.col("id").alias("component"), F.col("component").alias("low"))
    # An end that had no row in `found` is its own old component, so it is an id of `moved` or was joined by nothing.
    old = found.join(to, "component", "left").select("id", F.coalesce("low", "component").alias("component"))
    return old.unionByName(moved.join(found.select("id"), "id", "left_anti"))
