"""Connected components of an edge table by alternating large-star / small-star steps
(Kiveris et al. 2014).  Every step is a grouped minimum (combined map-side) joined back to
the edges, so a centre that touches a third of all nodes is never gathered in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import write_table


def _star(pairs: DataFrame) -> DataFrame:
    """pairs (u, v): every v hangs on the smallest node among u and its partners."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(low, "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of bigint nodes -> (node, label): the smallest node of each component.

    Nodes without an edge to another node do not appear.  Null ends are ignored; an empty
    table gives an empty result."""
    e = (edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
         .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    e = write_table(e, "edges")
    mark = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small = _star(large)
        e = small.select(F.col("v").alias("a"), "m").union(small.select(F.col("u").alias("a"), "m"))
        e = write_table(e.where("a <> m").select(F.col("a").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
