"""Connected components of links."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(links: DataFrame) -> DataFrame:
    """(node, home): the smallest node reachable, for every node that has a link in (a, b).

    Alternates large and small stars.  A star's centre is found by a combinable minimum and joined back, so that the
    neighbours of a hub are never one task's.
    """
    from ..session import discard, materialize

    c = F.col
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(c("v").alias("u"), c("u").alias("v")))
        centres = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = materialize(both.filter("v > u").join(centres, "u").select(c("v").alias("u"), c("m").alias("v")).filter("u != v").distinct(), "large")
        nearest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(nearest, "u").select("v", "m").filter("v != m").distinct().select(c("v").alias("u"), c("m").alias("v"))
        old, edges = edges, materialize(small.unionByName(nearest.select("u", c("m").alias("v"))).distinct(), "edges")
        discard(large)
        discard(old)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    nodes = edges.select(c("u").alias("node"), c("v").alias("home"))
    return nodes.unionByName(nodes.select(c("home").alias("node"), "home")).groupBy("node").agg(F.min("home").alias("home"))
