"""Connected components of links, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node u ties its larger (or its smaller) neighbours to the least of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "a2")
    # a star's centre may have any number of neighbours: adaptive execution splits its rows in this join
    tied = both.join(least, F.col("a") == F.col("a2")).select("a", "b", F.least("a", "m").alias("m"))
    far = tied.filter("b > a") if large else tied
    out = far.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(tied.select("a", F.col("m").alias("b")))
    return materialize(out.filter("a > b").distinct(), "stars")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes in ``links`` (a, b): the component is its least node. Steps grow with the logarithm of
    the longest chain; every step is written to the shared folder. Links of a node with itself, or with null, don't count."""
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a is not null and b is not null and a > b").distinct()
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    edges = materialize(edges, "links")
    seen = state(edges)
    while seen[0]:
        wide = _star(edges, large=True)
        edges, old = _star(wide, large=False), edges
        discard(wide, old)
        if seen == (seen := state(edges)):
            break
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    out = materialize(nodes, "components")
    discard(edges)
    return out
