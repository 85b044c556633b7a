"""Connected components of links between ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partonflow.llm.common import dropped, stored


def components(links: DataFrame) -> DataFrame:
    """(id, component) for links (a, b) of longs: the smallest id that can be reached; only ids that have a link.

    Every round links each id with the smallest id known to it, then links those smallest ids with each other
    (large-star, small-star), so chains halve.  The tables of a round go after it.  All steps are aggregations; no component is gathered anywhere.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    edges = stored(edges, "edges")
    # Done when all components are stars around their least id: no id with two neighbours below it, or with some on both sides.
    while _branching(edges).limit(1).count():
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: neighbours above an id are linked with the least of its neighbours and itself.
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = stored(large, "edges")
        # Small star: an id and its lower neighbours are linked with the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        before, edges = edges, stored(small.filter("u != v").distinct(), "edges")
        dropped(before, large)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _branching(edges: DataFrame) -> DataFrame:
    """The ids that keep ``edges`` (u above v, distinct) from being stars around the least id of each."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("low"), F.lit(0).alias("high")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("low").alias("low"), F.max("high").alias("high")).filter("low + high > 1").select("id")
