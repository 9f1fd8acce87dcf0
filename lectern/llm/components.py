"""Connected components of a graph given as edges, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import staged


def _state(edges: DataFrame) -> tuple:
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def _least(edges: DataFrame, own: bool) -> DataFrame:
    """(u, m): the least neighbour of each node, or itself if `own` and smaller; summed map-side, one row for each node.

    Written first, so that the join that looks it up reads it by an exchange of its own and Spark can split a hub's edges."""
    least = F.min("v") if not own else F.least(F.min("v"), F.first("u"))
    return staged(edges.groupBy("u").agg(least.alias("m")), "edges-least")


def components(edges: DataFrame) -> DataFrame:
    """(u, v) edges of any direction -> (u, v): each node that isn't the least of its component, and that least one."""
    now = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while (state := _state(now)) != before and state[0]:
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.where("v > u").join(_least(both, True), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = staged(large, "edges-large")
        least = _least(large, False)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = staged(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
    return now
