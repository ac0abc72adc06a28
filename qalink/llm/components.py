"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qalink.operators.joins import lookup_join
from qalink.sources.scratch import stored


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every ``u`` has one ``v`` and no ``v`` is a ``u``."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")),
                                          F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e"))
    seen = ends.groupBy("e.node").agg(F.sum("e.up").alias("ups"), F.min("e.up").alias("centre"))
    return seen.where((F.col("ups") > 1) | ((F.col("ups") > 0) & (F.col("centre") == 0))).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for the nodes of ``edges(u long, v long)``: the smallest node reachable.

    Each step links nodes to smaller neighbours only, by minima and joins, so that a node with very
    many neighbours is one row of a minimum; its edges meet that row spread over many tasks. What a round gives is stored; it ends when every node
    hangs at its smallest. No edges give no rows.
    """
    now = stored(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    while not _is_forest_of_stars(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = lookup_join(both, least, ["u"], spread_by=["v"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = lookup_join(large, least, ["u"], spread_by=["v"]).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        now = stored(down.where("u <> v").distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
