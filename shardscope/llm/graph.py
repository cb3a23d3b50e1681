"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardscope.llm.common import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hang each node's larger (or not larger) neighbours on the smallest of its neighbourhood."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.where("b < a")
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    met = both.join(least, "a")
    met = met.where("b > a").select("b", "m") if large else met.select("b", "m").unionByName(least.select(F.col("a").alias("b"), "m"))
    return met.where("b <> m").select(F.col("m").alias("a"), "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of every node that has a link. ``edges`` has columns a and b, in any order.

    Every round writes its links to the shared folder, which cuts the lineage; the rounds end when no link changed.
    """
    now = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    seen = now.agg(mark).first()
    while True:
        now = written(_stars(_stars(now, large=True), large=False), "links")
        found = now.agg(mark).first()
        if found == seen:
            break
        seen = found
    hung = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return hung.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
