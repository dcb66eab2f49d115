"""Connected components by alternating large-star and small-star steps; edges stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, with_least


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each u (large: those above it; small: those below it and u itself) to their minimum.

    A hub's edges stay spread: its minimum is joined back once for each salt of its neighbours.
    """
    near = _both_ways(edges) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = with_least(near, ["u"], "v", "m").withColumn("m", F.least("u", "m"))
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        each = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
        out = linked.select(each.alias("e")).select("e.u", "e.v")
    return out.where("u <> v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every u has one v and no v is a u: then the edges are the answer."""
    once = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1")
    chained = edges.select("v").distinct().join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
    return once.isEmpty() and chained.isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (u, v): the component is its smallest node."""
    edges = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _stars(edges):
        before, edges = edges, materialise(_star(_star(edges, large=True), large=False))
        discard(before)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
