"""Connected components of an edge table by alternating large-star and small-star steps.

Edges stay distributed: each step is a grouped minimum (combined map-side) and a join of the
edges with it. Nodes that hold more than a thousandth of all edges, which the centre of a
large star always does, are fewer than a thousand; their minima are broadcast, so that their
edges stay where they are. Each step is written to the shared scratch folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidestep.llm.common import Scratch, join_facts


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return join_facts(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    joined = join_facts(edges, _least(edges), "u")
    moved = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(joined.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of the edges (u, v), u > v; root is the least node reachable."""
    edges = scratch.keep(edges, "edges")
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        last, state = edges, now
        stars = scratch.keep(_large(last), "stars")
        edges = scratch.keep(_small(stars), "edges")
        scratch.drop(last)
        scratch.drop(stars)
