"""Connected components of a graph given by edges, by alternating large-star and small-star steps.

Each step takes a minimum per node and hands it on, so it needs only partial aggregates and a join with one row per node; that side is
broadcast while it is small. Every step is written to the shared folder, which cuts the lineage. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged_small
from tidemark.staging import stage


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """(a, b) with a > b. Large star: every larger neighbour of a node meets the least of its neighbours and itself; small star: every smaller one and the node."""
    pairs = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least, _ = staged_small(pairs.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m")), "star-least")
    joined = pairs.join(least, pairs["a"] == least["node"])
    if small:
        out = joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a > b").distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """Undirected `edges` (a long, b long; no nulls) -> (node, component): every node that is not the least of its component, with the least."""
    now = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), f"{name}-edges")
    seen = None
    while True:
        size = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if size == seen or size[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = size
        now = stage(_star(stage(_star(now, small=False), f"{name}-large"), small=True), f"{name}-small")
