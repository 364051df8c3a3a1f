"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.staging import stage


def _smallest(edges: DataFrame, both: bool) -> DataFrame:
    """a, m: the smallest of a and its neighbours (of its smaller neighbours alone unless ``both``)."""
    rows = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else edges
    return rows.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node in ``edges`` (a, b: long): the smallest node reachable. Nodes without edges are left out.

    Edges hang on the smallest neighbour, first for larger nodes, then for smaller ones, until nothing changes: about as
    many rounds as the logarithm of the longest path. Every step is a minimum per node and a join, so a node with many
    neighbours is combined before the shuffle and never gathered.
    """
    downward = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = stage(downward.where("a <> b").distinct())
    seen = None
    while True:
        # larger neighbours of a node hang on its smallest
        m = _smallest(edges, True)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(m, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # a node and its smaller neighbours hang on the smallest of them
        m = _smallest(large, False)
        small = large.join(m, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stage(small.unionByName(m.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    roots = edges.select(F.col("b").alias("id")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
