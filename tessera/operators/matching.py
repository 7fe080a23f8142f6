"""Largest matchings between two sets of clusters, by joins: layers from all free rows at once, paths that share no node flipped together.

An edge table (l, r) is never held by a task. Supersteps are tables in the shared folder; the driver sees whether a layer is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import Tables


def _some(df: DataFrame) -> bool:
    return df.limit(1).count() > 0


def _greedy(tables: Tables, edges: DataFrame) -> DataFrame:
    """A matching that no edge can join: free rows ask a free column, which takes the smallest that asks."""
    held = edges.limit(0).select("l", "r")
    while True:
        free = edges.join(held.select("l"), "l", "left_anti").join(held.select("r"), "r", "left_anti")
        asked = free.groupBy("l").agg(F.min_by("r", F.xxhash64("l", "r")).alias("r"))
        new = tables.cut(asked.groupBy("r").agg(F.min("l").alias("l")).select("l", "r"), "taken")
        if not _some(new):
            return held
        held = tables.cut(held.union(new), "held")


def largest_matching(edges: DataFrame) -> DataFrame:
    """(l, r) of a largest matching of the distinct edges (l, r); null ends don't count.

    Each phase grows a forest in layers from the free rows: an edge to a column not seen yet, then the column's own row. The first layer with free
    columns ends it. Trees share no node, so one path of each tree is flipped; without a free column the matching is a largest one.
    """
    tables = Tables(edges.sparkSession, "matching")
    edges = tables.cut(edges.select("l", "r").where("l IS NOT NULL AND r IS NOT NULL").distinct(), "edges")
    held = _greedy(tables, edges)
    while True:
        front = edges.select("l").distinct().join(held.select("l"), "l", "left_anti").select("l", F.col("l").alias("root"))
        seen, depth, ends = None, 0, None
        while True:
            reached = front.join(edges, "l").groupBy("r").agg(F.min(F.struct("root", "l")).alias("by")).select("r", F.col("by.l").alias("parent"), F.col("by.root").alias("root"))
            layer = tables.cut(reached if seen is None else reached.join(seen.select("r"), "r", "left_anti"), f"layer-{depth}")
            seen = layer if seen is None else tables.cut(seen.union(layer), "seen")
            if not _some(layer):
                return held
            ends = tables.cut(layer.join(held.select("r"), "r", "left_anti").groupBy("root").agg(F.min("r").alias("r")), "ends")
            if _some(ends):
                break
            front, depth = layer.select("r", "root").join(held, "r").select("l", "root"), depth + 1
        # back along the trees: every path has as many edges
        at, flipped = ends, None
        for _ in range(depth + 1):
            step = tables.cut(at.join(seen.select("r", "parent"), "r").select("root", F.col("parent").alias("l"), "r"), "step")
            flipped = step.select("l", "r") if flipped is None else flipped.union(step.select("l", "r"))
            at = step.where("l <> root").select("root", "l").join(held, "l").select("root", "r")
        flipped = tables.cut(flipped, "flipped")
        held = tables.cut(held.join(flipped.select("l"), "l", "left_anti").select("l", "r").union(flipped), "held")
