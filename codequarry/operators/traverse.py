"""Depth-limited traversal of edge tables by joins of a frontier with the edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.sources.shared import materialise

#: Up to this depth the hops are one plan, whose shuffles of the edges are shared; beyond it each hop is written and revisits are cut.
PLANNED_DEPTH = 6


def _hop(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    return frontier.join(edges, frontier["id"] == edges["src"]).select(F.col("dst").alias("id")).distinct()


def reachable(edges: DataFrame, seeds: DataFrame, depth: int, with_seeds: bool = False) -> DataFrame:
    """id, depth: the fewest hops, 1 to depth, from any seed. edges: src, dst. seeds: id.

    Without with_seeds a seed is in the result only if it lies on a cycle; with it, seeds have depth 0.
    """
    seeds = seeds.select("id").distinct()
    if depth > PLANNED_DEPTH:
        return _by_rounds(edges, seeds, depth, with_seeds)
    frontier, levels = seeds, [seeds.select("id", F.lit(0).alias("depth"))] if with_seeds else []
    for hop in range(1, depth + 1):
        frontier = _hop(frontier, edges)
        levels.append(frontier.select("id", F.lit(hop).alias("depth")))
    return reduce(DataFrame.union, levels).groupBy("id").agg(F.min("depth").alias("depth"))


def _by_rounds(edges: DataFrame, seeds: DataFrame, depth: int, with_seeds: bool) -> DataFrame:
    frontier = materialise(seeds, "frontier")
    visited = frontier.select("id", F.lit(0).alias("depth")) if with_seeds else None
    for hop in range(1, depth + 1):
        found = _hop(frontier, edges)
        if visited is not None:
            found = found.join(visited, "id", "left_anti")
        frontier = materialise(found, "frontier")
        if frontier.isEmpty():
            break
        level = frontier.select("id", F.lit(hop).alias("depth"))
        visited = level if visited is None else visited.union(level)
    return visited if visited is not None else seeds.limit(0).select("id", F.lit(0).alias("depth"))


def forward(relationships: DataFrame) -> DataFrame:
    return relationships.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))


def backward(relationships: DataFrame) -> DataFrame:
    return relationships.select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"))


def undirected(relationships: DataFrame) -> DataFrame:
    """Both directions as equi-joinable rows: a join on either end would be a product of the tables."""
    return forward(relationships).union(backward(relationships))


def neighbourhood(relationships: DataFrame, seeds: DataFrame, radius: int, with_contains: bool = False) -> DataFrame:
    """id, depth within radius over edges of all types in either direction, the seeds at 0. CONTAINS edges count only if asked for."""
    kept = relationships if with_contains else relationships.where("rel_type <> 'CONTAINS'")
    return reachable(undirected(kept), seeds, radius, with_seeds=True)


def subgraph(relationships: DataFrame, ids: DataFrame) -> DataFrame:
    """The relationships both of whose ends are among ids (column id)."""
    ends = ids.select("id").distinct()
    inside = relationships.join(ends.withColumnRenamed("id", "from_id"), "from_id", "left_semi")
    return inside.join(ends.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(relationships.columns)
