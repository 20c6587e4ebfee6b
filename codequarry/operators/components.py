"""Connected components by alternating stars over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.sources.shared import materialise, remove


def state(rows: DataFrame) -> tuple:
    """Count and checksum of distinct rows: all that the driver sees of a round."""
    return tuple(rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of its component, for every node that has an edge. edges: u, v of one orderable type.

    Each round is one large star and one small star; both keep components, and the edges end as one star a component. The
    rounds needed grow with the logarithm of the longest path, and go on until the edges no longer change. The driver sees one count and one checksum a round. Each
    round's edges are written to the shared folder and the ones before them removed. Self-loops, repeated edges and edges with
    a null end have no effect.
    """
    kind = edges.schema["u"].dataType
    now = materialise(edges.where("u <> v").select(F.col("u").cast(kind), F.col("v").cast(kind)).distinct(), "stars")
    before, settled = state(now), False
    while before[0] and not settled:
        then = materialise(_small_star(_large_star(now)).distinct(), "stars")
        after = state(then)
        remove(now)
        now, before, settled = then, after, after == before
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
