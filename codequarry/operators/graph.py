"""Graph queries: callers, callees, covering tests, impact, coverage gaps, degrees, boundaries, components without tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.operators.components import connected_components

GAP_KINDS = ("function", "method", "class")


def in_degree(edges: DataFrame) -> DataFrame:
    """id, n: edges, not distinct sources, into each node."""
    return edges.groupBy(F.col("to_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))


def seeds(symbols: DataFrame, calls: DataFrame, n: int) -> DataFrame:
    """id, n_calls of the n most called symbols; never called ones count 0; ties by id."""
    degrees = symbols.select("id").join(in_degree(calls), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_calls"))
    return degrees.orderBy(F.desc("n_calls"), "id").limit(n)


def linked(nodes: DataFrame, edges: DataFrame, at: DataFrame, by: str, to: str, columns: list[str]) -> DataFrame:
    """Distinct columns of the nodes at end `to` of edges whose end `by` is among at (column id)."""
    ends = edges.join(at.select(F.col("id").alias(by)), by, "left_semi").select(F.col(to).alias("id")).distinct()
    return nodes.join(ends, "id").select(columns).distinct()


def callers(nodes: DataFrame, calls: DataFrame, at: DataFrame) -> DataFrame:
    return linked(nodes, calls, at, "to_id", "from_id", ["id", "name", "kind", "file_path", "start_line"])


def callees(nodes: DataFrame, calls: DataFrame, at: DataFrame) -> DataFrame:
    return linked(nodes, calls, at, "from_id", "to_id", ["id", "name", "kind", "file_path", "start_line"])


def covering_tests(nodes: DataFrame, tested_by: DataFrame, at: DataFrame) -> DataFrame:
    return linked(nodes, tested_by, at, "from_id", "to_id", ["id", "name", "file_path"])


def coverage_gaps(symbols: DataFrame, tested_by: DataFrame, public_only: bool = False, limit: int | None = 500) -> DataFrame:
    """Functions, methods and classes without a covering test, by id. The limit is the report's, None gives all."""
    found = symbols.where(F.col("kind").isin(*GAP_KINDS))
    found = found.where("is_exported") if public_only else found
    found = found.join(tested_by.select(F.col("from_id").alias("id")), "id", "left_anti").select("id", "name", "kind", "file_path")
    return found if limit is None else found.orderBy("id").limit(limit)


def undocumented(symbols: DataFrame, documented_by: DataFrame) -> DataFrame:
    return symbols.where("is_exported").join(documented_by.select(F.col("from_id").alias("id")), "id", "left_anti").select("id", "name", "kind")


def orphans(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    return symbols.join(calls.select(F.col("to_id").alias("id")), "id", "left_anti").select("id", "name", "kind")


def degrees(relationships: DataFrame) -> DataFrame:
    """id, rel_type, fan_in, fan_out of every node that has an edge of the type."""
    ends = relationships.select(F.explode(F.array(F.struct(F.col("from_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("to_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"), "rel_type")
    return ends.groupBy("e.id", "rel_type").agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))


def high_impact(symbols: DataFrame, calls: DataFrame, n: int) -> DataFrame:
    """rank, id, fan_in, fan_out of the n symbols with the most callers; ties by id."""
    degree = degrees(calls.withColumn("rel_type", F.lit("CALLS")))
    top = symbols.select("id").join(degree, "id").select("id", "fan_in", "fan_out").orderBy(F.desc("fan_in"), "id").limit(n)
    return top.select(F.row_number().over(Window.orderBy(F.desc("fan_in"), "id")).alias("rank"), "id", "fan_in", "fan_out")


def deep_seed(symbols: DataFrame, calls: DataFrame, among: int = 200, least: int = 3) -> DataFrame:
    """The first of the most called symbols with at least `least` callers within two hops; the most called one if none has. Columns: id, two_hop."""
    top = seeds(symbols, calls, among)
    one = top.select(F.col("id").alias("seed")).join(calls, F.col("seed") == F.col("to_id")).select("seed", F.col("from_id").alias("id")).distinct()
    two = one.join(calls, F.col("id") == F.col("to_id")).select("seed", F.col("from_id").alias("id"))
    reach = one.union(two).distinct().groupBy("seed").agg(F.count(F.lit(1)).alias("two_hop"))
    found = top.join(reach, F.col("id") == F.col("seed"), "left").select("id", "n_calls", F.coalesce("two_hop", F.lit(0)).alias("two_hop"))
    return found.orderBy((F.col("two_hop") >= least).desc(), F.desc("n_calls"), "id").limit(1).select("id", "two_hop")


def dependents(imports: DataFrame) -> DataFrame:
    """id, n_importers, importers: the files that import each file, in order."""
    return imports.groupBy(F.col("to_id").alias("id")).agg(F.count(F.lit(1)).alias("n_importers"), F.array_join(F.array_sort(F.collect_list("from_id")), ",").alias("importers"))


def api_boundary(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """id, file_path, n_outside: exported symbols and their callers in other files."""
    api = symbols.where("is_exported").select("id", "file_path")
    where = symbols.select(F.col("id").alias("from_id"), F.col("file_path").alias("caller_file"))
    used = calls.join(api.withColumnRenamed("id", "to_id"), "to_id").join(where, "from_id").where("NOT caller_file <=> file_path").groupBy("to_id").agg(F.count(F.lit(1)).alias("n_outside"))
    return api.join(used, F.col("id") == F.col("to_id"), "left").select("id", "file_path", F.coalesce("n_outside", F.lit(0)).alias("n_outside"))


def test_deserts(calls: DataFrame, tested_by: DataFrame) -> DataFrame:
    """label, n_symbols: connected components of the call graph (named by their least id) none of whose symbols has a test."""
    labels = connected_components(calls.select(F.col("from_id").alias("u"), F.col("to_id").alias("v")))
    covered = tested_by.select(F.col("from_id").alias("node"), F.lit(1).alias("covered")).distinct()
    groups = labels.join(covered, "node", "left").groupBy("label").agg(F.count(F.lit(1)).alias("n_symbols"), F.count("covered").alias("n_covered"))
    return groups.where("n_covered = 0").select("label", "n_symbols")


def adjacency(edges: DataFrame) -> DataFrame:
    """id, targets: each source's distinct targets in order."""
    return edges.select("from_id", "to_id").distinct().groupBy(F.col("from_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("to_id")), ",").alias("targets"))


def neighbours(edges: DataFrame, at: str = "from_id", other: str = "to_id") -> DataFrame:
    """id, position (from 1), neighbour: the distinct other ends of each node's edges, in order, as rows. Unlike adjacency and dependents it holds no node's list in one value."""
    pairs = edges.select(F.col(at).alias("id"), F.col(other).alias("neighbour")).distinct()
    return pairs.select("id", F.row_number().over(Window.partitionBy("id").orderBy("neighbour")).alias("position"), "neighbour")


def first_written(nodes: DataFrame) -> DataFrame:
    """One row an id: the one with the least ord."""
    return nodes.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("ord"))).where("_n = 1").drop("_n")


def ends(relationships: DataFrame) -> DataFrame:
    """id, node_type, one row for each end of an edge: files by their extension, symbols otherwise."""
    both = relationships.select("from_id").union(relationships.select("to_id")).toDF("id")
    return both.select("id", F.when(F.col("id").rlike(r"\.(ts|js|jsx|tsx)$"), "File").otherwise("Symbol").alias("node_type"))


def placeholders(nodes: DataFrame, relationships: DataFrame) -> DataFrame:
    """id, node_type of edge ends that no node has."""
    return ends(relationships).distinct().join(nodes.select("id"), "id", "left_anti")


def scaled(nodes: DataFrame, relationships: DataFrame, scale: int, crossing: int = 2) -> tuple[DataFrame, DataFrame]:
    """Clones 0 .. scale-1 of a template without its snapshots, ids prefixed S<clone>:. About `crossing` in a hundred edges leave another clone than they enter."""
    clones = nodes.sparkSession.range(scale).select(F.col("id").alias("clone"))
    name = lambda clone, key: F.concat(F.lit("S"), clone.cast("string"), F.lit(":"), key)
    kept = nodes.where("node_type <> 'RepositorySnapshot'")
    copies = kept.crossJoin(F.broadcast(clones)).select(name(F.col("clone"), F.col("id")).alias("id"), "node_type")
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", "from_id", "to_id", "rel_type", F.col("clone").cast("string"))), 1, 7), 16, 10).cast("long")
    edges = relationships.join(kept.select(F.col("id").alias("from_id")), "from_id", "left_semi").crossJoin(F.broadcast(clones)).withColumn("draw", draw)
    source = F.when(F.col("draw") % 100 < crossing, F.floor(F.col("draw") / 100) % scale).otherwise(F.col("clone"))
    return copies, edges.select(name(source, F.col("from_id")).alias("from_id"), name(F.col("clone"), F.col("to_id")).alias("to_id"), "rel_type")
