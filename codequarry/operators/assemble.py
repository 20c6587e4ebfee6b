"""From a source tree to a property graph: read, scan, resolve, gather nodes and relationships."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.operators.extract import facts, scan
from codequarry.operators.graph import ends, first_written
from codequarry.operators.resolve import Resolver
from codequarry.sources.files import read_tree
from codequarry.sources.shared import materialise

#: The kind of node written last.
PLACEHOLDER = 5
_NODE = {"kind": "string", "file_path": "string", "start_line": "int", "end_line": "int"}


def _nodes(df: DataFrame, node_type: str | Column, order: int, key: str, name: Column, is_test: bool | Column = False, **columns: Column) -> DataFrame:
    flag = is_test if isinstance(is_test, Column) else F.lit(is_test)
    exported = columns.pop("is_exported", F.lit(False))
    rest = [columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in _NODE.items()]
    return df.select(F.col(key).alias("id"), F.lit(node_type).alias("node_type"), name.alias("name"), *rest, exported.alias("is_exported"), flag.alias("is_test"), F.lit(order).alias("ord"))


def graph_of(label: str, scanned: DataFrame, with_contains: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, relationships, errors) of scanned files.

    Of nodes with one id the first kind written stays: snapshot, file, symbol, test, marker. Ends of relationships that no node has become placeholders:
    ends are the kind written last, so that no plan holds the nodes twice.
    CONTAINS edges from files to their symbols are made only if asked for.
    """
    spark = scanned.sparkSession
    f = facts(scanned)
    r = Resolver(f)
    line = {"file_path": F.col("file_path"), "start_line": F.col("start_line"), "end_line": F.col("end_line")}
    marks = scanned.select(F.col("path").alias("file_path"), F.inline("markers")).withColumn("id", F.concat_ws(":", "file_path", "marker_type", F.col("line").cast("string")))
    found = [
        _nodes(spark.createDataFrame([(f"repo:{label}",)], "id string"), "RepositorySnapshot", 0, "id", F.lit(label)),
        _nodes(f.files, "File", 1, "path", F.col("path"), F.col("is_test"), file_path=F.col("path")),
        _nodes(r.exported(), "Symbol", 2, "symbol_id", F.col("name"), kind=F.col("kind"), is_exported=F.col("is_exported"), **line),
        _nodes(f.tests, "Test", 3, "test_id", F.col("test_name"), True, **line),
        _nodes(marks, "TodoMarker", 4, "id", F.col("text"), kind=F.col("marker_type"), file_path=F.col("file_path"), start_line=F.col("line"), end_line=F.col("line")),
    ]
    edges = r.relationships()
    if with_contains:
        edges = edges.union(f.symbols.select("file_path", "symbol_id", F.lit("CONTAINS"), F.lit(None).cast("int")))
    edges = materialise(edges, "relationships")
    found.append(_nodes(ends(edges).where("id IS NOT NULL"), F.col("node_type"), PLACEHOLDER, "id", F.col("id")))
    props = F.when(F.col("ord") == PLACEHOLDER, F.create_map(F.lit("placeholder"), F.lit("true"))).otherwise(F.create_map().cast("map<string,string>"))
    nodes = first_written(reduce(DataFrame.unionByName, found)).withColumn("props", props).drop("ord")
    return nodes, edges, r.errors()


def load_repository(spark: SparkSession, root: str, label: str, walk: str = "graph", with_contains: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, relationships, errors) of the source tree under root."""
    return graph_of(label, materialise(scan(read_tree(spark, root, walk).select("path", "text")), "scanned"), with_contains)


def parse_errors(scanned: DataFrame) -> DataFrame:
    return scanned.where("error IS NOT NULL").select(F.col("path").alias("file"), F.lit(None).cast("int").alias("line"), F.col("error").alias("message"), F.lit(True).alias("fatal"))


def match_declarations(declared: DataFrame, symbols: DataFrame) -> DataFrame:
    """decl_id, symbol_id: the symbol of a type checker's declaration (decl_id, file_path, name, line): the first that holds its line, else the first of its name."""
    both = declared.join(symbols.select("file_path", "name", "symbol_id", "start_line", "end_line", "ord"), ["file_path", "name"])
    best = both.groupBy("decl_id").agg(F.min(F.struct(F.when(F.col("line").between(F.col("start_line"), F.col("end_line")), 0).otherwise(1).alias("away"), "ord", "symbol_id")).alias("m"))
    return best.select("decl_id", "m.symbol_id")


def wants_type_pass(files: DataFrame, calls: DataFrame) -> DataFrame:
    """wanted, one row: mostly TypeScript, at least half of the calls methods, at least seven in ten of those unresolved. files: language; calls: category, callee_id."""
    langs = files.agg((F.avg((F.col("language") == "typescript").cast("int")) > 0.5).alias("mostly"))
    method = F.col("category") == "method"
    share = calls.agg((F.avg(method.cast("int")) >= 0.5).alias("many"), (F.avg(F.when(method, F.col("callee_id").isNull().cast("int"))) >= 0.7).alias("open"))
    return langs.crossJoin(share).select(F.coalesce(F.col("mostly") & F.col("many") & F.col("open"), F.lit(False)).alias("wanted"))
