"""Queries that scan, resolve and assemble the source files made from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.operators.assemble import graph_of
from codequarry.operators.extract import facts
from codequarry.operators.resolve import Resolver
from codequarry.plans.spec import Specs
from codequarry.sources.document_sources import SOURCES_SQL, scanned_sources

specs = Specs()


def _sql(body: str) -> str:
    return f"WITH {SOURCES_SQL} {body}"


def _resolver(spark: SparkSession, sf_dir: str) -> Resolver:
    return Resolver(facts(scanned_sources(spark, sf_dir)))


@specs.query(_sql(
    "SELECT module AS file_path, 'run' || i AS name, 'function' AS kind, 3 AS start_line, 5 AS end_line, true AS is_exported FROM d"
    " UNION ALL SELECT module, 'Box' || i, 'class', 6, 10, true FROM d UNION ALL SELECT module, 'open', 'method', 7, 9, false FROM d"
))
def src_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolver(spark, sf_dir).exported().select("file_path", "name", "kind", "start_line", "end_line", "is_exported")


@specs.query(_sql("SELECT test || ':run ' || i || ':2' AS test_id, test AS file_path, 'run ' || i AS test_name, 2 AS start_line, 4 AS end_line FROM d WHERE tested"))
def src_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(scanned_sources(spark, sf_dir)).tests.select("test_id", "file_path", "test_name", "start_line", "end_line")


@specs.query(_sql("SELECT module AS path, 'TODO' AS marker_type, 'read ' || lang AS text, 2 AS line FROM d"))
def src_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned_sources(spark, sf_dir).select("path", F.inline("markers")).select("path", "marker_type", "text", "line")


@specs.query(_sql("SELECT file_path, specifier, 1 AS line, status, target FROM imports"))
def src_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolver(spark, sf_dir).import_edges().select("file_path", "specifier", "line", "status", "target")


@specs.query(_sql("SELECT file_path, symbol_id FROM exported"))
def src_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolver(spark, sf_dir).export_edges().select("file_path", "symbol_id")


@specs.query(_sql("SELECT file_path, line, called_name, category, caller_id, callee_id, CASE WHEN callee_id IS NOT NULL THEN 'high' END AS confidence, CASE WHEN callee_id IS NULL THEN 'not_found' END AS error FROM calls"))
def src_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolver(spark, sf_dir).calls.select("file_path", "line", "called_name", "category", "caller_id", "callee_id", "confidence", "error")


@specs.query(_sql("SELECT * FROM covered"))
def src_tested_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolver(spark, sf_dir).tested_by()


@specs.query(_sql(
    "SELECT 'unresolved_call' AS type, file_path AS file, line, 'Could not resolve call to ''' || called_name || '''' AS message, 'not_found' AS category FROM calls WHERE callee_id IS NULL"
    " UNION ALL SELECT 'unresolved_import', file_path, 1, 'Could not resolve import ''' || specifier || '''', 'not_found' FROM imports WHERE status = 'unresolved'"
))
def src_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolver(spark, sf_dir).errors()


@specs.query(_sql(
    "SELECT counter, count(*) AS n FROM ("
    " SELECT 'calls.' || category || '.total' AS counter FROM calls UNION ALL SELECT 'calls.' || category || '.resolved' FROM calls WHERE callee_id IS NOT NULL"
    " UNION ALL SELECT 'calls.high' FROM calls WHERE callee_id IS NOT NULL UNION ALL SELECT 'calls.cross_file' FROM calls WHERE callee_file <> file_path"
    " UNION ALL SELECT 'imports.' || status FROM imports UNION ALL SELECT 'exports.local' FROM exported) GROUP BY counter"
))
def src_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolver(spark, sf_dir).counters()


@specs.query(_sql(
    "SELECT file_path AS from_id, symbol_id AS to_id, 'EXPORTS' AS rel_type, CAST(NULL AS INTEGER) AS call_site_line FROM exported"
    " UNION ALL SELECT file_path, target, 'IMPORTS', NULL FROM imports WHERE status = 'resolved'"
    " UNION ALL SELECT caller_id, callee_id, 'CALLS', line FROM calls WHERE callee_id IS NOT NULL UNION ALL SELECT symbol_id, test_id, 'TESTED_BY', NULL FROM covered"
))
def src_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_of("documents", scanned_sources(spark, sf_dir))[1]


@specs.query(_sql(
    "SELECT node_type, kind, count(*) AS n FROM (SELECT 'RepositorySnapshot' AS node_type, NULL AS kind"
    " UNION ALL SELECT 'File', NULL FROM d UNION ALL SELECT 'File', NULL FROM d WHERE tested UNION ALL SELECT 'Symbol', unnest(['function', 'class', 'method']) FROM d"
    " UNION ALL SELECT 'Test', NULL FROM d WHERE tested UNION ALL SELECT 'TodoMarker', 'TODO' FROM d"
    " UNION ALL SELECT 'Symbol', NULL FROM d, (VALUES (':__module__:1', true), (':file', false)) AS t(tail, always) WHERE tested AND (always OR has)) GROUP BY node_type, kind"
))
def src_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_of("documents", scanned_sources(spark, sf_dir))[0].groupBy("node_type", "kind").agg(F.count(F.lit(1)).alias("n"))
