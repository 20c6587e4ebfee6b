"""Schemas of the engine's tables, the values that columns can take, and a check of both."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of each table, as DDL.
TABLES = {
    "files": "path string, language string, hash string, size long, is_test boolean, is_generated boolean",
    "symbols": "symbol_id string, name string, kind string, file_path string, start_line int, end_line int, signature string, complexity int, is_exported boolean",
    "tests": "test_id string, test_name string, file_path string, test_framework string, start_line int, end_line int",
    "todo_markers": "marker_id string, text string, marker_type string, file_path string, line int",
    "imports": "file_path string, specifier string, line int, stmt int, local string, imported string, is_default boolean, is_namespace boolean, ord int",
    "exports": "file_path string, symbol_name string, export_type string, line int, source_specifier string, source_name string, ord int",
    "calls": "file_path string, called_name string, call_type string, line int, arguments array<string>, ord int",
    "parse_errors": "file string, line int, message string, fatal boolean",
    "nodes": "id string, node_type string, name string, kind string, file_path string, start_line int, end_line int, is_exported boolean, is_test boolean, props map<string,string>",
    "relationships": "from_id string, to_id string, rel_type string, call_site_line int, props map<string,string>",
    "resolver_errors": "type string, file string, line int, message string, category string",
    "repository_files": "snapshot_id string, path string, type string, size long, hash string, language string, is_binary boolean, analyzable boolean",
}
#: What columns with closed domains can hold.
DOMAINS = {
    "language": ("javascript", "typescript", "unknown"),
    "kind": ("function", "method", "class", "interface", "const", "enum", "module"),
    "rel_type": ("CONTAINS", "IMPORTS", "EXPORTS", "CALLS", "TESTED_BY"),
    "import_type": ("relative", "package", "absolute"),
    "export_type": ("named", "default"),
    "call_type": ("direct", "method", "callback", "dynamic"),
    "coverage_type": ("direct", "indirect"),
    "confidence": ("high", "medium", "low"),
    "test_framework": ("jest", "mocha", "vitest", "unknown"),
    "marker_type": ("TODO", "FIXME", "HACK", "XXX", "NOTE"),
    "node_type": ("RepositorySnapshot", "Directory", "File", "Symbol", "Test", "TodoMarker"),
}


def symbol_id(path: Column, name: Column, line: Column) -> Column:
    return F.concat_ws(":", path, name, line.cast("string"))


def outside_domains(df: DataFrame) -> DataFrame:
    """The rows of df with a value outside its column's domain; nulls are inside."""
    bad = [F.col(c).isNotNull() & ~F.col(c).isin(*DOMAINS[c]) for c in df.columns if c in DOMAINS]
    return df.where(reduce(Column.__or__, bad, F.lit(False)))
