"""Resolver queries over the scenario facts, and the same resolution in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.operators import resolve as R
from codequarry.plans.spec import Specs
from codequarry.sources.scenarios import FACTS_SQL, scenario_facts

specs = Specs()

_FACTS = ",\n".join(f"{name} AS ({sql})" for name, sql in FACTS_SQL.items())
_SPECIFIERS = r"""
used AS (SELECT file_path, specifier FROM imports UNION SELECT file_path, source_specifier FROM exports WHERE source_specifier IS NOT NULL),
joined AS (SELECT *, replace(regexp_replace(file_path, '[^/]*$', '') || specifier, '/./', '/') AS j FROM used WHERE starts_with(specifier, './') OR starts_with(specifier, '../')),
based AS (SELECT file_path, specifier, regexp_replace(regexp_replace(j, '[^/]+/\.\./', ''), '[^/]+/\.\./', '') AS base FROM joined),
ended AS (SELECT *, regexp_extract(base, '[^/](\.[^./]*)$', 1) AS ext FROM based),
tried AS (SELECT file_path, specifier, CASE WHEN ext = '' THEN list_concat(list_transform(['.ts', '.tsx', '.js', '.jsx'], lambda e: base || e), list_transform(['.ts', '.tsx', '.js', '.jsx'], lambda e: base || '/index' || e))
  WHEN ext = '.js' THEN [base, regexp_replace(base, '\.js$', '.ts'), regexp_replace(base, '\.js$', '.tsx')]
  WHEN ext IN ('.mjs', '.cjs') THEN [base, regexp_replace(base, '\.[mc]js$', '.ts')] ELSE [base] END AS c FROM ended),
placed AS (SELECT file_path, specifier, unnest(c) AS target, generate_subscripts(c, 1) AS place FROM tried),
specifiers AS (SELECT file_path, specifier, arg_min(target, place) AS target FROM placed WHERE target IN (SELECT path FROM files) GROUP BY file_path, specifier)
"""
_OWN = """
own_rows AS (SELECT e.file_path, e.symbol_name, e.export_type, e.ord AS seen, arg_min(s.symbol_id, s.ord) AS symbol_id FROM exports AS e JOIN symbols AS s ON s.file_path = e.file_path
  AND (s.name = coalesce(e.source_name, e.symbol_name) OR (e.export_type = 'default' AND s.name = e.symbol_name)) WHERE e.source_specifier IS NULL AND e.symbol_name <> '*' GROUP BY ALL),
own AS (SELECT file_path, symbol_name AS name, symbol_id, 0 AS star, -seen AS rank FROM own_rows UNION SELECT file_path, 'default', symbol_id, 0, -seen FROM own_rows WHERE export_type = 'default'),
passed_on AS (SELECT e.file_path, s.target, e.symbol_name, coalesce(e.source_name, e.symbol_name) AS source_name, e.ord AS seen FROM exports AS e JOIN specifiers AS s ON s.file_path = e.file_path AND s.specifier = e.source_specifier),
m0 AS (SELECT file_path, name, arg_min(symbol_id, (star, rank, symbol_id)) AS symbol_id FROM own GROUP BY file_path, name)
"""
_ROUND = """
m{b} AS (SELECT file_path, name, arg_min(symbol_id, (star, rank, symbol_id)) AS symbol_id FROM (
  SELECT * FROM own
  UNION ALL SELECT p.file_path, p.symbol_name, m.symbol_id, 0, -p.seen FROM passed_on AS p JOIN m{a} AS m ON m.file_path = p.target AND m.name = p.source_name WHERE p.symbol_name <> '*'
  UNION ALL SELECT p.file_path, m.name, m.symbol_id, 1, p.seen FROM passed_on AS p JOIN m{a} AS m ON m.file_path = p.target AND m.name <> 'default' WHERE p.symbol_name = '*') GROUP BY file_path, name)
"""
_EXPORT_MAP = ", ".join([_OWN, *[_ROUND.format(a=k, b=k + 1) for k in range(4)], "export_map AS (SELECT * FROM m4)"])
_CALLS = """
local_s AS (SELECT file_path, name, arg_min(symbol_id, ord) AS local_id, arg_min(kind, ord) AS local_kind FROM symbols GROUP BY file_path, name),
mapped AS (SELECT file_path, stmt, specifier, local, arg_min(CASE WHEN is_default THEN 'default' ELSE imported END, ord) AS name FROM imports GROUP BY file_path, stmt, specifier, local),
bound AS (SELECT file_path, local, symbol_id AS bound_id, kind AS bound_kind FROM (
  SELECT m.file_path, m.local, x.symbol_id, s.kind, row_number() OVER (PARTITION BY m.file_path, m.local ORDER BY m.stmt) AS n
  FROM mapped AS m JOIN specifiers AS p ON p.file_path = m.file_path AND p.specifier = m.specifier JOIN export_map AS x ON x.file_path = p.target AND x.name = m.name JOIN symbols AS s ON s.symbol_id = x.symbol_id) WHERE n = 1),
args AS (SELECT DISTINCT file_path, unnest(string_split(passed, ',')) AS name FROM calls),
inner_m AS (SELECT c.file_path, c.name AS class_name, c.ord AS class_ord, m.name AS method, arg_min(m.symbol_id, m.ord) AS symbol_id FROM symbols AS c JOIN symbols AS m ON m.file_path = c.file_path AND m.kind = 'method'
  AND m.start_line >= c.start_line AND m.end_line <= c.end_line WHERE c.kind = 'class' GROUP BY ALL),
this_m AS (SELECT file_path, method, arg_min(symbol_id, class_ord) AS this_id FROM inner_m GROUP BY file_path, method),
classes AS (SELECT file_path, name, min(ord) AS class_ord FROM symbols WHERE kind = 'class' GROUP BY file_path, name),
spaces AS (SELECT i.file_path, i.local, x.name AS member, x.symbol_id AS space_id FROM (SELECT file_path, local, arg_min(specifier, stmt) AS specifier FROM imports WHERE is_namespace GROUP BY file_path, local) AS i
  JOIN specifiers AS p ON p.file_path = i.file_path AND p.specifier = i.specifier JOIN export_map AS x ON x.file_path = p.target JOIN symbols AS s ON s.symbol_id = x.symbol_id AND s.kind IN ('function', 'method', 'const')),
cut AS (SELECT *, string_split(called_name, '.')[1] AS base, CASE WHEN contains(called_name, '.') THEN substr(called_name, strpos(called_name, '.') + 1) END AS member FROM calls),
looked AS (SELECT c.*, l.local_id, l.local_kind, b.bound_id, b.bound_kind, a.name AS passed_name, t.this_id, k.class_ord, st.symbol_id AS static_id, sp.space_id FROM cut AS c
  LEFT JOIN local_s AS l ON l.file_path = c.file_path AND l.name = c.called_name LEFT JOIN bound AS b ON b.file_path = c.file_path AND b.local = c.called_name
  LEFT JOIN args AS a ON a.file_path = c.file_path AND a.name = c.called_name LEFT JOIN this_m AS t ON t.file_path = c.file_path AND t.method = c.member
  LEFT JOIN classes AS k ON k.file_path = c.file_path AND k.name = c.base LEFT JOIN inner_m AS st ON st.file_path = c.file_path AND st.class_ord = k.class_ord AND st.method = c.member
  LEFT JOIN spaces AS sp ON sp.file_path = c.file_path AND sp.local = c.base AND sp.member = c.member),
judged AS (SELECT *, CASE call_type WHEN 'dynamic' THEN 'dynamic' WHEN 'method' THEN 'method' ELSE CASE WHEN local_id IS NOT NULL THEN 'sameFile' WHEN bound_id IS NOT NULL THEN 'imported' WHEN passed_name IS NOT NULL THEN 'callback' ELSE 'builtin' END END AS category,
  CASE WHEN call_type = 'direct' THEN CASE WHEN local_kind IN ('function', 'method', 'const') THEN local_id WHEN bound_kind IN ('function', 'method', 'const') THEN bound_id END
       WHEN call_type = 'method' AND member IS NOT NULL THEN CASE WHEN base = 'this' THEN this_id WHEN class_ord IS NOT NULL THEN static_id ELSE space_id END END AS callee_id,
  CASE WHEN call_type = 'direct' OR (base <> 'this' AND class_ord IS NULL) THEN 'high' ELSE 'medium' END AS trust FROM looked),
resolved AS (SELECT j.file_path, j.ord, j.called_name, j.call_type, j.line, j.category,
  coalesce((SELECT arg_max(s.symbol_id, (s.start_line, s.ord)) FROM symbols AS s WHERE s.file_path = j.file_path AND j.line BETWEEN s.start_line AND s.end_line), j.file_path || ':__module__:1') AS caller_id,
  j.callee_id, (SELECT s.file_path FROM symbols AS s WHERE s.symbol_id = j.callee_id) AS callee_file, CASE WHEN callee_id IS NOT NULL THEN trust END AS confidence,
  CASE WHEN callee_id IS NULL AND call_type <> 'dynamic' THEN CASE WHEN call_type = 'method' OR contains(called_name, '.') THEN 'ambiguous' ELSE 'not_found' END END AS error FROM judged AS j)
"""
_TESTED = """
made AS (SELECT * FROM resolved WHERE callee_id IS NOT NULL AND file_path IN (SELECT path FROM files WHERE is_test)),
tested AS (
  SELECT callee_id AS symbol_id, coalesce((SELECT arg_max(t.test_id, (t.start_line, t.ord)) FROM tests AS t WHERE t.file_path = m.file_path AND m.line BETWEEN t.start_line AND t.end_line), m.file_path || ':file') AS test_id, 'direct' AS coverage_type, confidence
  FROM made AS m WHERE callee_file NOT IN (SELECT path FROM files WHERE is_test)
  UNION ALL SELECT r.callee_id, d.file_path || ':file', 'indirect', 'low' FROM (SELECT DISTINCT file_path, callee_id FROM made) AS d JOIN resolved AS r ON r.caller_id = d.callee_id AND r.callee_id IS NOT NULL
  WHERE r.callee_file NOT IN (SELECT path FROM files WHERE is_test))
"""
_ERRORS = """
export_rows AS (SELECT e.*, m.symbol_id FROM exports AS e LEFT JOIN export_map AS m ON m.file_path = e.file_path AND m.name = e.symbol_name WHERE e.source_specifier IS NULL AND e.symbol_name <> '*'),
statements AS (SELECT DISTINCT file_path, stmt, specifier, line FROM imports),
import_rows AS (SELECT s.*, CASE WHEN NOT (starts_with(s.specifier, './') OR starts_with(s.specifier, '../')) THEN 'external' WHEN p.target IS NOT NULL THEN 'resolved' ELSE 'unresolved' END AS status, p.target FROM statements AS s LEFT JOIN specifiers AS p USING (file_path, specifier)),
errors AS (
  SELECT 'ambiguous_symbol' AS type, file_path AS file, line, 'Exported symbol ''' || symbol_name || ''' not found in file' AS message, 'not_found' AS category FROM export_rows WHERE symbol_id IS NULL
  UNION ALL SELECT 'unresolved_import', file_path, line, 'Could not resolve import ''' || specifier || '''', 'not_found' FROM import_rows WHERE status = 'unresolved'
  UNION ALL SELECT 'unresolved_call', file_path, line, 'Could not resolve call to ''' || called_name || '''', error FROM resolved WHERE error IS NOT NULL)
"""


def _sql(body: str) -> str:
    return f"WITH {', '.join([_FACTS, _SPECIFIERS, _EXPORT_MAP, _CALLS, _TESTED, _ERRORS])} {body}"


def _resolver(spark: SparkSession) -> R.Resolver:
    return R.Resolver(scenario_facts(spark))


@specs.query(_sql("SELECT * FROM specifiers"))
def spec_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolver(spark).specifiers()


@specs.query(_sql("SELECT * FROM export_map"))
def export_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolver(spark).export_map


@specs.query(_sql("SELECT file_path, line, symbol_name, export_type, symbol_id FROM export_rows"))
def exports_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolver(spark).export_edges().drop("ord")


@specs.query(_sql("SELECT * FROM import_rows"))
def imports_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolver(spark).import_edges()


@specs.query(_sql("SELECT * FROM resolved"))
def calls_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolver(spark).calls


@specs.query(_sql("SELECT category, count(*) AS total, count(callee_id) AS resolved, count(*) FILTER (WHERE confidence = 'high') AS high, count(*) FILTER (WHERE confidence = 'medium') AS medium, count(*) FILTER (WHERE callee_file <> file_path) AS cross_file FROM resolved GROUP BY category"))
def call_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, count = _resolver(spark).calls, F.count_if
    return calls.groupBy("category").agg(F.count(F.lit(1)).alias("total"), F.count("callee_id").alias("resolved"), count(F.col("confidence") == "high").alias("high"), count(F.col("confidence") == "medium").alias("medium"), count(F.col("callee_file") != F.col("file_path")).alias("cross_file"))


@specs.query(_sql("SELECT * FROM tested"))
def tested_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolver(spark).tested_by()


@specs.query(_sql("SELECT * FROM errors"))
def resolver_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolver(spark).errors()


@specs.query(_sql("SELECT CASE WHEN type = 'unresolved_import' THEN 'parser limitation' WHEN type = 'ambiguous_symbol' THEN 'resolver limitation' WHEN category = 'ambiguous' THEN 'ambiguous code' ELSE 'resolver limitation' END AS failure, count(*) AS n FROM errors GROUP BY failure"))
def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.failure_classes(_resolver(spark).errors())


@specs.query(_sql("SELECT CASE WHEN type = 'unresolved_call' THEN regexp_replace(message, ':[0-9]+$', '') ELSE message END AS message, count(*) AS n FROM errors GROUP BY 1 ORDER BY n DESC, message LIMIT 6"))
def top_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_unresolved(_resolver(spark).errors())


@specs.query(_sql("SELECT rel_type, count(*) AS n FROM (SELECT 'EXPORTS' AS rel_type FROM export_rows WHERE symbol_id IS NOT NULL UNION ALL SELECT 'IMPORTS' FROM import_rows WHERE status = 'resolved' UNION ALL SELECT 'CALLS' FROM resolved WHERE callee_id IS NOT NULL UNION ALL SELECT 'TESTED_BY' FROM tested) GROUP BY rel_type"))
def resolved_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolver(spark).relationships().groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"))


@specs.query(_sql("SELECT symbol_id, symbol_id IN (SELECT symbol_id FROM export_rows WHERE symbol_id IS NOT NULL) AS is_exported FROM symbols"))
def exported_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolver(spark).exported().select("symbol_id", "is_exported")
