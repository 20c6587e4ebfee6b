"""Queries that gather and rank contribution candidates, and those over literal sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.operators import contribute as K
from codequarry.operators import extract as X
from codequarry.operators import graph as G
from codequarry.plans.spec import Specs
from codequarry.sources.graph_tables import GRAPH_SQL, Graph, table

specs = Specs()

_BUSY = "SELECT DISTINCT 'supplier:' || (user_id % 5) AS file_path FROM events WHERE event_type = 'purchase' AND event_id % 7 = 0"


@specs.query(
    f"WITH {GRAPH_SQL}, found AS ("
    " SELECT id, 'gap' AS source FROM symbols WHERE kind IN ('function', 'method', 'class') AND id NOT IN (SELECT from_id FROM tested_by)"
    " UNION SELECT id, 'undocumented' FROM symbols WHERE is_exported AND id NOT IN (SELECT from_id FROM documented_by)),"
    " cand AS (SELECT id AS target_id, string_agg(source, ',' ORDER BY source) AS sources, count(*) AS n FROM found GROUP BY id),"
    " fan AS (SELECT to_id, count(*) AS n FROM calls GROUP BY to_id),"
    " scored AS (SELECT c.target_id, c.sources, round(coalesce(f.n, 0)::DOUBLE / (coalesce(f.n, 0) + 5) - s.start_line / 50.0::DOUBLE + c.n, 6) AS score, CASE WHEN c.n >= 2 THEN 'high' ELSE 'medium' END AS confidence"
    f"  FROM cand AS c JOIN symbols AS s ON s.id = c.target_id LEFT JOIN fan AS f ON f.to_id = c.target_id WHERE s.file_path NOT IN (SELECT file_path FROM ({_BUSY})))"
    " SELECT CAST(row_number() OVER (ORDER BY score DESC, target_id) AS INTEGER) AS rank, * FROM (SELECT * FROM scored ORDER BY score DESC, target_id LIMIT 100)"
)
def contrib_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    symbols = g.symbols()
    found = K.candidates({"gap": G.coverage_gaps(symbols, g.tested_by(), limit=None), "undocumented": G.undocumented(symbols, g.documented_by())})
    fan = G.in_degree(g.calls())
    n = F.coalesce(F.col("n"), F.lit(0))
    parts = symbols.where("file_path IS NOT NULL").join(fan, "id", "left").select(F.col("id").alias("target_id"), "file_path", (n / (n + 5)).alias("impact"), (F.col("start_line") / F.lit(50.0)).alias("complexity"))
    busy = table(spark, sf_dir, "events").where("event_type = 'purchase' AND event_id % 7 = 0").select(F.concat(F.lit("supplier:"), (F.col("user_id") % 5).cast("string")).alias("file_path"))
    return K.rank(found, parts, busy)


_CHECKED = f"""
WITH {GRAPH_SQL}, found AS (
  SELECT id, 'gap' AS source FROM symbols WHERE kind IN ('function', 'method', 'class') AND id NOT IN (SELECT from_id FROM tested_by)
  UNION SELECT id, 'undocumented' FROM symbols WHERE is_exported AND id NOT IN (SELECT from_id FROM documented_by)),
cand AS (SELECT id AS target_id, string_agg(source, ',' ORDER BY source) AS sources, count(*) AS n_evidence FROM found GROUP BY id),
open_issues AS (SELECT DISTINCT 'supplier:' || (user_id % 10) AS file_path FROM events WHERE event_type = 'error'),
pulls AS (SELECT DISTINCT 'supplier:' || (user_id % 4) AS file_path FROM events WHERE event_type = 'signup'),
changed AS (SELECT DISTINCT 'supplier:' || (user_id % 5) AS file_path FROM events WHERE event_type = 'purchase' AND event_id % 7 = 0),
checked AS (
  SELECT c.*, s.name, s.kind, s.file_path, s.end_line - s.start_line + 1 AS lines, round(1 + (s.end_line - s.start_line + 1) / 25.0::DOUBLE, 2) AS effort_hours, true AS has_it,
         coalesce(s.file_path IN (SELECT file_path FROM open_issues), false) AS has_issue, coalesce(s.file_path IN (SELECT file_path FROM pulls), false) AS has_active_pull,
         coalesce(s.file_path IN (SELECT file_path FROM changed), false) AS recently_changed, coalesce(s.kind IN ('function', 'method'), false) AS fits_skills
  FROM cand AS c JOIN symbols AS s ON s.id = c.target_id),
judged AS (SELECT *, lines <= 200 AS bounded, effort_hours <= 4 AS fits_time, n_evidence > 0 AS has_evidence FROM checked),
valid AS (SELECT *, has_evidence AND bounded AND fits_skills AND fits_time AND NOT has_active_pull AND NOT recently_changed AS valid FROM judged)
"""


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    symbols = g.symbols().withColumn("language", F.lit("typescript"))
    found = K.candidates({"gap": G.coverage_gaps(symbols, g.tested_by(), limit=None), "undocumented": G.undocumented(symbols, g.documented_by())})
    events = table(spark, sf_dir, "events")
    at = lambda rows, n: rows.select(F.concat(F.lit("supplier:"), (F.col("user_id") % n).cast("string")).alias("file_path"))
    return K.validate(found, symbols, at(events.where("event_type = 'error'"), 10), at(events.where("event_type = 'signup'"), 4), at(events.where("event_type = 'purchase' AND event_id % 7 = 0"), 5))


@specs.query(_CHECKED + "SELECT target_id, has_it AS exists, has_evidence, has_issue, has_active_pull, recently_changed, bounded, fits_skills, fits_time, valid FROM valid")
def contrib_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).select("target_id", *K.CHECKS, "valid")


@specs.query(
    _CHECKED + "SELECT target_id, CASE WHEN contains(sources, 'gap') THEN 'Test ' ELSE 'Document ' END || name AS title, CASE WHEN contains(sources, 'gap') THEN 'test' ELSE 'documentation' END AS contribution_type,"
    " kind || ' ' || name || ' is named by: ' || sources AS problem, CASE WHEN lines <= 10 THEN 'easy' WHEN lines <= 50 THEN 'medium' ELSE 'hard' END AS difficulty, effort_hours,"
    " concat_ws(',', 'typescript', kind) AS required_skills, concat_ws(',', file_path, target_id) AS relevant, sources AS evidence, CASE WHEN n_evidence >= 2 THEN 'high' ELSE 'medium' END AS confidence,"
    " concat_ws(',', CASE WHEN has_issue THEN 'issue' END, CASE WHEN has_active_pull THEN 'pull request' END) AS related, valid FROM valid"
)
def contrib_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.described(_checked(spark, sf_dir))


@specs.query(
    "WITH issues AS (SELECT event_id AS issue_id, 'file:' || (user_id % 10) AS file FROM events WHERE event_type = 'error'),"
    " pulls AS (SELECT CASE WHEN event_id % 3 = 0 THEN event_id - 1 END AS issue_id, 'file:' || (user_id % 4) AS file FROM events WHERE event_type = 'signup')"
    " SELECT issue_id, issue_id IN (SELECT issue_id FROM pulls WHERE issue_id IS NOT NULL) AS linked, file IN (SELECT file FROM pulls) AS overlapping FROM issues"
)
def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    file = lambda n: F.concat(F.lit("file:"), (F.col("user_id") % n).cast("string")).alias("file")
    issues = events.where("event_type = 'error'").select(F.col("event_id").alias("issue_id"), file(10))
    pulls = events.where("event_type = 'signup'").select(F.when(F.col("event_id") % 3 == 0, F.col("event_id") - 1).alias("issue_id"), file(4))
    return K.conflicts(issues, pulls)


#: Literal sources without backslashes, so that every engine reads the same text.
SOURCES = {
    "src/store.ts": "import { read } from './disk';\nimport * as path from 'path';\n\nexport interface Options {\n  depth: number;\n}\n\n// TODO: cache the listing\nexport class Store {\n  async open(name) {\n    return read(path.join('data', name));\n  }\n}\n\nexport async function list(root) {\n  // FIXME hidden entries\n  return new Store().open(root);\n}\n",
    "src/disk.js": "export function read(name) { return name; } // NOTE: no retries\nclass Cache {}\nfunction helper() {}\nexport const limit = 3;\n// HACK\n// XXX: later\n",
    "docs/readme.md": "No code here. // TODOx is no marker's end: TODO is\n",
}
_SOURCES = "(VALUES " + ", ".join("('" + p + "', '" + t.replace("'", "''") + "')" for p, t in SOURCES.items()) + ") AS sources(path, text)"


def _sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SOURCES.items()), "path string, text string")


_KINDS = " UNION ALL ".join("SELECT path, '" + k + "' AS kind, regexp_extract_all(text, '" + p.replace("'", "''") + "', 1) AS names FROM " + _SOURCES for k, p in X.PATTERNS.items())


@specs.query(f"SELECT path, kind, CAST(unnest(range(len(names))) AS INTEGER) AS place, unnest(names) AS name FROM ({_KINDS})")
def regex_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.pattern_facts(_sources(spark))


@specs.query(
    "WITH l AS (SELECT path, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM " + _SOURCES + "),"
    " m AS (SELECT path, CAST(line AS INTEGER) AS line, regexp_extract(content, '" + X.MARKER.replace("'", "''") + "', 1) AS marker_type, trim(regexp_extract(content, '" + X.MARKER.replace("'", "''") + "', 2)) AS text FROM l)"
    " SELECT *, path || ':' || marker_type || ':' || line AS marker_id FROM m WHERE marker_type <> ''"
)
def todo_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.markers(_sources(spark))


@specs.query("SELECT label, round(rows * 1000.0::DOUBLE / ms, 3) AS rows_per_second FROM (VALUES ('small', 1938, 122), ('medium', 10300, 445), ('none', 0, 5)) AS loads(label, rows, ms)")
def insert_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    loads = spark.createDataFrame([("small", 1938, 122), ("medium", 10300, 445), ("none", 0, 5)], "label string, rows int, ms int")
    return loads.select("label", F.round(F.col("rows") * 1000.0 / F.col("ms"), 3).alias("rows_per_second"))
