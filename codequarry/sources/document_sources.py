"""Source files made from documents, one module a document and a test file for every fifth: what scanner and resolver read at the scale of a table.

A module imports the function of the document before it, calls it in its own, exports that and a class, and carries the document's text in a comment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.operators.extract import scan
from codequarry.sources.shared import exists, fingerprint_of, materialise, spread

#: Every so many documents have a test.
TESTED = 5


def _lines(*lines: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines])


def source_files(docs: DataFrame) -> DataFrame:
    """path, text: the files of documents (doc_id, lang, text). A null text is an empty comment; rows without a doc_id make no file."""
    named = lambda n: F.replace(n.cast("string"), F.lit("-"), F.lit("_"))
    rows = docs.where("doc_id IS NOT NULL").select(named(F.col("doc_id")).alias("i"), named(F.col("doc_id") - 1).alias("p"), F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % TESTED == 0).alias("tested"))
    i, p = F.col("i"), F.col("p")
    module = _lines(
        F.concat(F.lit("import { run"), p, F.lit(" } from './d"), p, F.lit("';")), F.concat(F.lit("// TODO: read "), F.col("lang")),
        F.concat(F.lit("export function run"), i, F.lit("(text) {")), F.concat(F.lit("  return run"), p, F.lit("(text);")), "}",
        F.concat(F.lit("export class Box"), i, F.lit(" {")), "  open() {", F.concat(F.lit("    return run"), i, F.lit("('x');")), "  }", "}",
        "/*", F.replace("text", F.lit("*/"), F.lit("* /")), "*/",
    )
    test = _lines(F.concat(F.lit("import { run"), i, F.lit(" } from '../src/d"), i, F.lit("';")), F.concat(F.lit("test('run "), i, F.lit("', () => {")), F.concat(F.lit("  run"), i, F.lit("('y');")), "});")
    one = F.struct(F.concat(F.lit("src/d"), i, F.lit(".ts")).alias("path"), module.alias("text"))
    other = F.struct(F.concat(F.lit("test/d"), i, F.lit(".test.ts")).alias("path"), test.alias("text"))
    return rows.select(F.inline(F.when(F.col("tested"), F.array(one, other)).otherwise(F.array(one))))


_scanned: dict[tuple[str, str, str], DataFrame] = {}


def scanned_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scanned files of the documents under sf_dir, written once and again only if they change."""
    path = f"{sf_dir}/documents.parquet"
    key = (spark.sparkContext.applicationId, sf_dir, fingerprint_of(spark, path))
    if key not in _scanned or not all(exists(spark, f) for f in _scanned[key].inputFiles()[:1]):
        docs = spark.read.parquet(path).select("doc_id", "lang", "text")
        _scanned[key] = materialise(scan(spread(source_files(docs), "path")), "scanned")
    return _scanned[key]


#: The modules in SQL: i and p name a document and the one before it, has says whether that is there, module, test and before are paths.
SOURCES_SQL = f"""
d AS (
  SELECT *, 'src/d' || i || '.ts' AS module, 'test/d' || i || '.test.ts' AS test, 'src/d' || p || '.ts' AS before
  FROM (SELECT replace(CAST(doc_id AS VARCHAR), '-', '_') AS i, replace(CAST(doc_id - 1 AS VARCHAR), '-', '_') AS p, coalesce(lang, 'none') AS lang,
               doc_id % {TESTED} = 0 AS tested, doc_id - 1 IN (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL) AS has
        FROM documents WHERE doc_id IS NOT NULL)),
calls AS (
  SELECT module AS file_path, 4 AS line, 'run' || p AS called_name, CASE WHEN has THEN 'imported' ELSE 'builtin' END AS category, module || ':run' || i || ':3' AS caller_id,
         CASE WHEN has THEN before || ':run' || p || ':3' END AS callee_id, CASE WHEN has THEN before END AS callee_file FROM d
  UNION ALL SELECT module, 8, 'run' || i, 'sameFile', module || ':open:7', module || ':run' || i || ':3', module FROM d
  UNION ALL SELECT test, 2, 'test', 'builtin', test || ':__module__:1', NULL, NULL FROM d WHERE tested
  UNION ALL SELECT test, 3, 'run' || i, 'imported', test || ':__module__:1', module || ':run' || i || ':3', module FROM d WHERE tested),
imports AS (
  SELECT module AS file_path, './d' || p AS specifier, CASE WHEN has THEN 'resolved' ELSE 'unresolved' END AS status, CASE WHEN has THEN before END AS target FROM d
  UNION ALL SELECT test, '../src/d' || i, 'resolved', module FROM d WHERE tested),
covered AS (
  SELECT module || ':run' || i || ':3' AS symbol_id, test || ':run ' || i || ':2' AS test_id, 'direct' AS coverage_type, 'high' AS confidence FROM d WHERE tested
  UNION ALL SELECT before || ':run' || p || ':3', test || ':file', 'indirect', 'low' FROM d WHERE tested AND has),
exported AS (SELECT module AS file_path, module || ':run' || i || ':3' AS symbol_id FROM d UNION ALL SELECT module, module || ':Box' || i || ':6' FROM d)
"""
