"""Queries over documents as files: chunks, retrieval, its evaluation, classification and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions import code as C
from codequarry.functions import text as T
from codequarry.operators import evaluate as E
from codequarry.operators import manifest as M
from codequarry.operators import retrieval as R
from codequarry.plans.spec import Specs
from codequarry.sources.graph_tables import table
from codequarry.sources.shared import exists, fingerprint_of, materialise, spread

specs = Specs()

# Documents are files; benchmark items are the queries. A document is gold for a query if it holds one of the query's sentences of 30 signs or more.
_TOKENS = "list_filter(string_split_regex(regexp_replace(lower(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda t: length(t) > 1)"
_ALNUM = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
_GRAMS = "list_transform(range(1, greatest(length({0}) - 1, 1)), lambda i: substr({0}, i, 3))"
_CHUNKS = """
lines AS (SELECT 'doc' || doc_id AS path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
counted AS (SELECT *, len(string_split_regex(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '\\s+')) AS w FROM lines),
fold(path, i, acc, k) AS (
  SELECT path, i, w, 0 FROM counted WHERE i = 1
  UNION ALL SELECT c.path, c.i, CASE WHEN f.acc >= 300 THEN c.w ELSE f.acc + c.w END, CASE WHEN f.acc >= 300 THEN f.k + 1 ELSE f.k END
  FROM fold AS f JOIN counted AS c ON c.path = f.path AND c.i = f.i + 1),
chunks AS (
  SELECT l.path || ':' || min(l.i) AS chunk_id, l.path AS file_path, CAST(min(l.i) AS INTEGER) AS start_line, CAST(max(l.i) AS INTEGER) AS end_line, string_agg(l.line, chr(10) ORDER BY l.i) AS text
  FROM lines AS l JOIN fold AS f ON f.path = l.path AND f.i = l.i GROUP BY l.path, f.k)
"""
_QUERIES = "queries AS (SELECT item_id AS query_id, text FROM benchmark)"
_KEYWORD = f"""
terms AS (SELECT chunk_id, unnest({_TOKENS.format("text")}) AS term FROM chunks),
norms AS (SELECT chunk_id, sqrt(count(*)) AS norm FROM terms GROUP BY chunk_id),
posts AS (SELECT chunk_id, term, count(*) AS tf FROM terms GROUP BY chunk_id, term),
idf AS (SELECT term, count(*) AS df, ln((SELECT count(*) FROM chunks)::DOUBLE / count(*)) AS idf FROM posts GROUP BY term),
asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_TOKENS.format("text")}) AS term FROM queries) GROUP BY query_id, term),
kw_scores AS (SELECT a.query_id, p.chunk_id, round(sum(a.qtf * p.tf * idf.idf) / n.norm, 6) AS score
  FROM asked AS a JOIN posts AS p USING (term) JOIN idf USING (term) JOIN norms AS n USING (chunk_id) GROUP BY a.query_id, p.chunk_id, n.norm),
kw AS (SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, score, 'keyword' AS method FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM kw_scores WHERE score > 0) WHERE rank <= 10)
"""
_SEMANTIC = f"""
grams AS (SELECT chunk_id, unnest({_GRAMS.format("s")}) AS term FROM (SELECT chunk_id, {_ALNUM.format("text")} AS s FROM chunks)),
gnorms AS (SELECT chunk_id, sqrt(count(*)) AS norm FROM grams GROUP BY chunk_id),
gposts AS (SELECT DISTINCT chunk_id, term FROM grams),
gidf AS (SELECT term, count(*) AS df, ln((SELECT count(*) FROM chunks)::DOUBLE / count(*)) AS idf FROM gposts GROUP BY term),
gasked AS (SELECT query_id, unnest({_GRAMS.format("s")}) AS term FROM (SELECT query_id, {_ALNUM.format("text")} AS s FROM queries)
  UNION SELECT query_id, unnest({_GRAMS.format("s")}) FROM (SELECT query_id, {_ALNUM.format("array_to_string(" + _TOKENS.format("text") + ", ' ')")} AS s FROM queries)),
sm_scores AS (SELECT a.query_id, p.chunk_id, round(sum(gidf.idf) / n.norm, 6) AS score
  FROM gasked AS a JOIN gposts AS p USING (term) JOIN gidf USING (term) JOIN gnorms AS n USING (chunk_id) GROUP BY a.query_id, p.chunk_id, n.norm),
sm AS (SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, score, 'semantic' AS method FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sm_scores WHERE score > 0) WHERE rank <= 10)
"""
_GOLD = """
said AS (SELECT 'doc' || doc_id AS file_path, unnest(string_split_regex(text, '[.\\n]\\s*')) AS s FROM documents),
asked_s AS (SELECT query_id, unnest(string_split_regex(text, '[.\\n]\\s*')) AS s FROM queries),
gold AS (SELECT DISTINCT q.query_id, d.file_path FROM asked_s AS q JOIN said AS d USING (s) WHERE length(s) >= 30)
"""


def _metrics(name: str, found: str, k: int) -> str:
    return f"""
{name}_top AS (SELECT query_id, rank, regexp_replace(chunk_id, ':[0-9]+$', '') AS file_path FROM {found} WHERE rank <= {k}),
{name} AS (SELECT g.query_id, count(DISTINCT CASE WHEN t.file_path IS NOT NULL THEN g.file_path END) AS hits,
  CASE WHEN max(s.seen) > 0 THEN count(DISTINCT CASE WHEN t.file_path IS NOT NULL THEN g.file_path END)::DOUBLE / max(s.seen) END AS p,
  count(DISTINCT CASE WHEN t.file_path IS NOT NULL THEN g.file_path END)::DOUBLE / count(DISTINCT g.file_path) AS r
  FROM gold AS g LEFT JOIN {name}_top AS t ON t.query_id = g.query_id AND t.file_path = g.file_path
  LEFT JOIN (SELECT query_id, count(*) AS seen FROM {name}_top GROUP BY query_id) AS s ON s.query_id = g.query_id GROUP BY g.query_id)
"""


def _sql(body: str, *parts: str) -> str:
    return f"WITH RECURSIVE {', '.join(parts)} {body}"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("path"), "text")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = lambda df, key: df.select(key, F.explode(F.split("text", r"[.\n]\s*")).alias("s")).where(F.length("s") >= 30)
    return said(queries(spark, sf_dir), "query_id").join(said(documents(spark, sf_dir).withColumnRenamed("path", "file_path"), "file_path"), "s").select("query_id", "file_path").distinct()


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.chunk(documents(spark, sf_dir))


_kept: dict[tuple[str, str, str], DataFrame] = {}


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks' tokens, written once and again only if the documents change. Their 3-grams, several times the texts, aren't kept."""
    key = (spark.sparkContext.applicationId, sf_dir, fingerprint_of(spark, f"{sf_dir}/documents.parquet"))
    if key not in _kept or not all(exists(spark, f) for f in _kept[key].inputFiles()[:1]):
        _kept[key] = materialise(R.split_tokens(_chunks(spark, sf_dir)), "chunk-tokens")
    return _kept[key]


def _files(found: DataFrame) -> DataFrame:
    return found.withColumn("file_path", F.regexp_replace("chunk_id", ":[0-9]+$", ""))


@specs.query(_sql("SELECT * FROM chunks", _CHUNKS))
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir)


@specs.query(_sql("SELECT term, df, round(idf, 6) AS idf FROM idf", _CHUNKS, _QUERIES, _KEYWORD))
def tokens_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chunks(spark, sf_dir)
    return R.inverse_frequencies(R.postings(c, T.tokens(F.col("text"))), c).select("term", "df", F.round("idf", 6).alias("idf"))


@specs.query(_sql("SELECT term, df, round(idf, 6) AS idf FROM gidf", _CHUNKS, _QUERIES, _SEMANTIC))
def ngram_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chunks(spark, sf_dir)
    return R.inverse_frequencies(R.postings(c, T.ngrams(F.col("text"))), c).select("term", "df", F.round("idf", 6).alias("idf"))


@specs.query(_sql("SELECT * FROM kw", _CHUNKS, _QUERIES, _KEYWORD))
def kw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.keyword_search(_tokens(spark, sf_dir), queries(spark, sf_dir))


@specs.query(_sql("SELECT * FROM sm", _CHUNKS, _QUERIES, _SEMANTIC))
def sem_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ngram_search(_chunks(spark, sf_dir), queries(spark, sf_dir))


_PMI = f"""
words AS (SELECT DISTINCT chunk_id, unnest({_TOKENS.format("text")}) AS term FROM chunks),
wdf AS (SELECT term, count(*) AS df FROM words GROUP BY term),
qterms AS (SELECT DISTINCT query_id, unnest({_TOKENS.format("text")}) AS query_term FROM queries),
pairs AS (SELECT a.term AS query_term, b.term, count(*) AS c FROM words AS a JOIN words AS b ON a.chunk_id = b.chunk_id AND a.term <> b.term WHERE a.term IN (SELECT query_term FROM qterms) GROUP BY a.term, b.term),
pmi AS (SELECT p.query_term, p.term, round(log2(greatest(p.c / n.n, 2.220446049250313e-16) / greatest((x.df / n.n) * (y.df / n.n), 2.220446049250313e-16)), 6) AS pmi
  FROM pairs AS p JOIN wdf AS x ON x.term = p.query_term JOIN wdf AS y ON y.term = p.term, (SELECT count(*)::DOUBLE AS n FROM chunks) AS n),
near AS (SELECT q.query_id, p.* FROM qterms AS q JOIN pmi AS p USING (query_term) WHERE p.pmi > 1.5 AND p.pmi < 20 AND NOT EXISTS (SELECT 1 FROM qterms AS z WHERE z.query_id = q.query_id AND z.query_term = p.term)),
expansions AS (SELECT query_id, CAST(rank AS INTEGER) AS rank, term, query_term, pmi FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pmi DESC, term, query_term) AS rank FROM near) WHERE rank <= 12)
"""


@specs.query(_sql("SELECT * FROM expansions", _CHUNKS, _QUERIES, _PMI))
def pmi_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.expansions(_tokens(spark, sf_dir), queries(spark, sf_dir))


_EXPANDED = "plain AS (SELECT item_id AS query_id, text FROM benchmark), queries AS (SELECT p.query_id, concat_ws(' ', p.text, (SELECT string_agg(term, ' ' ORDER BY rank) FROM expansions AS e WHERE e.query_id = p.query_id)) AS text FROM plain AS p)"


@specs.query(_sql("SELECT * FROM sm", _CHUNKS, _QUERIES.replace("queries AS", "asked_queries AS"), _PMI.replace("FROM queries", "FROM asked_queries"), _EXPANDED, _SEMANTIC))
def sem_search_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, q = _chunks(spark, sf_dir), queries(spark, sf_dir)
    return R.ngram_search(c, R.expanded(q, R.expansions(_tokens(spark, sf_dir), q)))


_HYBRID = """
parts AS (SELECT query_id, chunk_id, score / max(score) OVER (PARTITION BY query_id) * 0.5 AS part FROM kw UNION ALL SELECT query_id, chunk_id, score / max(score) OVER (PARTITION BY query_id) * 0.5 FROM sm),
mixed AS (SELECT query_id, chunk_id, round(sum(part), 6) AS score FROM parts GROUP BY query_id, chunk_id)
"""


@specs.query(_sql("SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, score, 'hybrid' AS method FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM mixed) WHERE rank <= 10", _CHUNKS, _QUERIES, _KEYWORD, _SEMANTIC, _HYBRID))
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.hybrid(kw_search(spark, sf_dir), sem_search(spark, sf_dir))


@specs.query(_sql("SELECT a.query_id, round(a.p, 6) AS p1, round(b.p, 6) AS p5, round(c.r, 6) AS r10 FROM k1 AS a JOIN k5 AS b USING (query_id) JOIN k10 AS c USING (query_id)", _CHUNKS, _QUERIES, _KEYWORD, _GOLD, _metrics("k1", "kw", 1), _metrics("k5", "kw", 5), _metrics("k10", "kw", 10)))
def pk_rk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, g = _files(kw_search(spark, sf_dir)), gold(spark, sf_dir)
    p1, p5 = (E.at_k(found, g, k).select("query_id", F.round("p", 6).alias(f"p{k}")) for k in (1, 5))
    return p1.join(p5, "query_id").join(E.at_k(found, g, 10).select("query_id", F.round("r", 6).alias("r10")), "query_id")


@specs.query(_sql("SELECT count(*) AS queries, round(avg(p), 6) AS p5, round(avg(r), 6) AS r5 FROM k5", _CHUNKS, _QUERIES, _KEYWORD, _GOLD, _metrics("k5", "kw", 5)))
def mean_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = E.at_k(_files(kw_search(spark, sf_dir)), gold(spark, sf_dir), 5)
    return scores.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("p"), 6).alias("p5"), F.round(F.avg("r"), 6).alias("r5"))


_TYPES = "types AS (SELECT query_id, CASE WHEN length(text) >= 150 THEN 'long' ELSE 'short' END AS type FROM queries)"


@specs.query(
    _sql(
        "SELECT type, count(*) AS queries, round(avg(a.p), 6) AS p1, round(avg(b.p), 6) AS p5, round(avg(c.r), 6) AS r10 FROM k1 AS a JOIN k5 AS b USING (query_id) JOIN k10 AS c USING (query_id) JOIN types USING (query_id) GROUP BY type",
        _CHUNKS, _QUERIES, _KEYWORD, _GOLD, _metrics("k1", "kw", 1), _metrics("k5", "kw", 5), _metrics("k10", "kw", 10), _TYPES,
    )
)
def metrics_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = queries(spark, sf_dir).select("query_id", F.when(F.length("text") >= 150, "long").otherwise("short").alias("type"))
    return E.mean_at(_files(kw_search(spark, sf_dir)), gold(spark, sf_dir), types)


@specs.query(_sql("SELECT query_id, hits, round(p, 6) AS p, round(r, 6) AS r FROM w5", _CHUNKS, _QUERIES, _KEYWORD, _GOLD, _metrics("w5", "kw", 5).replace("AND t.file_path = g.file_path", "AND contains(t.file_path, g.file_path)")))
def pk_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.at_k(_files(kw_search(spark, sf_dir)), gold(spark, sf_dir), 5, within=True)
    return found.select("query_id", "hits", F.round("p", 6).alias("p"), F.round("r", 6).alias("r"))


@specs.query(
    _sql(
        "SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank, chunk_id, score FROM kept",
        _CHUNKS, _QUERIES, _KEYWORD, "meta AS (SELECT 'doc' || doc_id AS file_path, lang, doc_id::DOUBLE / max(doc_id) OVER () AS recency FROM documents)",
        "kept AS (SELECT query_id, chunk_id, round(score * 0.8::DOUBLE + recency * 0.2::DOUBLE, 6) AS score FROM kw JOIN meta ON file_path = regexp_replace(chunk_id, ':[0-9]+$', '') WHERE lang = 'en')",
    )
)
def search_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    newest = docs.agg(F.max("doc_id").alias("newest"))
    meta = docs.crossJoin(F.broadcast(newest)).select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("file_path"), "lang", (F.col("doc_id") / F.col("newest")).alias("recency"))  # newest is one row
    return R.reranked(kw_search(spark, sf_dir), meta, F.col("lang") == "en")


_WON = "coalesce(a.p, -1) > coalesce(b.p, -1) OR (coalesce(a.p, -1) = coalesce(b.p, -1) AND ar.r > br.r)"


@specs.query(
    _sql(
        "SELECT count(*) FILTER (WHERE won) AS first, count(*) FILTER (WHERE lost) AS second, count(*) FILTER (WHERE NOT won AND NOT lost) AS ties FROM"
        " (SELECT (a.p > b.p OR (a.p = b.p AND ar.r > br.r)) AS won, (b.p > a.p OR (a.p = b.p AND br.r > ar.r)) AS lost FROM (SELECT query_id, coalesce(p, -1) AS p FROM k1) AS a JOIN k10 AS ar USING (query_id) JOIN (SELECT query_id, coalesce(p, -1) AS p FROM s1) AS b USING (query_id) JOIN s10 AS br USING (query_id))",
        _CHUNKS, _QUERIES, _KEYWORD, _SEMANTIC, _GOLD, _metrics("k1", "kw", 1), _metrics("k10", "kw", 10), _metrics("s1", "sm", 1), _metrics("s10", "sm", 10),
    )
)
def method_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gold(spark, sf_dir)

    def scores(found: DataFrame) -> DataFrame:
        return E.at_k(found, g, 1).select("query_id", "p").join(E.at_k(found, g, 10).select("query_id", "r"), "query_id")

    return E.wins(scores(_files(kw_search(spark, sf_dir))), scores(_files(sem_search(spark, sf_dir))))


_PREDICTED = "predicted AS (SELECT d.doc_id, d.source, CASE WHEN regexp_matches(d.text, '!!|\\||###|\\$\\$\\$') THEN 0 ELSE 1 END AS quality FROM documents AS d JOIN labels AS l USING (doc_id)), truth AS (SELECT d.doc_id, d.source, l.quality FROM documents AS d JOIN labels AS l USING (doc_id))"


@specs.query(
    f"WITH {_PREDICTED}, m AS (SELECT coalesce(t.source, p.source) AS source, count(*) FILTER (WHERE t.doc_id IS NOT NULL AND p.doc_id IS NOT NULL) AS matched, count(*) FILTER (WHERE t.doc_id IS NULL) AS false_positives, count(*) FILTER (WHERE p.doc_id IS NULL) AS false_negatives FROM truth AS t FULL JOIN predicted AS p ON t.doc_id = p.doc_id AND t.quality = p.quality GROUP BY 1)"
    " SELECT source, matched, false_positives, false_negatives, CASE WHEN matched + false_positives > 0 THEN matched::DOUBLE / (matched + false_positives) ELSE 0.0 END AS precision, CASE WHEN matched + false_negatives > 0 THEN matched::DOUBLE / (matched + false_negatives) ELSE 0.0 END AS recall FROM m"
)
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    guess = F.when(F.col("text").rlike(r"!!|\||###|\$\$\$"), 0).otherwise(1)
    return E.precision_recall(docs.select("doc_id", "source", "quality"), docs.select("doc_id", "source", guess.alias("quality")), ["doc_id", "quality"], ["source"])


@specs.query(
    "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)"
    " SELECT event_type, max(n) AS n, max(CASE WHEN i = least(n - 1, n * 50 // 100) THEN value END) AS p50, max(CASE WHEN i = least(n - 1, n * 95 // 100) THEN value END) AS p95, max(CASE WHEN i = least(n - 1, n * 99 // 100) THEN value END) AS p99 FROM r GROUP BY event_type"
)
def latency_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.order_statistics(table(spark, sf_dir, "events"), "event_type", "value")


# Files: a document's path takes its directory and extension from its id.
_PATH = "CASE doc_id % 8 WHEN 0 THEN 'src/a' || doc_id || '.ts' WHEN 1 THEN 'src/b' || doc_id || '.js' WHEN 2 THEN 'src/c' || doc_id || '.tsx' WHEN 3 THEN 'lib/d' || doc_id || '.test.ts' WHEN 4 THEN 'docs/e' || doc_id || '.md' WHEN 5 THEN 'pkg/test/f' || doc_id || '.jsx' WHEN 6 THEN 'node_modules/g/' || doc_id || '.js' ELSE 'src/h' || doc_id || '.spec.js' END"
_LANGUAGE = "CASE WHEN regexp_matches(path, '\\.tsx?$') THEN 'typescript' WHEN regexp_matches(path, '\\.jsx?$') THEN 'javascript' ELSE 'unknown' END"
_FILES = f"""
files AS (SELECT {_PATH} AS path, encode(text) AS content, text FROM documents WHERE text IS NOT NULL),
classified AS (SELECT path, CAST(octet_length(content) AS BIGINT) AS size, CASE WHEN octet_length(content) <= 1048576 THEN sha256(text) ELSE '' END AS hash, {_LANGUAGE} AS language,
  regexp_matches(path, '\\.(test|spec)\\.(js|ts|jsx|tsx)$|/(test|spec)/') AS is_test,
  CASE WHEN contains(text, 'jest') OR contains(text, 'describe') THEN 'jest' WHEN contains(text, 'mocha') THEN 'mocha' WHEN contains(text, 'vitest') THEN 'vitest' ELSE 'unknown' END AS test_framework,
  contains(text, chr(0)) AS is_binary, NOT contains(text, chr(0)) AND {_LANGUAGE} <> 'unknown' AS analyzable
  FROM files WHERE NOT list_has_any(string_split(path, '/'), ['node_modules', 'dist', 'build', 'coverage', 'vendor', 'out', 'target', 'tmp', '.git', '.cache']))
"""


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.expr(_PATH).alias("path"), F.encode("text", "UTF-8").alias("content"))


@specs.query(_sql("SELECT * FROM classified", _FILES).replace("RECURSIVE ", ""))
def files_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.classify(source_files(spark, sf_dir))


@specs.query(_sql("SELECT language, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM classified GROUP BY language", _FILES).replace("RECURSIVE ", ""))
def lang_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.language_breakdown(M.classify(source_files(spark, sf_dir)))


@specs.query(
    _sql(
        "SELECT CAST(sum(n) AS BIGINT) AS file_count, CAST(sum(size) AS BIGINT) AS total_size, CAST(sum(ok) AS BIGINT) AS analyzable_count, string_agg(language || '=' || n, ',' ORDER BY language || '=' || n) AS languages, CASE WHEN sum(ok) > 0 THEN 'COMPLETED' ELSE 'COMPLETED_WITH_WARNINGS' END AS outcome"
        " FROM (SELECT language, count(*) AS n, sum(size) AS size, count(*) FILTER (WHERE analyzable) AS ok FROM classified GROUP BY language)",
        _FILES,
    ).replace("RECURSIVE ", "")
)
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.manifest(M.classify(source_files(spark, sf_dir)))


@specs.query("SELECT doc_id, printf('%x', abs(list_reduce(list_transform(string_split(text, ''), lambda c: unicode(c)::BIGINT), lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648, 0::BIGINT))) AS hash FROM documents WHERE text IS NOT NULL")
def js_hash32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").where("text IS NOT NULL").select("doc_id", C.hash32(F.col("text")).alias("hash"))


@specs.query("SELECT page_id, CASE WHEN octet_length(encode(html)) <= 1048576 THEN sha256(html) ELSE '' END AS hash FROM pages WHERE html IS NOT NULL")
def sha_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where("html IS NOT NULL").select("page_id", C.capped_sha256(F.encode("html", "UTF-8")).alias("hash"))


@specs.query(_sql("SELECT count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS text_length FROM chunks", _CHUNKS))
def storage_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("text_length"))
