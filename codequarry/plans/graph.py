"""Queries over the graph that the driver tables bind to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.operators import graph as G
from codequarry.operators import traverse as V
from codequarry.plans.spec import Specs
from codequarry.sources.graph_tables import GRAPH_SQL, Graph

specs = Specs()
_SEED = "seed AS (SELECT s.id FROM symbols AS s LEFT JOIN (SELECT to_id, count(*) AS n FROM calls GROUP BY to_id) AS c ON c.to_id = s.id ORDER BY coalesce(c.n, 0) DESC, s.id LIMIT 1)"
_TESTED_SEED = "seed AS (SELECT s.id FROM symbols AS s LEFT JOIN (SELECT to_id, count(*) AS n FROM calls GROUP BY to_id) AS c ON c.to_id = s.id WHERE s.id IN (SELECT from_id FROM tested_by) ORDER BY coalesce(c.n, 0) DESC, s.id LIMIT 1)"


def _sql(body: str, *tables: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{GRAPH_SQL}{''.join(', ' + t for t in tables)} {body}"


def _seed(g: Graph) -> DataFrame:
    return G.seeds(g.symbols(), g.calls(), 1)


@specs.query(_sql("SELECT DISTINCT s.id, s.name, s.kind, s.file_path, s.start_line FROM calls JOIN seed ON to_id = seed.id JOIN symbols AS s ON s.id = from_id", _SEED))
def q2_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    return G.callers(g.symbols(), g.calls(), _seed(g)).orderBy("id")


@specs.query(_sql("SELECT DISTINCT s.id, s.name, s.kind, s.file_path, s.start_line FROM calls JOIN seed ON from_id = seed.id JOIN symbols AS s ON s.id = to_id", _SEED))
def q2_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    return G.callees(g.symbols(), g.calls("from_id"), _seed(g)).orderBy("id")


@specs.query(_sql("SELECT DISTINCT n.id, n.name, n.file_path FROM tested_by JOIN seed ON from_id = seed.id JOIN nodes AS n ON n.id = to_id", _TESTED_SEED))
def q3_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    tested = g.symbols().join(g.tested_by().select(F.col("from_id").alias("id")), "id", "left_semi")
    return G.covering_tests(g.nodes().where("node_type = 'Test'"), g.tested_by(), G.seeds(tested, g.calls(), 1)).orderBy("id")


@specs.query(_sql("SELECT id FROM symbols WHERE id IN (SELECT from_id FROM tested_by)"))
def q3_seed_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    return g.symbols().select("id").join(g.tested_by().select(F.col("from_id").alias("id")), "id", "left_semi")


def _impact_sql(depth: int) -> str:
    walk = f"impact(id, depth) AS (SELECT from_id, 1 FROM calls JOIN seed ON to_id = seed.id UNION SELECT c.from_id, i.depth + 1 FROM impact AS i JOIN calls AS c ON c.to_id = i.id WHERE i.depth < {depth})"
    return _sql("SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM impact GROUP BY id", _SEED, walk, recursive=True)


def _impact(spark: SparkSession, sf_dir: str, depth: int) -> DataFrame:
    g = Graph(spark, sf_dir)
    return V.reachable(V.backward(g.calls()), _seed(g), depth).orderBy("id", "depth")


@specs.query(_impact_sql(1))
def q4_impact_d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _impact(spark, sf_dir, 1)


@specs.query(_impact_sql(2))
def q4_impact_d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _impact(spark, sf_dir, 2)


@specs.query(_impact_sql(4))
def q4_impact_d4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _impact(spark, sf_dir, 4)


@specs.query(_impact_sql(8))
def q4_impact_d8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _impact(spark, sf_dir, 8)


_GAPS = "SELECT id, name, kind, file_path FROM symbols AS s WHERE kind IN ('function', 'method', 'class') {more} AND NOT EXISTS (SELECT 1 FROM tested_by AS t WHERE t.from_id = s.id) {limit}"


@specs.query(_sql(_GAPS.format(more="", limit="ORDER BY id LIMIT 500")))
def q6_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    return G.coverage_gaps(g.symbols(), g.tested_by())


@specs.query(_sql(_GAPS.format(more="AND is_exported", limit="")))
def q6_gaps_public(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    return G.coverage_gaps(g.symbols(), g.tested_by(), public_only=True, limit=None)


_BOTH = "sides AS (SELECT from_id AS src, to_id AS dst FROM relationships WHERE rel_type <> 'CONTAINS' UNION SELECT to_id, from_id FROM relationships WHERE rel_type <> 'CONTAINS')"


def _near(radius: int) -> str:
    return f"near(id, depth) AS (SELECT id, 0 FROM seed UNION SELECT e.dst, n.depth + 1 FROM near AS n JOIN sides AS e ON e.src = n.id WHERE n.depth < {radius})"


def _near_sql(radius: int) -> str:
    return _sql("SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM near GROUP BY id", _SEED, _BOTH, _near(radius), recursive=True)


def _neighbourhood(spark: SparkSession, sf_dir: str, radius: int) -> DataFrame:
    g = Graph(spark, sf_dir)
    return V.neighbourhood(g.relationships(), _seed(g), radius)


@specs.query(_near_sql(1))
def q9_neigh_r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbourhood(spark, sf_dir, 1).orderBy("id", "depth")


@specs.query(_near_sql(2))
def q9_neigh_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbourhood(spark, sf_dir, 2).orderBy("id", "depth")


@specs.query(_near_sql(3))
def q9_neigh_r3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbourhood(spark, sf_dir, 3).orderBy("id", "depth")


@specs.query(_sql("SELECT from_id, to_id, rel_type FROM relationships WHERE from_id IN (SELECT id FROM near) AND to_id IN (SELECT id FROM near)", _SEED, _BOTH, _near(2), recursive=True))
def q9_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    return V.subgraph(g.relationships(), _neighbourhood(spark, sf_dir, 2)).select("from_id", "to_id", "rel_type")


@specs.query(_sql("SELECT s.id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_calls FROM symbols AS s LEFT JOIN (SELECT to_id, count(*) AS n FROM calls GROUP BY to_id) AS c ON c.to_id = s.id ORDER BY n_calls DESC, s.id LIMIT 20"))
def deg_in_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    return G.seeds(g.symbols(), g.calls(), 20)


@specs.query(_sql("SELECT max(n) AS most FROM (SELECT count(*) AS n FROM calls GROUP BY to_id)"))
def deg_in_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.in_degree(Graph(spark, sf_dir).calls()).agg(F.max("n").alias("most"))


@specs.query(
    _sql(
        "SELECT id, two_hop FROM (SELECT t.id, t.n, CAST(coalesce(r.n, 0) AS BIGINT) AS two_hop FROM top AS t LEFT JOIN (SELECT seed, count(*) AS n FROM reach GROUP BY seed) AS r ON r.seed = t.id) ORDER BY two_hop >= 3 DESC, n DESC, id LIMIT 1",
        "top AS (SELECT s.id, coalesce(c.n, 0) AS n FROM symbols AS s LEFT JOIN (SELECT to_id, count(*) AS n FROM calls GROUP BY to_id) AS c ON c.to_id = s.id ORDER BY n DESC, s.id LIMIT 200)",
        "one AS (SELECT DISTINCT t.id AS seed, c.from_id AS id FROM top AS t JOIN calls AS c ON c.to_id = t.id)",
        "reach AS (SELECT seed, id FROM one UNION SELECT o.seed, c.from_id FROM one AS o JOIN calls AS c ON c.to_id = o.id)",
    )
)
def deep_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    return G.deep_seed(g.symbols(), g.calls())


@specs.query(_sql("SELECT id, name, kind FROM symbols WHERE id NOT IN (SELECT to_id FROM calls)"))
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    return G.orphans(g.symbols(), g.calls())


_DEGREES = "degrees AS (SELECT id, rel_type, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT to_id AS id, rel_type, 1 AS i, 0 AS o FROM relationships UNION ALL SELECT from_id, rel_type, 0, 1 FROM relationships) GROUP BY id, rel_type)"


@specs.query(_sql("SELECT CAST(row_number() OVER (ORDER BY fan_in DESC, id) AS INTEGER) AS rank, id, fan_in, fan_out FROM (SELECT d.* FROM degrees AS d JOIN symbols USING (id) WHERE rel_type = 'CALLS' ORDER BY fan_in DESC, id LIMIT 50)", _DEGREES))
def high_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    return G.high_impact(g.symbols(), g.calls(), 50)


@specs.query(_sql("SELECT * FROM degrees", _DEGREES))
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(Graph(spark, sf_dir).relationships())


@specs.query(_sql("SELECT to_id AS id, count(*) AS n_importers, string_agg(from_id, ',' ORDER BY from_id) AS importers FROM imports GROUP BY to_id"))
def file_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.dependents(Graph(spark, sf_dir).imports())


@specs.query(_sql("SELECT a.id, a.file_path, count(b.id) AS n_outside FROM symbols AS a LEFT JOIN calls AS c ON c.to_id = a.id LEFT JOIN symbols AS b ON b.id = c.from_id AND b.file_path IS DISTINCT FROM a.file_path WHERE a.is_exported GROUP BY a.id, a.file_path"))
def api_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    return G.api_boundary(g.symbols(), g.calls())


@specs.query(
    _sql(
        "SELECT label, count(*) AS n_symbols FROM labels LEFT JOIN (SELECT DISTINCT from_id FROM tested_by) AS t ON t.from_id = node GROUP BY label HAVING count(t.from_id) = 0",
        "ends AS (SELECT from_id AS a, to_id AS b FROM calls UNION SELECT to_id, from_id FROM calls)",
        "walk(node, label) AS (SELECT DISTINCT a, a FROM ends UNION SELECT e.b, w.label FROM walk AS w JOIN ends AS e ON e.a = w.node WHERE e.b > w.label)",
        "labels AS (SELECT node, min(label) AS label FROM walk GROUP BY node)",
        recursive=True,
    )
)
def test_deserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    return G.test_deserts(g.calls(), g.tested_by())


@specs.query(_sql("SELECT id, name, kind FROM symbols WHERE is_exported AND id NOT IN (SELECT from_id FROM documented_by)"))
def doc_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    return G.undocumented(g.symbols(), g.documented_by())


@specs.query(_sql("SELECT from_id AS id, string_agg(DISTINCT to_id, ',' ORDER BY to_id) AS targets FROM calls GROUP BY from_id"))
def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.adjacency(Graph(spark, sf_dir).calls())


@specs.query(_sql("SELECT from_id AS id, CAST(row_number() OVER (PARTITION BY from_id ORDER BY to_id) AS INTEGER) AS position, to_id AS neighbour FROM (SELECT DISTINCT from_id, to_id FROM calls)"))
def callees_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.neighbours(Graph(spark, sf_dir).calls("from_id"))


@specs.query(_sql("SELECT to_id AS id, CAST(row_number() OVER (PARTITION BY to_id ORDER BY from_id) AS INTEGER) AS position, from_id AS neighbour FROM (SELECT DISTINCT from_id, to_id FROM imports)"))
def importers_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.neighbours(Graph(spark, sf_dir).imports(), "to_id", "from_id")


@specs.query(_sql("SELECT rel_type, count(*) AS n FROM relationships GROUP BY rel_type"))
def edge_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Graph(spark, sf_dir).relationships().groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"))


@specs.query(_sql("SELECT id, CASE WHEN regexp_matches(id, '\\.(ts|js|jsx|tsx)$') THEN 'File' ELSE 'Symbol' END AS node_type FROM (SELECT from_id AS id FROM relationships UNION SELECT to_id FROM relationships) WHERE id NOT IN (SELECT id FROM symbols)"))
def placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    return G.placeholders(g.symbols(), g.relationships())


@specs.query(
    _sql(
        "SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(crossing) AS BIGINT) AS crossing FROM (SELECT 'node:' || node_type AS kind, 0 AS crossing FROM kept, range(4) UNION ALL SELECT 'edge:' || rel_type, CASE WHEN source <> clone THEN 1 ELSE 0 END FROM sources) GROUP BY kind",
        "kept AS (SELECT * FROM nodes WHERE node_type <> 'RepositorySnapshot')",
        "draws AS (SELECT r.*, c.range AS clone, CAST(('0x' || substr(md5(from_id || '|' || to_id || '|' || rel_type || '|' || c.range), 1, 7)) AS BIGINT) AS draw FROM relationships AS r, range(4) AS c WHERE from_id IN (SELECT id FROM kept))",
        "sources AS (SELECT *, CASE WHEN draw % 100 < 2 THEN (draw // 100) % 4 ELSE clone END AS source FROM draws)",
    )
)
def synth_scale_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    nodes, edges = G.scaled(g.nodes(), g.relationships(), 4)
    crossing = (F.regexp_extract("from_id", "^(S[0-9]+):", 1) != F.regexp_extract("to_id", "^(S[0-9]+):", 1)).cast("int")
    counted = nodes.select(F.concat(F.lit("node:"), "node_type").alias("kind"), F.lit(0).alias("crossing")).unionByName(edges.select(F.concat(F.lit("edge:"), "rel_type").alias("kind"), crossing.alias("crossing")))
    return counted.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("crossing").alias("crossing"))


@specs.query(
    _sql(
        "SELECT (SELECT count(*) FROM symbols) AS n_symbols, (SELECT count(*) FROM nodes WHERE node_type = 'File') AS n_files, (SELECT count(*) FROM calls) AS n_calls,"
        " (SELECT count(*) FROM (SELECT from_id AS id FROM relationships UNION SELECT to_id FROM relationships) WHERE id NOT IN (SELECT id FROM nodes)) AS n_orphan_ends,"
        " (SELECT count(*) - count(DISTINCT id) FROM nodes) AS n_repeated_ids"
    )
)
def loader_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    nodes = g.nodes()
    repeated = nodes.groupBy("id").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_repeated_ids"))
    one = count(g.symbols(), "n_symbols")
    for other in (count(nodes.where("node_type = 'File'"), "n_files"), count(g.calls(), "n_calls"), count(G.placeholders(nodes, g.relationships()), "n_orphan_ends"), repeated):
        one = one.crossJoin(other)  # one row each
    return one


_CHECKS = {"n_symbols": (300, None), "n_files": (50, None), "n_calls": (200, None), "n_orphan_ends": (None, 0), "n_placeholders": (None, 100)}
_ENDS = "(SELECT count(*) FROM (SELECT from_id AS id FROM relationships UNION SELECT to_id FROM relationships) WHERE id NOT IN (SELECT id FROM nodes))"


@specs.query(_sql(
    "SELECT name, n, n >= least AND n <= most AS ok FROM (SELECT 'n_symbols' AS name, (SELECT count(*) FROM symbols) AS n, 300 AS least, 1e18 AS most"
    " UNION ALL SELECT 'n_files', (SELECT count(*) FROM nodes WHERE node_type = 'File'), 50, 1e18 UNION ALL SELECT 'n_calls', (SELECT count(*) FROM calls), 200, 1e18"
    f" UNION ALL SELECT 'n_orphan_ends', {_ENDS}, 0, 0 UNION ALL SELECT 'n_placeholders', {_ENDS}, 0, 100)"
))
def self_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, n, ok: whether each count is within its bounds. The driver tables name no node that they lack, so ends without a node and placeholders are the same."""
    found = loader_invariants(spark, sf_dir).withColumn("n_placeholders", F.col("n_orphan_ends"))
    rows = F.array(*[F.struct(F.lit(name).alias("name"), F.col(name).alias("n"), F.lit(least or 0).cast("long").alias("least"), F.lit((1 << 62) if most is None else most).alias("most")) for name, (least, most) in _CHECKS.items()])
    return found.select(F.inline(rows)).select("name", "n", F.col("n").between(F.col("least"), F.col("most")).alias("ok"))


@specs.query(_sql("SELECT id, kind, is_exported, CAST(start_line AS INTEGER) AS start_line FROM symbols"))
def symbol_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols' properties written as JSON and read back."""
    props = F.to_json(F.struct("kind", "is_exported", "start_line"))
    read = Graph(spark, sf_dir).symbols().select("id", F.from_json(props, "kind string, is_exported boolean, start_line int").alias("p"))
    return read.select("id", "p.kind", "p.is_exported", "p.start_line")


@specs.query(_sql("SELECT file_path AS id, count(*) AS n_symbols, count(*) FILTER (WHERE is_exported) AS n_exported, count(*) FILTER (WHERE kind = 'function') AS n_function, count(*) FILTER (WHERE kind = 'method') AS n_method, count(*) FILTER (WHERE kind = 'class') AS n_class FROM symbols GROUP BY file_path"))
def symbol_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("function", "method", "class")]
    return Graph(spark, sf_dir).symbols().groupBy(F.col("file_path").alias("id")).agg(F.count(F.lit(1)).alias("n_symbols"), F.count_if("is_exported").alias("n_exported"), *kinds)


_CYCLE = "(VALUES ('a', 'b'), ('b', 'c'), ('c', 'a'), ('d', 'a'), ('a', 'b')) AS e(from_id, to_id)"


@specs.query(f"WITH RECURSIVE e AS (SELECT * FROM {_CYCLE}), walk(id, depth) AS (SELECT from_id, 1 FROM e WHERE to_id = 'a' UNION SELECT e.from_id, w.depth + 1 FROM walk AS w JOIN e ON e.to_id = w.id WHERE w.depth < 3) SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY id")
def q4_cycle_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = spark.sql("SELECT * FROM VALUES ('a', 'b'), ('b', 'c'), ('c', 'a'), ('d', 'a'), ('a', 'b') AS e(from_id, to_id)")
    return V.reachable(V.backward(edges), spark.sql("SELECT 'a' AS id"), 3)


@specs.query("SELECT id, arg_min(name, ord) AS name FROM (VALUES ('f:a:1', 'a', 2), ('f:a:1', 'a2', 1), ('f:b:2', 'b', 3)) AS n(id, name, ord) GROUP BY id")
def nodes_first_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = spark.sql("SELECT * FROM VALUES ('f:a:1', 'a', 2), ('f:a:1', 'a2', 1), ('f:b:2', 'b', 3) AS n(id, name, ord)")
    return G.first_written(nodes).select("id", "name")
