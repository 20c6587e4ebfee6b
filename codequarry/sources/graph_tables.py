"""Binding of the driver tables to a property graph: the nodes and relationships that the graph operators take.

Symbols are parts, tests are orders, files are suppliers, directories are nations, snapshots are regions. Relationships come from lineitem: two
symbols call one another where their items follow each other in a returned order; a test covers the symbols of its large accepted
items; a file holds the symbols whose least supplier it is.
"""

from __future__ import annotations

from functools import reduce
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codequarry.sources.shared import exists, fingerprint_of, shared_path
from codequarry.sources.sinks import write_graph

#: Columns of the stored tables.
NODES = StructType.fromJson({"type": "struct", "fields": [{"name": n, "type": t, "nullable": True, "metadata": {}} for n, t in {"id": "string", "node_type": "string", "name": "string", "kind": "string", "file_path": "string", "start_line": "integer", "end_line": "integer", "is_exported": "boolean", "is_test": "boolean"}.items()]})
EDGES = StructType.fromJson({"type": "struct", "fields": [{"name": n, "type": t, "nullable": True, "metadata": {}} for n, t in {"from_id": "string", "to_id": "string", "rel_type": "string", "call_site_line": "integer"}.items()]})

#: The kind of symbol that stands for each type of part.
KINDS = {"STANDARD": "function", "MEDIUM": "function", "ECONOMY": "method", "PROMO": "class", "LARGE": "const", "SMALL": "interface"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, key: str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string"))


class Bound:
    """The graph of the tables of one scale, derived from them; every method returns a DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def symbols(self) -> DataFrame:
        homes = self.table("lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("home"))
        kind = F.element_at(F.create_map(*[F.lit(v) for kv in KINDS.items() for v in kv]), F.col("p_type"))
        parts = self.table("part").join(homes, F.col("p_partkey") == F.col("l_partkey"), "left")
        return parts.select(
            _id("part", "p_partkey").alias("id"), F.col("p_name").alias("name"), kind.alias("kind"), _id("supplier", "home").alias("file_path"),
            F.col("p_size").alias("start_line"), (F.col("p_size") + 10).alias("end_line"), (F.col("p_retailprice") >= 950).alias("is_exported"),
        )

    def nodes(self) -> DataFrame:
        """id, node_type, name, kind, file_path, start_line, end_line, is_exported, is_test."""
        columns = ["id", "node_type", "name", "kind", "file_path", "start_line", "end_line", "is_exported", "is_test"]

        def plain(name: str, node_type: str, prefix: str, key: str, label: Column, is_test: bool = False) -> DataFrame:
            return self.table(name).select(_id(prefix, key).alias("id"), F.lit(node_type).alias("node_type"), label.alias("name"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"), F.lit(False).alias("is_exported"), F.lit(is_test).alias("is_test"))

        symbols = self.symbols().select("*", F.lit("Symbol").alias("node_type"), F.lit(False).alias("is_test")).select(columns)
        others = [
            plain("orders", "Test", "order", "o_orderkey", F.col("o_orderpriority"), True),
            plain("supplier", "File", "supplier", "s_suppkey", F.col("s_name")),
            plain("nation", "Directory", "nation", "n_nationkey", F.col("n_name")),
            plain("region", "RepositorySnapshot", "region", "r_regionkey", F.col("r_name")),
        ]
        return reduce(DataFrame.unionByName, others, symbols)

    def calls(self) -> DataFrame:
        """from_id, to_id, call_site_line: one edge for each pair, with its least line."""
        items = self.table("lineitem").where("l_returnflag = 'R' AND l_quantity >= 20").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
        ahead = items.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("p").alias("q"))
        pairs = items.join(ahead, ["l_orderkey", "l_linenumber"]).where("p <> q")
        return pairs.groupBy("p", "q").agg(F.min("l_linenumber").alias("call_site_line")).select(_id("part", "p").alias("from_id"), _id("part", "q").alias("to_id"), "call_site_line")

    def tested_by(self) -> DataFrame:
        items = self.table("lineitem").where("l_returnflag = 'A' AND l_quantity >= 45").select("l_partkey", "l_orderkey")
        urgent = self.table("orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey")
        found = items.join(urgent, F.col("l_orderkey") == F.col("o_orderkey")).select("l_partkey", "l_orderkey").distinct()
        return found.select(_id("part", "l_partkey").alias("from_id"), _id("order", "l_orderkey").alias("to_id"))

    def documented_by(self) -> DataFrame:
        items = self.table("lineitem").where("l_returnflag = 'N' AND l_quantity <= 5").select("l_partkey", "l_suppkey").distinct()
        return items.select(_id("part", "l_partkey").alias("from_id"), _id("supplier", "l_suppkey").alias("to_id"))

    def contains(self) -> DataFrame:
        files = self.symbols().where("file_path IS NOT NULL").select(F.col("file_path").alias("from_id"), F.col("id").alias("to_id"))
        folders = self.table("supplier").select(_id("nation", "s_nationkey").alias("from_id"), _id("supplier", "s_suppkey").alias("to_id"))
        roots = self.table("nation").select(_id("region", "n_regionkey").alias("from_id"), _id("nation", "n_nationkey").alias("to_id"))
        return files.union(folders).union(roots)

    def exports(self) -> DataFrame:
        return self.symbols().where("is_exported AND file_path IS NOT NULL").select(F.col("file_path").alias("from_id"), F.col("id").alias("to_id"))

    def imports(self) -> DataFrame:
        """File to file, where a symbol of the one calls a symbol of the other."""
        home = self.symbols().select("id", "file_path")
        caller, callee = home.select(F.col("id").alias("from_id"), F.col("file_path").alias("a")), home.select(F.col("id").alias("to_id"), F.col("file_path").alias("b"))
        return self.calls().join(caller, "from_id").join(callee, "to_id").where("a <> b").select(F.col("a").alias("from_id"), F.col("b").alias("to_id")).distinct()

    def relationships(self) -> DataFrame:
        """from_id, to_id, rel_type, call_site_line. CONTAINS is a relationship of its own; neighbourhoods leave it out by default."""
        line = F.lit(None).cast("int").alias("call_site_line")
        typed = [e.select("from_id", "to_id", F.lit(t).alias("rel_type"), line) for t, e in (("TESTED_BY", self.tested_by()), ("IMPORTS", self.imports()), ("EXPORTS", self.exports()), ("CONTAINS", self.contains()))]
        return reduce(DataFrame.unionByName, typed, self.calls().select("from_id", "to_id", F.lit("CALLS").alias("rel_type"), "call_site_line"))


#: Where the graph of a scale is stored, by application, folder and what the folder's files are: it is loaded once and again only if they change.
_stored: dict[tuple[str, str, str], str] = {}
_NAMES = ("lineitem", "orders", "part", "supplier", "nation", "region")


def load(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the stored graph of sf_dir, written if it isn't there yet."""
    said = md5("".join(fingerprint_of(spark, f"{sf_dir}/{name}.parquet") for name in _NAMES).encode()).hexdigest()
    key = (spark.sparkContext.applicationId, sf_dir, said)
    if key not in _stored or not exists(spark, f"{_stored[key]}/relationships_from/_SUCCESS"):
        bound, path = Bound(spark, sf_dir), shared_path(spark, "graph")
        none = F.lit(None).cast("int").alias("call_site_line")
        documented = bound.documented_by().select("from_id", "to_id", F.lit("DOCUMENTED_BY").alias("rel_type"), none)
        write_graph(bound.nodes(), bound.relationships().unionByName(documented), path)
        _stored[key] = path
    return _stored[key]


class Graph:
    """The stored graph of one scale; every method returns a DataFrame that reads only the folders of its types."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.path = spark, load(spark, sf_dir)

    def nodes(self) -> DataFrame:
        """id, node_type, name, kind, file_path, start_line, end_line, is_exported, is_test."""
        return self.spark.read.schema(NODES).parquet(f"{self.path}/nodes").select(*NODES.fieldNames())

    def symbols(self) -> DataFrame:
        return self.nodes().where("node_type = 'Symbol'").drop("node_type", "is_test")

    def edges(self, *types: str, by: str = "to_id") -> DataFrame:
        """from_id, to_id, rel_type, call_site_line of some types of relationships, in ranges of the end that lookups name."""
        folder = "relationships_from" if by == "from_id" else "relationships"
        return self.spark.read.schema(EDGES).parquet(f"{self.path}/{folder}").where(F.col("rel_type").isin(*types)).select(*EDGES.fieldNames())

    def calls(self, by: str = "to_id") -> DataFrame:
        return self.edges("CALLS", by=by).drop("rel_type")

    def tested_by(self, by: str = "from_id") -> DataFrame:
        return self.edges("TESTED_BY", by=by).select("from_id", "to_id")

    def documented_by(self) -> DataFrame:
        return self.edges("DOCUMENTED_BY", by="from_id").select("from_id", "to_id")

    def imports(self) -> DataFrame:
        return self.edges("IMPORTS").select("from_id", "to_id")

    def relationships(self) -> DataFrame:
        """CONTAINS is a relationship of its own; neighbourhoods leave it out by default."""
        return self.edges("CALLS", "TESTED_BY", "IMPORTS", "EXPORTS", "CONTAINS")


#: The same graph in SQL, as common table expressions.
GRAPH_SQL = """
homes AS (SELECT l_partkey, min(l_suppkey) AS home FROM lineitem GROUP BY l_partkey),
symbols AS (
  SELECT 'part:' || p_partkey AS id, p_name AS name,
         CASE p_type WHEN 'STANDARD' THEN 'function' WHEN 'MEDIUM' THEN 'function' WHEN 'ECONOMY' THEN 'method' WHEN 'PROMO' THEN 'class' WHEN 'LARGE' THEN 'const' WHEN 'SMALL' THEN 'interface' END AS kind,
         'supplier:' || home AS file_path, p_size AS start_line, p_size + 10 AS end_line, p_retailprice >= 950 AS is_exported
  FROM part LEFT JOIN homes ON p_partkey = l_partkey),
nodes AS (
  SELECT id, 'Symbol' AS node_type, name, kind, file_path, start_line, end_line, is_exported, false AS is_test FROM symbols
  UNION ALL SELECT 'order:' || o_orderkey, 'Test', o_orderpriority, NULL, NULL, NULL, NULL, false, true FROM orders
  UNION ALL SELECT 'supplier:' || s_suppkey, 'File', s_name, NULL, NULL, NULL, NULL, false, false FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, 'Directory', n_name, NULL, NULL, NULL, NULL, false, false FROM nation
  UNION ALL SELECT 'region:' || r_regionkey, 'RepositorySnapshot', r_name, NULL, NULL, NULL, NULL, false, false FROM region),
items AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 20 GROUP BY l_orderkey, l_linenumber),
calls AS (
  SELECT 'part:' || a.p AS from_id, 'part:' || b.p AS to_id, min(a.l_linenumber) AS call_site_line
  FROM items AS a JOIN items AS b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.p <> b.p GROUP BY a.p, b.p),
tested_by AS (
  SELECT DISTINCT 'part:' || l_partkey AS from_id, 'order:' || l_orderkey AS to_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'A' AND l_quantity >= 45 AND o_orderpriority = '1-URGENT'),
documented_by AS (SELECT DISTINCT 'part:' || l_partkey AS from_id, 'supplier:' || l_suppkey AS to_id FROM lineitem WHERE l_returnflag = 'N' AND l_quantity <= 5),
contains_ AS (
  SELECT file_path AS from_id, id AS to_id FROM symbols WHERE file_path IS NOT NULL
  UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey FROM supplier
  UNION ALL SELECT 'region:' || n_regionkey, 'nation:' || n_nationkey FROM nation),
exports AS (SELECT file_path AS from_id, id AS to_id FROM symbols WHERE is_exported AND file_path IS NOT NULL),
imports AS (
  SELECT DISTINCT a.file_path AS from_id, b.file_path AS to_id FROM calls JOIN symbols AS a ON a.id = calls.from_id JOIN symbols AS b ON b.id = calls.to_id
  WHERE a.file_path <> b.file_path),
relationships AS (
  SELECT from_id, to_id, 'CALLS' AS rel_type, call_site_line FROM calls
  UNION ALL SELECT from_id, to_id, 'TESTED_BY', NULL FROM tested_by
  UNION ALL SELECT from_id, to_id, 'IMPORTS', NULL FROM imports
  UNION ALL SELECT from_id, to_id, 'EXPORTS', NULL FROM exports
  UNION ALL SELECT from_id, to_id, 'CONTAINS', NULL FROM contains_)
"""
