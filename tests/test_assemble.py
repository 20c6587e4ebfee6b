"""A source tree on disk becomes a graph."""

from __future__ import annotations

from codequarry.operators import assemble, extract, resolve
from codequarry.schema import outside_domains
from codequarry.sources.shared import materialise


def test_tree_to_graph(spark, tmp_path):
    tree = {
        "src/add.ts": "// TODO: more\nexport function add(a, b) {\n  return a + b;\n}\nexport const twice = (x) => add(x, x);\n",
        "src/add.test.ts": "import { twice } from './add';\ntest('twice', () => {\n  twice(2);\n});\ngone();\n",
        "node_modules/x/y.ts": "export function no() {}\n",
    }
    for name, text in tree.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    nodes, edges, errors = assemble.load_repository(spark, str(tmp_path), "demo", walk="search")
    ids = {(r["id"], r["node_type"], r["props"].get("placeholder")) for r in nodes.collect()}
    assert ids == {
        ("repo:demo", "RepositorySnapshot", None), ("src/add.ts", "File", None), ("src/add.test.ts", "File", None), ("src/add.ts:add:2", "Symbol", None), ("src/add.ts:twice:5", "Symbol", None),
        ("src/add.test.ts:twice:2", "Test", None), ("src/add.ts:TODO:1", "TodoMarker", None), ("src/add.test.ts:__module__:1", "Symbol", "true"), ("src/add.test.ts:file", "Symbol", "true"),
    }
    assert {(r["from_id"], r["to_id"], r["rel_type"]) for r in edges.collect()} == {
        ("src/add.ts", "src/add.ts:add:2", "EXPORTS"), ("src/add.ts", "src/add.ts:twice:5", "EXPORTS"), ("src/add.test.ts", "src/add.ts", "IMPORTS"), ("src/add.ts:twice:5", "src/add.ts:add:2", "CALLS"),
        ("src/add.test.ts:__module__:1", "src/add.ts:twice:5", "CALLS"), ("src/add.ts:twice:5", "src/add.test.ts:twice:2", "TESTED_BY"), ("src/add.ts:add:2", "src/add.test.ts:file", "TESTED_BY"),
    }
    assert sorted(r["message"] for r in errors.collect()) == ["Could not resolve call to 'gone'", "Could not resolve call to 'test'"]
    assert outside_domains(nodes).where("node_type <> 'TodoMarker'").count() == 0 == outside_domains(edges).count()


def test_declarations_and_type_pass(spark):
    symbols = spark.createDataFrame([("f", "go", "f:go:1", 1, 3, 0), ("f", "go", "f:go:9", 9, 12, 1)], "file_path string, name string, symbol_id string, start_line int, end_line int, ord int")
    declared = spark.createDataFrame([(1, "f", "go", 10), (2, "f", "go", 50), (3, "f", "no", 1)], "decl_id int, file_path string, name string, line int")
    assert {tuple(r) for r in assemble.match_declarations(declared, symbols).collect()} == {(1, "f:go:9"), (2, "f:go:1")}
    files = spark.createDataFrame([("typescript",), ("typescript",), ("javascript",)], "language string")
    calls = spark.createDataFrame([("method", None)] * 7 + [("method", "x")] * 3 + [("builtin", None)] * 2, "category string, callee_id string")
    assert assemble.wants_type_pass(files, calls).first()["wanted"] and not assemble.wants_type_pass(files, calls.limit(0)).first()["wanted"]
    assert assemble.parse_errors(extract.scan(spark.createDataFrame([("a.ts", "const x = 1")], "path string, text string"))).count() == 0


def test_relationships_resolve_calls_once(spark):
    files = spark.createDataFrame([("a.ts", "export function f() {\n  return 1;\n}\n"), ("a.test.ts", "import { f } from './a';\ntest('f', () => {\n  f();\n});\n")], "path string, text string")
    scanned = materialise(extract.scan(files), "scanned")
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    r = resolve.Resolver(extract.facts(scanned))
    assert {tuple(x)[:3] for x in r.relationships().collect()} >= {("a.test.ts:__module__:1", "a.ts:f:1", "CALLS"), ("a.ts:f:1", "a.test.ts:f:2", "TESTED_BY")}
    # a plan that resolves the calls again wherever they are read has 103 joins
    assert joins(r.relationships()) < 12


def test_nodes_plan_holds_each_table_once(spark):
    files = spark.createDataFrame([("a.ts", "export function f() {\n  return 1;\n}\n"), ("a.test.ts", "import { f } from './a';\nf();\nf();\ntest('f', () => {\n  f();\n});\n")], "path string, text string")
    nodes, edges, _ = assemble.graph_of("demo", materialise(extract.scan(files), "scanned"))
    assert edges.where("from_id = 'a.test.ts:__module__:1'").count() == 3
    found = sorted((r["id"], r["node_type"], r["kind"], r["is_exported"], r["is_test"], r["props"].get("placeholder")) for r in nodes.collect())
    assert found == [
        ("a.test.ts", "File", None, False, True, None), ("a.test.ts:__module__:1", "Symbol", None, False, False, "true"), ("a.test.ts:f:4", "Test", None, False, True, None), ("a.test.ts:file", "Symbol", None, False, False, "true"),
        ("a.ts", "File", None, False, False, None), ("a.ts:f:1", "Symbol", "function", True, False, None), ("repo:demo", "RepositorySnapshot", None, False, False, None),
    ]
    plan = nodes._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and plan.count("Join ") <= 3
