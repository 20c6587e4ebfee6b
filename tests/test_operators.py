"""Operators on small literal inputs."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from codequarry.functions import code as C
from codequarry.functions import paths as P
from codequarry.functions import text as T
from codequarry.operators import contribute, evaluate, extract, graph, manifest, retrieval, traverse
from codequarry.operators.components import connected_components
from codequarry.operators.resolve import Resolver
from codequarry.sources import files, sinks
from codequarry.sources.scenarios import scenario_facts


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("text", "want"), [("addBusinessDays", ["add", "business", "days"]), ("foo_bar x", ["foo", "bar"]), ("", []), ("HTTPServer v2Beta", ["httpserver", "v2", "beta"])])
def test_tokens(spark, text, want):
    assert one(spark, T.tokens, text) == want


@pytest.mark.parametrize(("text", "want"), [("a b c d", ["abc", "bcd"]), ("ab", []), ("", []), ("Ab-1!", ["ab1"])])
def test_ngrams(spark, text, want):
    assert one(spark, T.ngrams, text) == want


@pytest.mark.parametrize(("line", "want"), [("", 1), ("  ", 1), ("a  b\tc", 3)])
def test_line_words(spark, line, want):
    assert one(spark, T.line_words, line) == want


def test_line_chunks_equal_a_fold(spark):
    lines = [" ".join(["w"] * (k * 37 % 120)) for k in range(40)]
    want, held, first = [], 0, 1
    for i, line in enumerate(lines, 1):
        held += max(1, len(line.split()))
        if held >= 300 or i == len(lines):
            want.append((first, i))
            held, first = 0, i + 1
    got = one(spark, T.line_chunks, "\n".join(lines))
    assert [(c["start_line"], c["end_line"]) for c in got] == want
    assert "\n".join(c["text"] for c in got) == "\n".join(lines)


def hash32(text):
    h, data = 0, text.encode("utf-16-be")
    for k in range(0, len(data), 2):
        h = (h * 31 + int.from_bytes(data[k : k + 2], "big") + 2**31) % 2**32 - 2**31
    return format(abs(h), "x")


@pytest.mark.parametrize("text", ["", "abc", "function main() {}", "éñ中", "a😀b😀"])
def test_hash32(spark, text):
    assert one(spark, C.hash32, text) == hash32(text)


@pytest.mark.parametrize(("path", "want"), [("a/./b//c.ts", "a/b/c.ts"), ("a/b/../c", "a/c"), ("../x", "../x"), ("a\\b", "a/b"), ("/r/../s", "/s")])
def test_normalise(spark, path, want):
    assert one(spark, P.normalise, path) == want


def test_candidates(spark):
    get = lambda spec: one(spark, lambda x: P.candidates(x, F.lit("src/a/b.ts")), spec)
    assert get("./x.js") == ["src/a/x.js", "src/a/x.ts", "src/a/x.tsx"]
    assert get("../x")[0] == "src/x.ts" and get("../x")[-1] == "src/x/index.jsx" and len(get("../x")) == 8
    assert get("./a.utils") == ["src/a/a.utils"] and get("react") == [] and get("./m.mjs") == ["src/a/m.mjs", "src/a/m.ts"]


@pytest.mark.parametrize("depth", [1, 2, 3, 9])
def test_traversal_keeps_a_seed_on_a_cycle(spark, depth):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    got = {r["id"]: r["depth"] for r in traverse.reachable(edges, spark.createDataFrame([("a",)], "id string"), depth).collect()}
    assert got == {k: v for k, v in {"b": 1, "c": 2, "a": 3, "d": 3}.items() if v <= depth}


def test_subgraph_and_neighbourhood(spark):
    rel = spark.createDataFrame([("a", "b", "CALLS"), ("c", "b", "CALLS"), ("f", "a", "CONTAINS"), ("c", "d", "CALLS")], "from_id string, to_id string, rel_type string")
    near = traverse.neighbourhood(rel, spark.createDataFrame([("a",)], "id string"), 2)
    assert {r["id"]: r["depth"] for r in near.collect()} == {"a": 0, "b": 1, "c": 2}
    assert traverse.subgraph(rel, near).count() == 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(100) if i != 50] + [(200, 201), (201, 200), (7, 7), (300, 300), (None, 1)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(51, 101), 51), 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_placeholders_and_scaling(spark):
    nodes = spark.createDataFrame([("a", "Symbol"), ("r", "RepositorySnapshot"), ("x.ts", "File")], "id string, node_type string")
    rel = spark.createDataFrame([("a", "x.js", "EXPORTS"), ("r", "a", "CONTAINS"), ("a", "m:__module__:1", "CALLS")], "from_id string, to_id string, rel_type string")
    assert {tuple(r) for r in graph.placeholders(nodes, rel).collect()} == {("x.js", "File"), ("m:__module__:1", "Symbol")}
    copies, edges = graph.scaled(nodes, rel, 50)
    assert copies.count() == 100 and edges.count() == 100 and copies.select("id").distinct().count() == 100
    crossing = edges.where("regexp_extract(from_id, '^(S[0-9]+)', 1) <> regexp_extract(to_id, '^(S[0-9]+)', 1)").count()
    assert crossing < 12


#: Scenario -> (imports total, resolved, external; exports total, resolved; calls total, resolved; tests direct, indirect; errors).
SCENARIOS = {
    "same-file": (0, 0, 0, 2, 2, 1, 1, 0, 0, 0), "cross-file": (1, 1, 0, 1, 1, 1, 1, 0, 0, 0), "aliased-imports": (1, 1, 0, 1, 1, 1, 1, 0, 0, 0), "default-import": (1, 1, 0, 1, 1, 1, 1, 0, 0, 0),
    "re-exports": (1, 1, 0, 2, 2, 1, 1, 0, 0, 0), "circular-deps": (2, 2, 0, 4, 4, 3, 1, 0, 0, 2), "ambiguous-symbols": (2, 2, 0, 4, 2, 4, 2, 0, 0, 4), "dynamic-calls": (0, 0, 0, 2, 2, 5, 1, 0, 0, 3),
    "methods": (0, 0, 0, 1, 1, 3, 2, 0, 0, 1), "unresolved-imports": (4, 0, 4, 1, 1, 1, 0, 0, 0, 1), "test-to-symbol": (1, 1, 0, 3, 3, 11, 5, 3, 2, 6),
}


def test_resolver_scenarios(spark):
    r = Resolver(scenario_facts(spark))
    part = lambda path: path.split("/")[0]
    imports, exports, calls = r.import_edges().collect(), r.export_edges().collect(), r.calls.collect()
    passed_on = r.facts.exports.where("source_specifier IS NOT NULL OR symbol_name = '*'").collect()
    tests, errors = r.tested_by().collect(), r.errors().collect()
    for name, want in SCENARIOS.items():
        own = lambda rows, column="file_path", name=name: [x for x in rows if part(x[column]) == name]
        e, c, i, t = own(exports), own(calls), own(imports), own(tests, "test_id")
        again = len(own(passed_on))
        got = (
            len(i), sum(x["status"] == "resolved" for x in i), sum(x["status"] == "external" for x in i), len(e) + again, sum(x["symbol_id"] is not None for x in e) + again,
            len(c), sum(x["callee_id"] is not None for x in c), sum(x["coverage_type"] == "direct" for x in t), sum(x["coverage_type"] == "indirect" for x in t), len(own(errors, "file")),
        )
        assert got == want, name
    edges = {(x["caller_id"], x["callee_id"], x["confidence"]) for x in calls if x["callee_id"]}
    assert ("methods/index.js:clone:19", "methods/index.js:getValue:10", "medium") in edges
    assert ("dynamic-calls/index.js:__module__:1", "dynamic-calls/index.js:invoke:9", "high") in edges
    assert ("ambiguous-symbols/index.js:d:7", "ambiguous-symbols/date-utils.js:format:4", "high") in edges
    assert ("stars/app.ts:start:4", "stars/lib/ring.ts:turn:3", "high") in edges  # through two stars, one of them in a cycle
    assert ("stars/app.ts:start:4", "stars/lib/index.ts:own:3", "high") in edges  # a star replaces nothing
    assert ("stars/app.ts:__module__:1", "stars/lib/deep.ts:far:5", "high") in edges
    assert {x["category"] for x in calls if x["called_name"] == "handler"} == {"callback"}


APP = """import helper, { fmt as format, type T } from './lib/util.js';
import * as ns from './lib';
import './side';
// TODO: split this file
export default function run(a: number): void {
  const inner = format(a); // FIXME drop
  ns.go(inner, handler);
  helper.deep.call(a);
  table[key](1);
}
export const twice = async (x) => { return helper(x); };
export class Box extends Base {
  private size = 1;
  constructor(size) { super(size); this.open(); }
  static make<T>(x: T): Box { return new Box(x); }
  open() { if (this.size) { return /a(b)/.test('x(y)'); } }
}
export interface Shape { area(): number }
export enum Color { Red }
export { twice as double, Box };
export * from './more';
let plain = 3, other = function () { return plain; }
"""
SPEC = "import { run } from './app';\ndescribe('run', () => {\n  it('works', () => {\n    run(1);\n  });\n});\n"


def scanned(spark):
    return extract.scan(spark.createDataFrame([("src/app.ts", APP), ("src/app.test.ts", SPEC), ("src/none.ts", None), ("src/broken.ts", "export const = ( { [")], "path string, text string"))


def test_scanner(spark):
    got = {r["path"]: r for r in scanned(spark).collect()}
    app = got["src/app.ts"]
    assert [(s["name"], s["kind"], s["start_line"], s["end_line"]) for s in app["symbols"]] == [
        ("run", "function", 5, 10), ("twice", "function", 11, 11), ("Box", "class", 12, 17), ("constructor", "method", 14, 14), ("make", "method", 15, 15), ("open", "method", 16, 16),
        ("Shape", "interface", 18, 18), ("Color", "enum", 19, 19), ("plain", "const", 22, 22), ("other", "function", 22, 22),
    ]
    assert [(i["specifier"], i["stmt"], i["local"], i["imported"], i["is_default"], i["is_namespace"]) for i in app["imports"]] == [
        ("./lib/util.js", 0, "helper", "default", True, False), ("./lib/util.js", 0, "format", "fmt", False, False), ("./lib/util.js", 0, "T", "T", False, False), ("./lib", 1, "ns", "*", False, True), ("./side", 2, None, None, False, False),
    ]
    assert [(e["symbol_name"], e["export_type"], e["source_specifier"], e["source_name"]) for e in app["exports"]] == [
        ("run", "default", None, None), ("twice", "named", None, None), ("Box", "named", None, None), ("Shape", "named", None, None), ("double", "named", None, "twice"), ("Box", "named", None, None), ("*", "named", "./more", None),
    ]
    calls = [(c["called_name"], c["call_type"], c["line"]) for c in app["calls"]]
    assert calls == [("format", "direct", 6), ("ns.go", "method", 7), ("helper.deep.call", "method", 8), ("table[key]", "dynamic", 9), ("helper", "direct", 11), ("this.open", "method", 14)]
    assert app["calls"][1]["arguments"] == ["inner", "handler"]
    assert [(m["marker_type"], m["text"], m["line"]) for m in app["markers"]] == [("TODO", "split this file", 4), ("FIXME", "drop", 6)]
    spec = got["src/app.test.ts"]
    assert spec["is_test"] and [(t["test_name"], t["start_line"], t["end_line"]) for t in spec["tests"]] == [("run", 2, 6), ("works", 3, 5)]
    assert got["src/none.ts"]["symbols"] == [] and not app["error"]


def test_scan_to_resolution(spark):
    r = Resolver(extract.facts(scanned(spark)))
    assert {(x["symbol_id"], x["test_id"], x["coverage_type"]) for x in r.tested_by().collect()} == {("src/app.ts:run:5", "src/app.test.ts:works:3", "direct")}
    assert {x["rel_type"] for x in r.relationships().select("rel_type").distinct().collect()} == {"CALLS", "EXPORTS", "IMPORTS", "TESTED_BY"}


def test_pattern_tier(spark):
    df = spark.createDataFrame([("a.ts", APP)], "path string, text string")
    got = {(r["kind"], r["name"]) for r in extract.pattern_facts(df).collect()}
    assert {("class", "Box"), ("interface", "Shape"), ("import", "./lib"), ("export", "twice")} <= got
    assert [(r["line"], r["marker_type"], r["text"], r["marker_id"]) for r in extract.markers(df).orderBy("line").collect()] == [(4, "TODO", "split this file", "a.ts:TODO:4"), (6, "FIXME", "drop", "a.ts:FIXME:6")]


def test_retrieval_edges(spark):
    docs = spark.createDataFrame([("a", "alpha beta beta"), ("b", "alpha gamma"), ("c", ""), ("d", None)], "path string, text string")
    asked = spark.createDataFrame([(1, "beta"), (2, ""), (3, "alpha"), (4, "beta beta")], "query_id long, text string")
    chunks = retrieval.chunk(docs)
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in retrieval.keyword_search(chunks, asked).collect()}
    assert set(got) == {(1, "a:1"), (3, "a:1"), (3, "b:1"), (4, "a:1")} and got[(4, "a:1")] == pytest.approx(2 * got[(1, "a:1")], abs=2e-6)
    assert {r["query_id"] for r in retrieval.ngram_search(chunks, asked).collect()} == {1, 3, 4}


def test_expansions_in_rounds_are_those_of_all_pairs(spark):
    words = lambda i: ["the", f"even{i % 2}", f"third{i % 3}", f"tenth{i % 10}", f"pair{i // 2}", f"own{i}", f"mix{i * 7 % 11}"]
    docs = spark.createDataFrame([(f"d{i}", " ".join(words(i))) for i in range(64)], "path string, text string")
    asked = spark.createDataFrame([(1, "own5 the"), (2, "even1 third2"), (3, "the"), (4, "pair3 pair9 tenth4"), (5, "")], "query_id long, text string")
    chunks = retrieval.chunk(docs)
    whole = sorted(map(tuple, retrieval.expansions(chunks, asked, most=3, rounds=()).collect()))
    df = {w: sum(w in words(i) for i in range(64)) for i in range(64) for w in words(i)}
    best = []
    for q, text in [(1, "own5 the"), (2, "even1 third2"), (3, "the"), (4, "pair3 pair9 tenth4")]:
        near = []
        for x in text.split():
            for y in {w for w in df if w not in text.split()}:
                c = sum(x in words(i) and y in words(i) for i in range(64))
                if c and 1.5 < (pmi := round(math.log2(c * 64 / (df[x] * df[y])), 6)) < 20:
                    near.append((-pmi, y, x))
        best += [(q, k + 1, y, x, -p) for k, (p, y, x) in enumerate(sorted(near)[:3])]
    assert whole == sorted(best)
    assert sorted(map(tuple, retrieval.expansions(retrieval.split_tokens(chunks), asked, most=3, rounds=(2.0, 1.8)).collect())) == whole


def test_metrics(spark):
    results = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 3, "x")], "query_id long, rank int, file_path string")
    gold = spark.createDataFrame([(1, "x"), (1, "z"), (2, "x")], "query_id long, file_path string")
    got = {r["query_id"]: (r["hits"], r["p"], r["r"]) for r in evaluate.at_k(results, gold, 2).collect()}
    assert got == {1: (1, 0.5, 0.5), 2: (0, None, 0.0)}
    values = spark.createDataFrame([("a", float(v)) for v in range(15)] + [("b", 1.0), ("b", 1.0)], "k string, v double")
    got = {r["k"]: (r["n"], r["p50"], r["p95"], r["p99"]) for r in evaluate.order_statistics(values, "k", "v").collect()}
    assert got == {"a": (15, 7.0, 14.0, 14.0), "b": (2, 1.0, 1.0, 1.0)}


def test_classify_and_manifest(spark):
    df = spark.createDataFrame([("a.ts", b"describe()"), ("b.js", b"x\0y"), ("node_modules/c.js", b""), ("d.md", b"" + b"z" * 2_000_000), ("e.spec.tsx", b"")], "path string, content binary")
    got = {r["path"]: r for r in manifest.classify(df).collect()}
    assert set(got) == {"a.ts", "b.js", "d.md", "e.spec.tsx"}
    assert got["b.js"]["is_binary"] and not got["b.js"]["analyzable"] and got["a.ts"]["analyzable"] and got["a.ts"]["test_framework"] == "jest"
    assert got["d.md"]["hash"] == "" and len(got["a.ts"]["hash"]) == 64 and got["e.spec.tsx"]["is_test"]
    m = manifest.manifest(manifest.classify(df)).first()
    assert (m["file_count"], m["analyzable_count"], m["languages"], m["outcome"]) == (4, 2, "javascript=1,typescript=2,unknown=1", "COMPLETED")
    assert manifest.manifest(manifest.classify(df.limit(0))).first()["outcome"] == "COMPLETED_WITH_WARNINGS"


def test_contribution(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    found = contribute.candidates({"gap": ids("a", "b"), "todo": ids("a", "a", "c")})
    assert {(r["target_id"], r["sources"], r["n_evidence"]) for r in found.collect()} == {("a", "gap,todo", 2), ("b", "gap", 1), ("c", "todo", 1)}
    parts = spark.createDataFrame([("a", "f", 0.5, 0.1), ("b", "g", 0.9, 0.0), ("c", "h", 1.0, 0.0)], "target_id string, file_path string, impact double, complexity double")
    busy = spark.createDataFrame([("h",)], "file_path string")
    assert [(r["rank"], r["target_id"], r["score"], r["confidence"]) for r in contribute.rank(found, parts, busy).orderBy("rank").collect()] == [(1, "a", 2.4, "high"), (2, "b", 1.9, "medium")]


def test_files_and_sinks(spark, tmp_path):
    for name in ("a.ts", "sub/b.js", ".hid/c.js", "node_modules/d.js", "e.py", "dist/f.mjs"):
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_text(f"// {name}")
    walk = lambda kind: {r["path"] for r in files.read_tree(spark, str(tmp_path / "tree"), kind).select("path").collect()}
    assert walk("graph") == {"a.ts", "sub/b.js", "node_modules/d.js"} and walk("search") == {"a.ts", "sub/b.js"} == walk("parse")
    nodes = spark.createDataFrame([("a", "Symbol"), ("t", "Test")], "id string, node_type string")
    rel = spark.createDataFrame([("a", "t", "TESTED_BY"), ("a", "a", "CALLS")], "from_id string, to_id string, rel_type string")
    sinks.write_graph(nodes, rel, str(tmp_path / "graph"))
    _, back = sinks.read_graph(spark, str(tmp_path / "graph"))
    assert back.where("rel_type = 'CALLS'").count() == 1
    snap = lambda s, *paths: spark.createDataFrame([(p, s) for p in paths], "path string, snapshot_id string")
    for df in (snap("s1", "a", "b"), snap("s2", "c"), snap("s1", "d")):
        sinks.replace_snapshot(df, str(tmp_path / "snaps"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "snaps")).collect()} == {("d", "s1"), ("c", "s2")}
    sinks.write_report(nodes, str(tmp_path / "report"))
    assert len(json.loads((tmp_path / "report.json").read_text())) == 2 and (tmp_path / "report.md").read_text().startswith("| id | node_type |")


def test_streaming_snapshots(spark, tmp_path):
    from codequarry.streaming.snapshots import classify_arrivals

    schema = "snapshot_id string, path string, content binary"
    put = lambda n, *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put(1, ("s1", "a.ts", b"x"), ("s2", "b.js", b"y"))
    run = lambda: classify_arrivals(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), schema)
    run()
    put(2, ("s1", "c.ts", b"z"))
    run()
    run()
    got = {(r["snapshot_id"], r["path"], r["language"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("s1", "c.ts", "typescript"), ("s2", "b.js", "javascript")}
