"""Snapshots that arrive in parts, chains and cycles of re-exports, the shared folder."""

from __future__ import annotations

import pytest

from codequarry.operators.resolve import Facts, Resolver
from codequarry.streaming.snapshots import classify_arrivals, merged

SCHEMA = "snapshot_id string, path string, content binary"


def arrive(spark, folder, *rows, **options):
    spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    classify_arrivals(spark, f"{folder}/in", f"{folder}/out", f"{folder}/state", SCHEMA, **options)
    found = spark.read.parquet(f"{folder}/out").collect()
    return sorted((r["snapshot_id"], r["path"], r["size"]) for r in found)


@pytest.mark.parametrize("complete", [True, False])
def test_a_path_in_two_snapshots(spark, tmp_path, complete):
    got = arrive(spark, tmp_path, ("s1", "a.ts", b"x"), ("s2", "a.ts", b"yy"), complete=complete)
    assert got == [("s1", "a.ts", 1), ("s2", "a.ts", 2)]


def test_a_snapshot_over_two_batches(spark, tmp_path):
    arrive(spark, tmp_path, ("s1", "a.ts", b"x"), ("s1", "b.ts", b"x"), ("s2", "a.ts", b"x"), complete=False)
    got = arrive(spark, tmp_path, ("s1", "c.ts", b"zzz"), ("s1", "a.ts", b"xxxx"), complete=False)
    assert got == [("s1", "a.ts", 4), ("s1", "b.ts", 1), ("s1", "c.ts", 3), ("s2", "a.ts", 1)]


def test_a_batch_that_runs_again(spark, tmp_path):
    """What batch 1 wrote doesn't count when it runs once more, whatever it wrote the first time."""
    arrive(spark, tmp_path, ("s1", "a.ts", b"x"), complete=False)
    arrive(spark, tmp_path, ("s1", "b.ts", b"x"), complete=False)
    from codequarry.operators.manifest import classify

    again = classify(spark.createDataFrame([("s1", "c.ts", b"x")], SCHEMA), "snapshot_id")
    assert sorted(r["path"] for r in merged(again, 1, f"{tmp_path}/out").collect()) == ["a.ts", "c.ts"]


def resolver(spark, exports, symbols):
    files = sorted({e[0] for e in exports} | {s[0] for s in symbols})
    empty = lambda schema: spark.createDataFrame([], schema)
    return Resolver(Facts(
        files=spark.createDataFrame([(f, False) for f in files], "path string, is_test boolean"),
        symbols=spark.createDataFrame([(f"{f}:{n}:1", n, "function", f, 1, 9, 0) for f, n in symbols], "symbol_id string, name string, kind string, file_path string, start_line int, end_line int, ord int"),
        tests=empty("test_id string, file_path string, start_line int, end_line int, ord int"),
        imports=empty("file_path string, stmt int, specifier string, line int, local string, imported string, is_default boolean, is_namespace boolean, ord int"),
        exports=spark.createDataFrame([(f, n, "named", 1, s, None, k) for k, (f, n, s) in enumerate(exports)], "file_path string, symbol_name string, export_type string, line int, source_specifier string, source_name string, ord int"),
        calls=empty("file_path string, called_name string, call_type string, line int, arguments array<string>, ord int"),
    ))


def test_a_chain_of_forty_re_exports(spark):
    exports = [("src/f0.ts", "x", None), *((f"src/f{i}.ts", "x" if i % 2 else "*", f"./f{i - 1}") for i in range(1, 41))]
    got = {r["file_path"]: r["symbol_id"] for r in resolver(spark, exports, [("src/f0.ts", "x")]).export_map.collect() if r["name"] == "x"}
    assert got == {f"src/f{i}.ts": "src/f0.ts:x:1" for i in range(41)}


def test_files_that_re_export_from_one_another(spark):
    """Each has its own x and gives the other's after it: the two would change places in every round."""
    exports = [("s/a.ts", "x", None), ("s/b.ts", "x", None), ("s/a.ts", "x", "./b"), ("s/b.ts", "x", "./a"), ("s/c.ts", "x", "./a")]
    got = {(r["file_path"], r["name"]): r["symbol_id"] for r in resolver(spark, exports, [("s/a.ts", "x"), ("s/b.ts", "x")]).export_map.collect()}
    assert set(got) == {("s/a.ts", "x"), ("s/b.ts", "x"), ("s/c.ts", "x")} and set(got.values()) <= {"s/a.ts:x:1", "s/b.ts:x:1"}


def test_a_cluster_must_name_its_shared_folder(spark):
    from codequarry.sources import shared

    class Context:
        master = "spark://somewhere:7077"

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = Context  # noqa: N815

    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_dir(Session)


def test_files_at_the_root(spark):
    exports = [("a.ts", "x", None), ("b.ts", "x", "./a"), ("s/c.ts", "x", "../b")]
    got = {(r["file_path"], r["symbol_id"]) for r in resolver(spark, exports, [("a.ts", "x")]).export_map.collect()}
    assert got == {("a.ts", "a.ts:x:1"), ("b.ts", "a.ts:x:1"), ("s/c.ts", "a.ts:x:1")}


def test_a_file_with_many_calls_and_scopes_makes_no_product(spark):
    """Nested and neighbouring scopes, some longer than a bucket: each line's scopes, by trying all."""
    from codequarry.operators.resolve import BUCKET, inside

    scopes = [("f.ts", k, k + n, f"{k}+{n}") for k in range(1, 2000, 37) for n in (0, 3, 40, 5 * BUCKET)] + [("f.ts", 9, 2, "none"), ("g.ts", 1, 99, "g")]
    lines = [("f.ts", n) for n in range(0, 4000, 13)] + [("h.ts", 5), ("f.ts", None)]
    got = inside(spark.createDataFrame(lines, "file_path string, line int"), spark.createDataFrame(scopes, "file_path string, start_line int, end_line int, name string"))
    want = sorted((f, n, name) for f, n in lines for g, a, b, name in scopes if f == g and n is not None and a <= n <= b)
    assert sorted(tuple(r) for r in got.select("file_path", "line", "name").collect()) == want


def test_stored_graph_in_the_catalog(spark, tmp_path):
    from codequarry.sources import sinks

    nodes = spark.createDataFrame([("a", "Symbol"), ("t", "Test")], "id string, node_type string")
    rel = spark.createDataFrame([("a", "t", "TESTED_BY"), ("a", "a", "CALLS"), ("b", "a", "CALLS")], "from_id string, to_id string, rel_type string")
    sinks.write_graph(nodes, rel, f"{tmp_path}/graph")
    names = sinks.register_graph(spark, f"{tmp_path}/graph", "small_")
    try:
        for by, folder in (("to_id", "relationships"), ("from_id", "relationships_from")):
            assert sinks.read_graph(spark, f"{tmp_path}/graph", by)[1].count() == 3 == spark.table(f"small_{folder}").count()
        found = spark.sql("SELECT from_id FROM small_relationships WHERE rel_type = 'CALLS' AND to_id = :id ORDER BY from_id", args={"id": "a"})
        assert [r[0] for r in found.collect()] == ["a", "b"]
        said = {r["info_name"]: r["info_value"] for r in spark.sql("DESCRIBE EXTENDED small_relationships to_id").collect()}
        assert said["distinct_count"] == "2" and sinks.stored_bytes(spark, f"{tmp_path}/graph") > 0
    finally:
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_a_candidate_that_is_not_there(spark):
    from codequarry.operators import contribute

    found = spark.createDataFrame([("a", "gap", 1), ("gone", "gap,undocumented", 2)], "target_id string, sources string, n_evidence long")
    symbols = spark.createDataFrame([("a", "a", "function", "src/f.ts", "typescript", 1, 20)], "id string, name string, kind string, file_path string, language string, start_line int, end_line int")
    none = spark.createDataFrame([], "file_path string")
    got = {r["target_id"]: r for r in contribute.validate(found, symbols, none, none, none, contribute.Profile(domains=("src/",))).collect()}
    assert got["a"]["valid"] and not got["gone"]["valid"] and not got["gone"]["exists"] and not got["gone"]["fits_skills"]
    shown = {r["target_id"]: r["confidence"] for r in contribute.described(contribute.validate(found, symbols, none, none, none)).collect()}
    assert shown == {"a": "medium", "gone": "low"}


def test_a_changed_table_has_another_fingerprint(spark, tmp_path):
    from codequarry.sources.shared import exists, fingerprint_of

    path = f"{tmp_path}/t.parquet"
    assert fingerprint_of(spark, path) == "none" and not exists(spark, path)
    spark.range(10).write.parquet(path)
    first = fingerprint_of(spark, path)
    assert first == fingerprint_of(spark, path) and exists(spark, path)
    spark.range(11).write.mode("append").parquet(path)
    assert fingerprint_of(spark, path) != first
