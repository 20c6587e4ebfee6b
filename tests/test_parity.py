"""Registered queries against their SQL on DuckDB, on the smallest driver tables."""

from __future__ import annotations

import duckdb
import pytest

from codequarry import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 6) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list) else v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, duck, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    want = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, want.fetchall())


def test_every_query_has_sql():
    assert set(registry.ORACLES) == set(registry.QUERIES)


def test_depths_differ(spark, duck, sf_dir):
    sizes = [duck.execute(f"SELECT count(*) FROM ({registry.ORACLES[q]})").fetchall()[0][0] for q in ("q9_neigh_r1", "q9_neigh_r2", "q9_neigh_r3")]
    assert sizes == sorted(set(sizes))
