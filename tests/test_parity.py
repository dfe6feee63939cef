"""Every registered query with an oracle gives DuckDB's rows, names and types on the small tables."""

import math

import duckdb
import pytest

from tidemark.plans.registry import ORACLES, QUERIES, load

load()
TABLES = "region nation customer supplier part orders lineitem events".split()
TYPES = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "INTEGER": "int", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(name, spark, duck, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == names
    kinds = dict(df.dtypes)
    assert {c: TYPES.get(str(t)) for c, t in zip(rel.columns, rel.types)} == kinds
    got = sorted(repr(tuple(_plain(r[c]) for c in names)) for r in df.collect())
    want = sorted(repr(tuple(map(_plain, r))) for r in duck.sql(f"select {', '.join(names)} from rel").fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_runs(name, spark, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() >= 0
