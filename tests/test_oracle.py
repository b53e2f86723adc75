"""Every query against its SQL counterpart in a second engine, on the smallest driver tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from corpusprep.plans import catalog, oracle

SF_DIR = Path("/root/testdata/sf0.001")
QUERIES, ORACLE = catalog.QUERIES, oracle.ORACLE
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in SF_DIR.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def _sorted(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert QUERIES.keys() <= contract.queries().keys()
    assert ORACLE.keys() <= contract.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, str(SF_DIR))
    rel = duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    duck_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema.fields} == duck_types
    expected = _sorted(rel.fetchall(), rel.columns)
    assert _sorted(df.collect(), df.columns) == expected
    assert expected


def test_entry_runs(spark):
    assert contract.entry(spark).count() > 0
