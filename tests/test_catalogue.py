"""Every registered query of the engine against its SQL in DuckDB, at the smallest scale."""

import os

import pytest

from varloom.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "supplier nation events lineitem".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def told(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: repr(round(v, 9)) if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows), sorted(names)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    got = told([tuple(r) for r in df.collect()], df.columns)
    rel = duck.sql(catalogue.oracle_sql()[name])
    assert got == told(rel.fetchall(), rel.columns)
