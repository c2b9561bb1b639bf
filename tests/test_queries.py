"""Every query with SQL agrees with DuckDB on the smallest tables; every other one runs."""

from __future__ import annotations

import os

import duckdb
import pytest

from tidemark.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in sorted(os.listdir(SF)):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{file}')")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    show = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[k]) for k in order) for r in rows), sorted(columns)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    if name in ORACLE_SQL:
        ran = duck.execute(ORACLE_SQL[name])
        columns = [c[0] for c in ran.description]
        assert got == canonical(ran.fetchall(), columns)
