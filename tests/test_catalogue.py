"""Every query of the catalogue against its SQL in DuckDB."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

from chronofold.plans import catalogue  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in catalogue.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return ""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got or name in ("sql_intersect",)
    oracle = catalogue.oracle_sql().get(name)
    if oracle:
        cur = duck.execute(oracle)
        want = rows([c[0] for c in cur.description], cur.fetchall())
        assert sorted(df.columns) == sorted(c[0] for c in cur.description)
        assert got == want
