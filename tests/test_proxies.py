"""Every query against its SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest
from quirelight.plans import documents, proxies, rewrites

QUERIES = proxies.queries() | documents.queries() | rewrites.queries()
SQL = proxies.oracle_sql() | documents.oracle_sql() | rewrites.oracle_sql()
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    return con


def rows(cells):
    return sorted(str(tuple(round(v, 9) + 0.0 if isinstance(v, float) and not math.isnan(v) else v for v in r)) for r in cells)


@pytest.mark.parametrize("name", SQL)
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    found = rows(got.select(cols).collect())
    assert found == rows(want.select(*cols).fetchall())
    assert found
