"""Every core query with an SQL statement against DuckDB, on the smallest data set."""

import datetime
import decimal
import glob
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")

from lodestrata.plans import registry  # noqa: E402


def normal(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return tuple(map(normal, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    r = duck.execute(registry.oracle_sql()[name])
    at = [d[0] for d in r.description]
    assert sorted(at) == cols
    want = sorted((tuple(normal(row[at.index(c)]) for c in cols) for row in r.fetchall()), key=repr)
    assert sorted((tuple(normal(row[c]) for c in cols) for row in df.collect()), key=repr) == want


def test_queries_without_sql_give_rows(spark):
    for name in set(registry.queries()) - set(registry.oracle_sql()):
        assert registry.queries()[name](spark, SF).count() > 0
