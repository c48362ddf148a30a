"""Every registered query of the engine against its oracle SQL on the smallest tables."""

import numbers
import os

import duckdb
import pandas as pd
import pytest

from quern import queries as registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return ("bool", bool(v))
    return round(float(v), 9) if isinstance(v, numbers.Number) else str(v)


def lines(df):
    return sorted(str(tuple(map(plain, r))) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(DIR):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DIR}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, DIR).toPandas()
    if (sql := registry.oracle_sql().get(name)) is None:
        assert len(got)
        return
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert lines(got) == lines(want)
