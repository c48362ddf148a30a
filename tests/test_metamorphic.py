"""Properties that hold for any data: rewritten queries agree with each other."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quern.engine import Engine

N = st.integers(-3, 3)


@pytest.fixture(scope="module")
def db(spark):
    spark.createDataFrame([(i, i % 5 if i % 7 else None, (i * 37) % 11) for i in range(60)], "id bigint, a bigint, b bigint").createOrReplaceTempView("meta")
    return Engine(spark)


def one(db, sql):
    return sorted(map(str, db.query(sql).collect()))


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(x=N, y=N)
def test_predicates(db, x, y):
    p, q = f"a > {x}", f"b < {y + 5}"
    assert one(db, f"SELECT id FROM meta WHERE {p} AND {q}") == one(db, f"SELECT id FROM meta WHERE {q} AND {p}")
    assert one(db, f"SELECT id FROM meta WHERE NOT ({p} OR {q})") == one(db, f"SELECT id FROM meta WHERE NOT {p} AND NOT {q}")
    assert one(db, f"SELECT id FROM meta WHERE NOT (NOT {p})") == one(db, f"SELECT id FROM meta WHERE {p}")
    assert one(db, f"WITH c AS (SELECT * FROM meta WHERE {p}) SELECT id FROM c WHERE {q}") == one(db, f"SELECT id FROM (SELECT * FROM meta WHERE {p}) d WHERE {q}")
    assert set(one(db, f"SELECT id FROM meta WHERE {p} LIMIT 5")) <= set(one(db, f"SELECT id FROM meta WHERE {p}"))


def test_identities(db):
    assert one(db, "SELECT x.id, y.id FROM meta x JOIN meta y ON x.a = y.b") == one(db, "SELECT x.id, y.id FROM meta y JOIN meta x ON x.a = y.b")
    assert one(db, "SELECT a FROM meta UNION SELECT a FROM meta") == one(db, "SELECT DISTINCT a FROM meta")
    assert db.query_one("SELECT COUNT(*) = SUM(1) FROM meta")[0] is True
    assert tuple(db.query_one("SELECT COUNT(*), SUM(a), MIN(a) FROM meta WHERE id < 0")) == (0, None, None)
