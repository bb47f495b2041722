"""Every registered query with SQL, run in both engines on the smallest data."""

import pytest
from check import compare, connect

from panelfx.plans.catalog import REGISTRY

QUERIES = {name: e.run for name, e in REGISTRY.items()}
SQL = {name: e.sql for name, e in REGISTRY.items() if e.sql is not None}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan
    if name not in SQL:
        assert rows
        return
    cur = duck.execute(SQL[name])
    assert compare(df.columns, rows, [d[0] for d in cur.description], cur.fetchall()) == "ok"


def test_sql_covers_queries():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {"b2_random_intercept"}
