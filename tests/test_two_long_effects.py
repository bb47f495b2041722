"""Two long fixed effects by conjugate gradients, and the components of their graph."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelfx.operators import absorb as ab
from panelfx.plans import fixtures as fx


def sparse_rows(rng, units=60, firms=40, moves=3):
    rows = []
    for u in range(units):
        for f in {int(x) for x in rng.integers(0, firms, moves)}:
            rows += [(u if u else None, f if f else None, float(rng.normal() + 0.1 * u - 0.2 * f), float(rng.normal() * (1 + f)), float(1 + (u + f) % 3))
                     for _ in range(1 + (u + f) % 2)]
    return rows


def dense_residuals(rows, column, weighted):
    units, firms = sorted({r[0] or 0 for r in rows}), sorted({r[1] or 0 for r in rows})
    d = np.zeros((len(rows), len(units) + len(firms)))
    for i, r in enumerate(rows):
        d[i, units.index(r[0] or 0)] = d[i, len(units) + firms.index(r[1] or 0)] = 1
    w = np.sqrt([r[4] if weighted else 1.0 for r in rows])
    y = np.array([r[column] for r in rows])
    beta = np.linalg.lstsq(d * w[:, None], y * w, rcond=None)[0]
    return y - d @ beta


@pytest.mark.parametrize("weight", [None, "w"])
def test_gradient_equals_dense(spark, weight):
    rows = sparse_rows(np.random.default_rng(3))
    df = spark.createDataFrame(rows, "u int, f int, y double, x double, w double").withColumn("id", F.monotonically_increasing_id()).repartition(5, "y")
    order = {r["y"]: i for i, r in enumerate(spark.createDataFrame(rows, "u int, f int, y double, x double, w double").collect())}
    out = ab.absorb_gradient(df.withColumn("key", F.col("y")), ["y", "x"], "u", "f", weight).collect()
    assert len(out) == len(rows)
    want = [dense_residuals(rows, c, weight is not None) for c in (2, 3)]
    for r in out:
        i = order[r["key"]]
        assert r["y"] == pytest.approx(want[0][i], abs=1e-7) and r["x"] == pytest.approx(want[1][i], abs=1e-7)


def test_rounds_are_few_and_values_the_alternating_ones(spark):
    df = fx.daily_users(spark, "/root/testdata/sf0.001").select("unit", "t", "y", "x")
    links = ab.key_links(df, ["y", "x"], "unit", "t")
    _, _, rounds = ab.two_way_effects(links, ["y", "x"])
    assert 0 < rounds < 20
    a = {(r["unit"], r["t"]): r["y"] for r in ab.absorb(df, ["y"], "unit", "t", method="gradient").collect()}
    b = {(r["unit"], r["t"]): r["y"] for r in ab.absorb(df, ["y"], "unit", "t", method="iterative").collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 for k in a)


def test_components_and_missing_values(spark):
    """Two parts that nothing links, a NULL level in one of them, and a constant column."""
    rows = [(1, 1, 1.0), (1, 2, 2.0), (2, 2, 4.0), (3, 2, 6.0), (10, 11, 110.0), (11, 11, 121.0), (11, 12, 132.0), (None, 12, 3.0), (1, 1, None)]
    df = spark.createDataFrame([(*r, 7.0) for r in rows], "a int, b int, y double, c double")
    assert ab.effect_components(ab.key_links(df, ["c"], "a", "b")) == (2, 6 + 4 - 2)
    out = ab.absorb_gradient(df, ["y", "c"], "a", "b").collect()
    # a forest has no residual: every pair of levels adds a level
    assert len(out) == 8 and all(abs(r["y"]) < 1e-8 and abs(r["c"]) < 1e-8 for r in out)


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, b int, y double")
    assert ab.absorb_gradient(df, ["y"], "a", "b").count() == 0
