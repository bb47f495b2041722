"""Exact quantiles without gathering a group, against NumPy."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelfx.operators import describe
from panelfx.operators.describe import group_quantiles, histogram

QS = [0.0, 0.1, 0.2, 0.5, 0.75, 1.0]


def check(spark, values_by_group, accuracy=10_000, most=10_000):
    rows = [(g, float(v)) for g, vs in values_by_group.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r.g, r.q): r.value for r in group_quantiles(df, ["g"], "v", QS, accuracy, most).collect()}
    assert len(got) == len(values_by_group) * len(QS)
    for g, vs in values_by_group.items():
        for q in QS:
            assert got[g, q] == pytest.approx(np.quantile(vs, q), rel=1e-12, abs=1e-12), (g, q, len(vs))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.integers(-3, 3), st.floats(-1e6, 1e6)), min_size=1, max_size=60))
def test_small_groups(spark, values):
    check(spark, {"a": values})


def test_group_sizes_around_the_ladder(spark):
    rng = np.random.default_rng(5)
    check(spark, {f"n{n}": rng.normal(size=n) for n in (1, 2, 3, 19, 20, 21, 199, 200, 201, 2500)}, accuracy=1000)


def test_hot_group_with_few_distinct_values(spark):
    rng = np.random.default_rng(6)
    check(spark, {"hot": rng.integers(0, 4, 30_000), "cold": rng.normal(size=40), "flat": np.full(500, 2.5)}, accuracy=200)


def test_coarse_sketch_still_exact(spark):
    rng = np.random.default_rng(7)
    check(spark, {"a": rng.lognormal(size=20_000)}, accuracy=100)


@pytest.mark.parametrize("most", [3, 70])
def test_brackets_are_narrowed(spark, most, monkeypatch):
    """A coarse sketch leaves thousands of values in a bracket; what is sorted in the end is bounded all the same."""
    rng = np.random.default_rng(9)
    seen = []
    whole = describe._narrowed

    def narrowed(parts, keys, limit, cuts=64):
        out = whole(parts, keys, limit, cuts)
        first = parts.filter("_v IS NOT NULL").groupBy(*keys, "_i").count().agg(F.max("count")).first()[0]
        last = out.filter("_v IS NOT NULL").groupBy(*keys, "_i").count().agg(F.max("count")).first()[0]
        seen.append((first, last))
        return out

    monkeypatch.setattr(describe, "_narrowed", narrowed)
    groups = {"even": rng.normal(size=9000), "tail": np.exp(rng.normal(size=9000) * 12), "ties": rng.integers(0, 3, 4000),
              "step": np.concatenate([np.zeros(5000), rng.normal(size=4000)]), "one": [4.0]}
    check(spark, groups, accuracy=100, most=most)
    assert seen[0][0] > 200 and seen[0][1] <= most


def test_narrowing_without_groups_and_with_a_null_group(spark):
    rng = np.random.default_rng(10)
    v = rng.normal(size=6000)
    df = spark.createDataFrame([(None if i % 2 else "a", float(x)) for i, x in enumerate(v)], "g string, v double")
    got = group_quantiles(df, [], "v", [0.3], 50, 20).first()["value"]
    assert got == pytest.approx(np.quantile(v, 0.3), rel=1e-12)
    got = {r["g"]: r["value"] for r in group_quantiles(df, ["g"], "v", [0.3], 50, 20).collect()}
    assert got[None] == pytest.approx(np.quantile(v[1::2], 0.3), rel=1e-12) and got["a"] == pytest.approx(np.quantile(v[::2], 0.3), rel=1e-12)


def test_without_groups_and_with_nulls(spark):
    df = spark.range(1001).select(F.when(F.col("id") % 10 != 0, F.col("id").cast("double")).alias("v"))
    want = np.quantile([i for i in range(1001) if i % 10], [0.25, 0.5])
    got = [r.value for r in group_quantiles(df, [], "v", [0.25, 0.5]).orderBy("q").collect()]
    np.testing.assert_allclose(got, want)


def test_histogram_counts_every_row(spark):
    rng = np.random.default_rng(8)
    v = np.round(rng.normal(size=3000), 2)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    got = histogram(df, "v", 60).orderBy("bin").toPandas()
    assert got.n.sum() == 3000 and len(got) == 60
    assert got.lo[0] == v.min() and got.hi[59] == pytest.approx(v.max())
