"""The regression engine against dense linear algebra on collected rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelfx.functions.tails import t_p
from panelfx.operators import its, regress as rg
from panelfx.operators import gram as gm
from panelfx.operators.describe import collapse
from panelfx.operators.design import Design
from panelfx.plans import fixtures as fx


def dense(x, y, cl):
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    e = y - x @ b
    m = np.linalg.inv(x.T @ x)
    n, k = x.shape
    groups = np.unique(cl)
    score = np.array([x[cl == g].T @ e[cl == g] for g in groups])
    c = len(groups) / (len(groups) - 1) * (n - 1) / (n - k)
    out = {"iid": m * (e @ e) / (n - k), "HC1": m @ (x.T * e ** 2) @ x @ m * n / (n - k),
           "CR1": c * m @ score.T @ score @ m}
    meat, adj = np.zeros((k, k)), {}
    for g in groups:
        i = cl == g
        w, v = np.linalg.eigh(np.eye(i.sum()) - x[i] @ m @ x[i].T)
        r = np.where(w > 1e-9, 1 / np.sqrt(np.where(w > 1e-9, w, 1)), 0)
        adj[g] = (v * r) @ v.T
        s = x[i].T @ adj[g] @ e[i]
        meat += np.outer(s, s)
    out["CR2"] = m @ meat @ m
    ih = np.eye(n) - x @ m @ x.T

    def df(contrast):
        g = np.column_stack([ih[:, cl == q] @ adj[q] @ x[cl == q] @ m @ contrast for q in groups])
        om = g.T @ g
        return np.trace(om) ** 2 / (om ** 2).sum()
    return b, out, df


@pytest.fixture(scope="module")
def model(its_df):
    p = its_df.orderBy("unit", "t").toPandas()
    x = np.column_stack([np.ones(len(p)), p.cohort_14, p.year0, p.treat, p.since]
                        + [p.cohort_14 * p[c] for c in ("year0", "treat", "since")]).astype(float)
    return dense(x, p.y.to_numpy(), p.cluster.to_numpy())


@pytest.mark.parametrize("vcov", ["iid", "HC1", "CR1", "CR2"])
def test_cells_equal_rows_equal_dense(its_df, model, vcov):
    b, covs, df = model
    cells = its.its_cells(its_df, fx.ITS)
    fit = its.its_fit(cells, fx.ITS, cohort="full", vcov=vcov)
    rows = rg.ols(its_df, "y", Design().crossed(Design().factor("cohort", [9, 14], ref=9),
                                                Design().main("year0", "treat", "since")),
                  cluster="cluster", vcov=vcov)
    for f in (fit, rows):
        np.testing.assert_allclose(f.coef, b, rtol=1e-8, atol=1e-9)
        np.testing.assert_allclose(f.cov, covs[vcov], rtol=1e-7, atol=1e-10)
    if vcov == "CR2":
        np.testing.assert_allclose(fit.df, [df(c) for c in np.eye(len(b))], rtol=1e-6)
        contrast = np.array([0, 0, 0, 1, 14, 0, 0, 0.0])
        np.testing.assert_allclose(fit.contrast_df(contrast[None, :]), [df(contrast)], rtol=1e-6)


def test_cr2_with_a_coefficient_from_one_cluster(spark):
    rng = np.random.default_rng(3)
    n = 120
    cl = np.repeat(np.arange(8), 15)
    only = (cl == 2).astype(float)
    z = rng.normal(size=n)
    y = 1 + z + 2 * only + rng.normal(size=n) + cl * 0.1
    x = np.column_stack([np.ones(n), z, only])
    b, covs, _ = dense(x, y, cl)
    df = spark.createDataFrame([(float(a), float(o), float(v), int(c)) for a, o, v, c in zip(z, only, y, cl)],
                               "z double, o double, y double, c int")
    fit = rg.ols(df, "y", ["z", "o"], cluster="c", vcov="CR2")
    np.testing.assert_allclose(fit.cov, covs["CR2"], rtol=1e-6, atol=1e-10)


def test_matrix_paths_agree(spark, monkeypatch):
    df = spark.range(500).select(*[F.sin(F.col("id") * (i + 1)).alias(f"c{i}") for i in range(6)],
                                 (F.col("id") % 7 + 1).cast("double").alias("w"))
    cols = [f"c{i}" for i in range(6)]
    by_sql = gm.gram(df, cols, "w")
    monkeypatch.setattr(gm, "SQL_COLUMNS", 0)
    np.testing.assert_allclose(gm.gram(df, cols, "w"), by_sql, rtol=1e-10)


def test_large_offsets_do_not_hurt(spark):
    df = spark.range(200).select((F.lit(1e8) + F.col("id")).alias("x"),
                                 (F.lit(5e9) + 3 * F.col("id") + F.sin("id")).alias("y"))
    fit = rg.ols(df, "y", ["x"])
    i = np.arange(200)
    want = np.polyfit(i, 3 * i + np.sin(i), 1)[0]
    assert fit.coef[1] == pytest.approx(want, rel=1e-9)


def test_weights_and_missing_values(spark):
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=60), rng.uniform(0.5, 2, 60)
    y = 2 + 3 * x + rng.normal(size=60)
    rows = [(float(a), float(b), float(c)) for a, b, c in zip(x, y, w)]
    df = spark.createDataFrame(rows + [(None, 1.0, 1.0), (1.0, None, 1.0)], "x double, y double, w double")
    xx = np.column_stack([np.ones(60), x])
    m = np.linalg.inv(xx.T @ (xx * w[:, None]))
    b = m @ xx.T @ (w * y)
    e = y - xx @ b
    fit = rg.ols(df, "y", ["x"], weight="w", vcov="HC1")
    np.testing.assert_allclose(fit.coef, b, rtol=1e-9)
    np.testing.assert_allclose(fit.cov, m @ (xx.T * (w * e) ** 2) @ xx @ m * 60 / 58, rtol=1e-9)
    assert fit.n == 60


def test_collinear_terms_are_dropped_and_reported(spark):
    df = spark.range(50).select(F.sin("id").alias("a"), F.cos("id").alias("b"), F.sqrt("id").alias("y"))
    fit = rg.ols(df.withColumn("c", F.col("a") - 2 * F.col("b") + 1), "y", ["a", "b", "c"])
    assert fit.dropped == ["c"]
    dropped = {r.term: r.dropped for r in rg.tidy(fit).collect()}
    assert dropped == {"(Intercept)": False, "a": False, "b": False, "c": True}


def test_lincom_and_wald(its_df, model):
    b, covs, _ = model
    fit = its.its_fit(its.its_cells(its_df, fx.ITS), fx.ITS, cohort="full", vcov="CR1")
    row = rg.lincom(fit, [("end", {"treat": 1.0, "since": 14.0})]).first()
    c = np.array([0, 0, 0, 1, 14, 0, 0, 0.0])
    assert row.estimate == pytest.approx(c @ b, rel=1e-8)
    assert row.std_error == pytest.approx(np.sqrt(c @ covs["CR1"] @ c), rel=1e-7)
    assert row.p_value == pytest.approx(t_p(row.statistic, fit.n_clusters - 1), rel=1e-9)
    w = rg.wald(fit, ["treat", "since"]).first()
    i = [3, 4]
    assert w.chi2 == pytest.approx(b[i] @ np.linalg.solve(covs["CR1"][np.ix_(i, i)], b[i]), rel=1e-6)


def test_predictions_match_design(its_df, model):
    b, covs, _ = model
    fit = its.its_fit(its.its_cells(its_df, fx.ITS), fx.ITS, cohort="full", vcov="CR1")
    got = rg.predict(fit, its_df).orderBy("unit", "t").select("pred", "pred_se").toPandas()
    p = its_df.orderBy("unit", "t").toPandas()
    x = np.column_stack([np.ones(len(p)), p.cohort_14, p.year0, p.treat, p.since]
                        + [p.cohort_14 * p[c] for c in ("year0", "treat", "since")]).astype(float)
    np.testing.assert_allclose(got.pred, x @ b, rtol=1e-8)
    np.testing.assert_allclose(got.pred_se, np.sqrt(np.einsum("ij,jk,ik->i", x, covs["CR1"], x)), rtol=1e-6)


def test_absorbing_equals_dummies(staggered):
    cells = collapse(staggered, ["cluster", "year", "treat"], "y")
    years = range(1996, 2001)
    clusters = sorted(r[0] for r in cells.select("cluster").distinct().collect())
    a = rg.ols(cells, None, Design().main("treat").factor("year", years), cells=True, absorb="cluster",
               cluster="cluster", vcov="CR1")
    d = rg.ols(cells, None, Design().main("treat").factor("year", years).factor("cluster", clusters, ref=clusters[0]),
               cells=True, cluster="cluster", vcov="CR1")
    assert a.coef[0] == pytest.approx(d.coef[d.index("treat")], rel=1e-9)
    # same scores; the small-sample factor differs because absorbed nested effects are not counted
    ratio = (d.n - d.rank) / (a.n - a.rank)
    assert a.cov[0, 0] == pytest.approx(d.cov[d.index("treat"), d.index("treat")] * ratio, rel=1e-8)


def dense_hotelling(x, cl, contrasts):
    """Degrees of freedom from the full hat matrix: variances of all elements of the scaled covariance estimate."""
    n, q = len(x), len(contrasts)
    m = np.linalg.inv(x.T @ x)
    ih = np.eye(n) - x @ m @ x.T
    parts = []
    for g in np.unique(cl):
        i = np.flatnonzero(cl == g)
        w, v = np.linalg.eigh(ih[np.ix_(i, i)])
        root = (v * np.where(w > 1e-9, 1 / np.sqrt(np.where(w > 1e-9, w, 1)), 0)) @ v.T
        parts.append(ih[:, i] @ root @ x[i] @ m @ contrasts.T)
    value, vector = np.linalg.eigh(sum(p.T @ p for p in parts))
    parts = [p @ ((vector / np.sqrt(value)) @ vector.T) for p in parts]
    total = 0.0
    for a in parts:
        for b in parts:
            o = a.T @ b
            total += (o * o.T).sum() + np.outer(np.diag(o), np.diag(o)).sum()
    return q * (q + 1) / total


@pytest.fixture(scope="module")
def few_clusters(spark):
    rng = np.random.default_rng(12)
    cl = np.repeat(np.arange(9), [6, 11, 8, 14, 7, 9, 12, 5, 10])
    n = len(cl)
    t = np.concatenate([np.arange(c) % 4 for c in np.bincount(cl)])
    a, b = rng.normal(size=n) + 0.5 * cl, rng.normal(size=n) * (1 + cl % 3)
    c = (cl % 2) * rng.normal(size=n)
    y = 1 + a + cl + rng.normal(size=n) + 0.3 * t
    rows = [(int(g), int(k), float(p), float(q), float(r), float(z)) for g, k, p, q, r, z in zip(cl, t, a, b, c, y)]
    df = spark.createDataFrame(rows, "cl int, t int, a double, b double, c double, y double").repartition(4)
    return df, cl, t, np.column_stack([a, b, c]), y


def test_joint_test_under_bias_reduction(few_clusters):
    df, cl, _, z, y = few_clusters
    x = np.column_stack([np.ones(len(z)), z])
    b, covs, dof = dense(x, y, cl)
    fit = rg.ols(df, "y", ["a", "b", "c"], cluster="cl", vcov="CR2")
    for names in (["a", "b", "c"], ["b", "c"], ["a"]):
        idx = [1 + "abc".index(n) for n in names]
        eta = dense_hotelling(x, cl, np.eye(4)[idx])
        r = rg.wald(fit, names).first()
        q, stat = len(idx), b[idx] @ np.linalg.solve(covs["CR2"][np.ix_(idx, idx)], b[idx])
        assert r["chi2"] == pytest.approx(stat, rel=1e-7) and r["df2"] == pytest.approx(eta - q + 1, rel=1e-7)
        assert r["f"] == pytest.approx(stat * (eta - q + 1) / (eta * q), rel=1e-7) and r["p_chi2"] < r["p_f"] <= 1
    # one restriction: the square of the t test with its own degrees of freedom
    one = rg.wald(fit, ["a"]).first()
    assert one["df2"] == pytest.approx(dof(np.eye(4)[1]), rel=1e-7)
    assert one["p_f"] == pytest.approx(t_p(np.sqrt(one["f"]), one["df2"]), rel=1e-7)


@pytest.mark.parametrize("effect", ["cl", "half", "t"])
def test_bias_reduction_with_absorbed_effects(few_clusters, effect):
    """Absorbed effects give the numbers of the model with their dummies: nested in clusters, and crossing them."""
    df, cl, t, z, y = few_clusters
    df = df.withColumn("half", F.col("cl") * 2 + F.col("t") % 2)
    own = {"cl": cl, "half": 2 * cl + t % 2, "t": t}[effect]
    x = np.column_stack([(own == g).astype(float) for g in np.unique(own)] + [z])
    b, covs, dof = dense(x, y, cl)
    fit = rg.ols(df, "y", ["a", "b", "c"], absorb=effect, cluster="cl", vcov="CR2")
    at, d = [fit.index(c) for c in "abc"], x.shape[1] - 3
    np.testing.assert_allclose(fit.coef[at], b[d:], rtol=1e-8)
    np.testing.assert_allclose(fit.cov[np.ix_(at, at)], covs["CR2"][d:, d:], rtol=1e-8, atol=1e-12)
    np.testing.assert_allclose(fit.df[at], [dof(c) for c in np.eye(x.shape[1])[d:]], rtol=1e-7)
    r = rg.wald(fit, ["b", "c"]).first()
    eta = dense_hotelling(x, cl, np.eye(x.shape[1])[d + 1:])
    assert r["df2"] == pytest.approx(eta - 1, rel=1e-6)


def test_too_many_crossing_groups(few_clusters):
    with pytest.raises(ValueError, match="more than 3 groups"):
        rg.ols(few_clusters[0], "y", ["a"], absorb="t", cluster="cl", vcov="CR2", max_levels=3)
