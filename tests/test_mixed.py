"""Random-intercept models with and without known errors against dense likelihoods, and simultaneous bands."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelfx import PanelSpec
from panelfx.operators import bayes, imputation, mixed
from panelfx.operators import staggered as sg
from panelfx.operators.design import Design
from panelfx.plans import fixtures as fx

SP = fx.STAGGERED


def rows_with_errors(rng, clusters=14, per=9):
    """(cluster, x, v, y): cluster intercepts of deviation 0.8, residual deviation 0.6, known variances of their own."""
    out = []
    for c in range(clusters):
        u = rng.normal() * 0.8
        for j in range(per):
            x, v = float(j % 3), float([0.0, 0.3, 1.2][(c + j) % 3])
            out.append((c, x, v, 1.5 + 0.7 * x + u + rng.normal() * math.sqrt(0.36 + v)))
    return out


def dense_sums(nodes, cluster, x, v, y):
    """log|V|, X'V^-1X, X'V^-1y and y'V^-1y for every (sigma, tau), each cluster's covariance written out."""
    nodes = np.asarray(nodes, float)
    total = [0.0, 0.0, 0.0, 0.0]
    for c in np.unique(cluster):
        i = cluster == c
        cov = (nodes[:, 0, None] ** 2 + v[i])[:, :, None] * np.eye(i.sum()) + (nodes[:, 1] ** 2)[:, None, None]
        inv = np.linalg.inv(cov)
        parts = (np.linalg.slogdet(cov)[1], np.einsum("ri,nrs,sj->nij", x[i], inv, x[i]), np.einsum("ri,nrs,s->ni", x[i], inv, y[i]),
                 np.einsum("r,nrs,s->n", y[i], inv, y[i]))
        total = [t + q for t, q in zip(total, parts)]
    return total


def dense(rows, nodes, precision, known=True):
    """Log-likelihood with the coefficients integrated out, their means and covariances, from covariance matrices."""
    c, x, v, y = (np.array(col, float) for col in zip(*rows))
    logdet, a, b, yy = dense_sums(nodes, c, np.column_stack([np.ones(len(x)), x]), v if known else 0 * v, y)
    a = a + np.diag(precision)
    cov = np.linalg.inv(a)
    mean = np.einsum("nij,nj->ni", cov, b)
    return -0.5 * (logdet + np.linalg.slogdet(a)[1] + yy - np.einsum("ni,ni->n", b, mean)), mean, cov


@pytest.fixture(scope="module")
def measured(spark):
    rows = rows_with_errors(np.random.default_rng(2))
    df = spark.createDataFrame(rows, "cluster int, x double, v double, y double").repartition(4)
    cells = df.groupBy("cluster", "x", "v").agg(F.count("*").alias("n"), F.sum("y").alias("y_sum"), F.sum(F.col("y") * F.col("y")).alias("y_sumsq"))
    return rows, cells.cache()


NODES = [(0.3, 0.0), (0.6, 0.5), (0.6, 0.9), (1.4, 2.5), (0.05, 0.02)]


@pytest.mark.parametrize("known", [True, False])
@pytest.mark.parametrize("precision", [(0.0, 0.0), (0.01, 0.04)])
def test_likelihood_is_the_dense_one(measured, known, precision):
    rows, cells = measured
    r = mixed.reduce_rows(cells, "cluster", Design().main("x"), error="v" if known else None)
    got = mixed.conditional(r, NODES, np.array(precision))
    want = dense(rows, NODES, precision, known)
    assert r.names == ["(Intercept)", "x"] and r.n == len(rows)
    # both are known up to a constant, which is the same one
    assert np.allclose(got[0] - got[0][0], want[0] - want[0][0], atol=1e-7)
    assert np.allclose(got[1], want[1], atol=1e-9) and np.allclose(got[2], want[2], atol=1e-9)


def test_restricted_maximum(measured):
    rows, cells = measured
    r = mixed.reduce_rows(cells, "cluster", Design().main("x"), error="v")
    sigma, tau, mean, cov = mixed.fit_restricted(r)
    top = dense(rows, [(sigma, tau)], (0, 0))
    near = dense(rows, [(sigma * a, tau * b) for a in (0.999, 1, 1.001) for b in (0.999, 1, 1.001)], (0, 0))[0]
    assert top[0][0] >= near.max() - 1e-9
    assert np.allclose(mean, top[1][0]) and np.allclose(cov, top[2][0])
    grid = mixed.restricted_on_grid(r, [0.4, 0.6, 0.8], [0.0, 0.4, 0.8, 1.2])
    values = dense(rows, nodes := [(s, t) for s in (0.4, 0.6, 0.8) for t in (0.0, 0.4, 0.8, 1.2)], (0, 0))[0]
    assert grid[:2] == nodes[int(np.argmax(values))]


@pytest.mark.parametrize("known", [True, False])
def test_posterior_against_dense_quadrature(spark, measured, known):
    rows, cells = measured
    r = mixed.reduce_rows(cells, "cluster", Design().main("x"), error="v" if known else None)
    priors = mixed.Priors(sd=5.0, intercept_sd=10.0)
    got = {x["term"]: x for x in mixed.posterior(r, priors).table(spark).collect()}
    # a fixed fine grid over both deviations
    sigmas, taus = np.linspace(0.02, 2.6, 90), np.linspace(0.0, 3.5, 90)
    nodes = np.array([(s, t) for s in sigmas for t in taus])
    log, mean, cov = dense(rows, nodes, (0.01, 0.04), known)
    log = log + priors.log_density(nodes)
    mass = np.exp(log - log.max()) * np.where((nodes[:, 1] == 0), 0.5, 1.0)
    mass /= mass.sum()
    for i, name in enumerate(["(Intercept)", "x"]):
        m = mass @ mean[:, i]
        sd = math.sqrt(mass @ (cov[:, i, i] + mean[:, i] ** 2) - m * m)
        assert abs(got[name]["estimate"] - m) < 2e-3 * sd and abs(got[name]["std_error"] - sd) < 2e-3 * sd
        draws = np.random.default_rng(1)
        node = draws.choice(len(mass), 200_000, p=mass)
        x = mean[node, i] + draws.normal(size=len(node)) * np.sqrt(cov[node, i, i])
        for q, c in ((0.025, "q_low"), (0.5, "median"), (0.975, "q_high")):
            assert abs(got[name][c] - np.quantile(x, q)) < 0.03 * sd
    for name, x in (("sigma", nodes[:, 0]), ("sd_cluster", nodes[:, 1])):
        m = mass @ x
        sd = math.sqrt(mass @ x ** 2 - m * m)
        assert abs(got[name]["estimate"] - m) < 5e-3 * sd and abs(got[name]["std_error"] - sd) < 1e-2 * sd
        order = np.argsort(x)
        for q, c in ((0.025, "q_low"), (0.5, "median"), (0.975, "q_high")):
            assert abs(got[name][c] - x[order][np.searchsorted(np.cumsum(mass[order]), q)]) < 0.06 * sd + 0.04


def test_prior_pulls_the_cluster_deviation(spark, measured):
    rows, cells = measured
    r = mixed.reduce_rows(cells, "cluster", Design().main("x"), error="v")
    at = [{x["term"]: x["estimate"] for x in mixed.posterior(r, mixed.Priors(tau_rate=rate)).table(spark).collect()}["sd_cluster"] for rate in (0.1, 1.0, 40.0)]
    assert at[0] > at[1] > 2 * at[2]


def test_rows_left_out_and_null_cluster(spark, measured):
    rows, cells = measured
    extra = spark.createDataFrame([(3, None, 0.3, 2, 1.0, 1.0), (4, 1.0, None, 2, 1.0, 1.0), (5, 1.0, 0.3, 0, None, None), (6, 1.0, -0.1, 1, 1.0, 1.0)],
                                  "cluster int, x double, v double, n long, y_sum double, y_sumsq double")
    a = mixed.reduce_rows(cells.unionByName(extra), "cluster", Design().main("x"), error="v")
    b = mixed.reduce_rows(cells, "cluster", Design().main("x"), error="v")
    assert a.n == b.n and all(np.allclose(x, y) for x, y in zip(a.at(NODES), b.at(NODES)))
    null = cells.withColumn("cluster", F.when(F.col("cluster") != 0, F.col("cluster")))
    assert np.allclose(mixed.reduce_rows(null, "cluster", Design().main("x"), error="v").at(NODES)[0], b.at(NODES)[0])


def test_measured_error_second_stage(spark, staggered):
    """The second stage on cells equals the dense one on rows, and known errors widen the interval."""
    imputed = imputation.impute_y0(staggered, SP)
    r = imputation.measured_error(imputed, SP, by_cohort=True)
    rows = imputed.where("pred IS NOT NULL").select("cluster", "treat", "cohort", "pred_var", "y_it").collect()
    cells = imputation.impute_cells(sg.panel_cells(staggered, SP), SP)
    assert r.names == ["treat:cohort::1997", "treat:cohort::1999"] and r.n == len(rows)
    again = imputation.measured_error(cells, SP, by_cohort=True)
    assert np.allclose(r.at(NODES)[0], again.at(NODES)[0]) and np.allclose(r.at(NODES)[1], again.at(NODES)[1])
    x = np.array([[t["treat"] * (t["cohort"] == g) for g in SP.cohorts] for t in rows], float)
    y, v, c = (np.array([t[k] for t in rows], float) for k in ("y_it", "pred_var", "cluster"))
    _, a, b, _ = dense_sums([(1.7, 0.4)], c, x, v, y)
    _, mean, cov = mixed.conditional(r, [(1.7, 0.4)], np.zeros(2))
    assert np.allclose(mean[0], np.linalg.solve(a[0], b[0])) and np.allclose(cov[0], np.linalg.inv(a[0]))


def test_random_intercept_posterior_spreads_more(spark, staggered):
    """Carrying the deviations' uncertainty widens the coefficients' law against the plug-in one, and hardly moves it."""
    cells = sg.panel_cells(staggered, SP)
    design = Design().factor("year", SP.times, ref=SP.times[0]).main("treat")
    full = {r["term"]: r for r in bayes.random_intercept_posterior(cells, "cluster", design).collect()}
    plug = {r["term"]: r for r in bayes.random_intercept(cells, "cluster", design, 5.0, 10.0).collect()}
    assert set(full) == set(plug)
    assert abs(full["treat"]["estimate"] - plug["treat"]["estimate"]) < 0.2 * plug["treat"]["std_error"]
    assert full["(Intercept)"]["std_error"] > 0.95 * plug["(Intercept)"]["std_error"]
    assert full["sd_cluster"]["q_low"] < full["sd_cluster"]["median"] < full["sd_cluster"]["q_high"]


# --------------------------------------------------------------------------- simultaneous bands


def order_statistic(x, p):
    x = sorted(x)
    return x[max(0, math.ceil(p * len(x) - 1e-9) - 1)]


def test_simultaneous_by_hand(spark):
    rng = np.random.default_rng(7)
    terms = {"a": 1.0, "b": 0.2, "c": 5.0, "overall": 2.0, "flat": 0.0}
    draws = {t: rng.normal(size=300) * s for t, s in terms.items()}
    rows = [(rep, t, float(d)) for t, ds in draws.items() for rep, d in enumerate(ds)]
    df = spark.createDataFrame(rows, "rep int, term string, dev double").repartition(5)
    got = {r["term"]: r for r in sg.simultaneous(df, 0.9, F.col("term") == "overall").collect()}
    se = {t: (order_statistic(d, 0.75) - order_statistic(d, 0.25)) / 1.3489795003921634 for t, d in draws.items()}
    family = order_statistic([max(abs(draws[t][i] / se[t]) for t in "abc") for i in range(300)], 0.9)
    alone = order_statistic([abs(d / se["overall"]) for d in draws["overall"]], 0.9)
    for t in "abc":
        assert math.isclose(got[t]["se_boot"], se[t]) and math.isclose(got[t]["crit"], family)
    assert math.isclose(got["overall"]["crit"], alone) and alone < family
    assert got["flat"]["se_boot"] is None


@pytest.mark.parametrize("cluster", [None, "unit"])
def test_bands_use_the_draws(staggered, cluster):
    r = sg.att_replicates(staggered, SP, "dynamic", cluster=cluster, boot=99, seed=4)
    names = [e["label"] for e in r.wanted]
    dev = np.full((99, len(names)), np.nan)
    for x in r.draws().collect():
        dev[x["rep"] - 1, x["i"]] = x["dev"]
    assert np.isfinite(dev).all()
    bands = {x["term"]: x for x in sg.att_bands(staggered, SP, "dynamic", cluster=cluster, boot=99, seed=4).collect()}
    pointwise = {x["term"]: x for x in sg.att_inference(staggered, SP, "dynamic", cluster=cluster, boot=99, seed=4).collect()}
    assert set(bands) == set(names)
    se = {t: (order_statistic(dev[:, i], 0.75) - order_statistic(dev[:, i], 0.25)) / 1.3489795003921634 for i, t in enumerate(names)}
    family = [t for t in names if t != "overall"]
    crit = order_statistic([max(abs(dev[b, names.index(t)] / se[t]) for t in family) for b in range(99)], 0.95)
    for t in family:
        assert math.isclose(bands[t]["crit"], crit, rel_tol=1e-9) and math.isclose(bands[t]["se_boot"], se[t], rel_tol=1e-9)
        assert math.isclose(bands[t]["estimate"], pointwise[t]["estimate"])
        assert math.isclose(bands[t]["conf_high"] - bands[t]["estimate"], crit * se[t], rel_tol=1e-9)
    assert bands["overall"]["crit"] < crit
    # about the errors of the influence function
    assert all(0.5 < bands[t]["se_boot"] / pointwise[t]["se"] < 2.0 for t in family)


def test_bands_need_no_common_spec_names(spark):
    """Other column names, a cohort without pre-period and no never treated."""
    rng = np.random.default_rng(3)
    sp = PanelSpec(unit="id", time="wave", y="out", cluster="region", cohort="start", treat="on", times=(1, 2, 3, 4), cohorts=(3, 4))
    rows = [(i, w, i % 8, 3 + i % 2, float(rng.normal() + (w >= 3 + i % 2))) for i in range(80) for w in (1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "id int, wave int, region int, start int, out double")
    got = sg.att_bands(df, sp, "gt", boot=64, seed=1).collect()
    assert {r["term"] for r in got} == {"ATT(3,2)", "ATT(3,3)", "ATT(4,2)"} and len({r["crit"] for r in got}) == 1
