"""Identities between estimators, known effects, invariances and edge cases."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelfx import PanelSpec
from panelfx.operators import absorb as ab
from panelfx.operators import bayes, dose, imputation as im, its, regress as rg, resample, staggered as sg
from panelfx.operators.describe import collapse
from panelfx.operators.panel import inject_effect
from panelfx.plans import fixtures as fx

SP = fx.STAGGERED


@pytest.fixture(scope="module")
def cells(staggered):
    return sg.panel_cells(staggered, SP)


def att(df, sp=SP, **kw):
    return {(r.g, r.t): r.att for r in sg.att_gt(df, sp, **kw).collect()}


def test_att_gt_brute_force(staggered):
    p = staggered.toPandas()
    w = p.pivot(index="unit", columns="year", values="y")
    g = p.groupby("unit").cohort.first()
    got = att(staggered)
    assert len(got) == 12
    for (c, t), value in got.items():
        b = c - 1 if t >= c else t - 1
        d = w[t] - w[b]
        ctl = g.isna() | ((g > max(t, b)) & (g != c))
        assert value == pytest.approx(d[g == c].mean() - d[ctl].mean(), rel=1e-9)


def test_known_effect_moves_att_by_exactly_that(staggered):
    y, y0 = att(staggered), att(staggered.withColumn("y", F.col("y0")))
    for (g, t), v in y.items():
        want = 0.0 if t < g else fx.STAGGERED_MU[g] * (t - g + 1)
        assert v - y0[g, t] == pytest.approx(want, abs=1e-9)


def test_saturated_and_imputation_estimates_agree(staggered, cells):
    a = sg.etwfe(cells, SP, "cluster")
    b = sg.etwfe(cells, SP, "cohort")
    imputed = {fe: im.impute_y0(staggered, SP, fe) for fe in ("cluster", "cohort", "unit")}
    means = {fe: {(r.cohort, r.year): r.m for r in d.filter("treat = 1").groupBy("cohort", "year")
                  .agg(F.avg("y_it").alias("m")).collect()} for fe, d in imputed.items()}
    for g, t in [(1997, 1997), (1997, 2000), (1999, 1999), (1999, 2000)]:
        name = f"treat:cohort::{g}:year::{t}"
        want = a.coef[a.index(name)]
        assert b.coef[b.index(name)] == pytest.approx(want, rel=1e-9)
        for fe in means:
            assert means[fe][g, t] == pytest.approx(want, rel=1e-9), fe


def test_imputation_on_cells_equals_rows(staggered, cells):
    rows, sums = im.impute_y0(staggered, SP), im.impute_cells(cells, SP)
    for by in (None, "cohort", "event"):
        for weight in (None, F.lit(1.0) / F.col("pred_var")):
            a = im.imputation_att(rows, by, weight).orderBy("key").toPandas()
            b = im.imputation_att(sums, by, weight).orderBy("key").toPandas()
            np.testing.assert_allclose(a.drop(columns="key").astype(float), b.drop(columns="key").astype(float), rtol=1e-8)


def test_untreated_imputation_residuals_average_to_zero(staggered):
    d = im.impute_y0(staggered, SP).filter("treat = 0")
    for key in ("year", "cluster", "cohort"):
        assert max(abs(r.m) for r in d.groupBy(key).agg(F.avg("y_it").alias("m")).collect()) < 1e-9


def test_imputation_without_untreated_rows_is_null_not_wrong(spark):
    rows = [(u, t, u % 3, 0 if u % 3 == 0 else 2, float(u + t)) for u in range(9) for t in range(4)]
    df = spark.createDataFrame(rows, "unit int, year int, cluster int, cohort int, y double")
    sp = replace(SP, times=(0, 1, 2, 3), cohorts=(0, 2))
    got = im.impute_y0(df, sp).toPandas()
    assert got[got.cluster == 0].pred.isna().all()       # cluster treated from the start
    assert got[got.year >= 2].pred.isna().all()          # periods in which all are treated
    assert got[(got.cluster == 1) & (got.year < 2)].pred.notna().all()


def test_prediction_variance_brute_force(staggered):
    fs = im.first_stage(staggered, SP)
    got = im.add_predictions(staggered, fs).select("cluster", "year", "pred", "pred_var").distinct().toPandas()
    p = staggered.filter("treat = 0").toPandas()
    cl, ys = sorted(p.cluster.unique()), list(SP.times)
    def row(c, t):
        return np.array([float(c == k) for k in cl] + [float(t == k) for k in ys[1:]])
    x = np.array([row(c, t) for c, t in zip(p.cluster, p.year)])
    m = np.linalg.inv(x.T @ x)
    b = m @ x.T @ p.y
    s2 = ((p.y - x @ b) ** 2).sum() / (len(p) - x.shape[1])
    for _, r in got.sample(40, random_state=1).iterrows():
        v = row(r.cluster, r.year)
        assert r.pred == pytest.approx(v @ b, rel=1e-8)
        assert r.pred_var == pytest.approx(s2 * v @ m @ v, rel=1e-7)


def test_static_slope_and_regression_agree(cells):
    one = sg.twfe_slope(cells, "treat", "cluster", "year").first().estimate
    fit = sg.twfe(cells, SP)
    assert fit.coef[fit.index("treat")] == pytest.approx(one, rel=1e-9)


def test_results_do_not_depend_on_partitioning(spark, staggered):
    a, b = att(staggered.repartition(1)), att(staggered.repartition(23))
    assert all(a[k] == pytest.approx(b[k], rel=1e-12) for k in a)


def test_aggregations_brute_force(staggered):
    rows = [r.asDict() for r in sg.att_gt(staggered, SP).collect()]
    post = [r for r in rows if r["post"]]
    dyn = {r.key: r.att for r in sg.agg_att(sg.att_gt(staggered, SP), "dynamic").collect()}
    for e in {r["event"] for r in rows}:
        m = [r for r in rows if r["event"] == e]
        assert dyn[e] == pytest.approx(np.average([r["att"] for r in m], weights=[r["n_treated"] for r in m]))
    assert dyn[None] == pytest.approx(np.mean([v for k, v in dyn.items() if k is not None and k >= 0]))
    grp = {r.key: r.att for r in sg.agg_att(sg.att_gt(staggered, SP), "group").collect()}
    assert grp[1997] == pytest.approx(np.mean([r["att"] for r in post if r["g"] == 1997]))
    for kind in ("simple", "dynamic", "group", "calendar"):
        plain = sorted(r.att for r in sg.agg_att(sg.att_gt(staggered, SP), kind).collect())
        with_se = sorted(r.estimate for r in sg.att_inference(staggered, SP, kind).collect())
        np.testing.assert_allclose(plain, with_se, rtol=1e-9)


def test_group_overall_error_by_numerical_derivative(staggered):
    """Influence of the estimated shares, checked by perturbing unit weights."""
    got = {r.term: r.se for r in sg.att_inference(staggered, SP, "group", cluster="unit").collect()}
    p = staggered.toPandas()
    w = p.pivot(index="unit", columns="year", values="y").to_numpy()
    g = p.groupby("unit").cohort.first().to_numpy()
    n = len(g)
    ys = list(SP.times)

    def overall(wt):
        total, size = 0.0, 0.0
        for c in (1997, 1999):
            atts = []
            for t in [y for y in ys if y >= c]:
                d = w[:, ys.index(t)] - w[:, ys.index(c - 1)]
                ctl = np.isnan(g) | (g > t)
                atts.append(np.average(d[g == c], weights=wt[g == c]) - np.average(d[ctl], weights=wt[ctl]))
            total += np.mean(atts) * wt[g == c].sum()
            size += wt[g == c].sum()
        return total / size

    base, h = overall(np.ones(n)), 1e-5
    infl = []
    for i in range(n):
        wt = np.ones(n)
        wt[i] += h
        infl.append((overall(wt) - base) / h)
    assert got["overall"] == pytest.approx(np.sqrt(np.sum(np.square(infl))), rel=1e-3)


def test_cohort_treated_from_the_first_period_is_left_out(spark):
    rows = [(u, t, u % 4, {0: 0, 1: 2, 2: None, 3: None}[u % 4], float(u * t % 5)) for u in range(20) for t in range(4)]
    df = spark.createDataFrame(rows, "unit int, year int, cluster int, cohort int, y double")
    sp = PanelSpec("unit", "year", "y", cluster="cluster", cohort="cohort").with_levels(df)
    assert sp.cohorts == (0, 2)
    assert {g for g, _ in att(df, sp)} == {2}


def test_no_never_treated_cohort(staggered):
    df = staggered.filter("cohort IS NOT NULL")
    got = att(df)
    # the last cohort has no controls from its start on; the first has none once both are treated
    assert set(got) == {(1997, 1996), (1997, 1997), (1997, 1998), (1999, 1996)}


def test_hot_cluster_gives_the_same_answer(staggered):
    """A third of all rows in one cluster: results follow from the sums alone."""
    df = staggered.withColumn("cluster", F.when(F.col("unit") % 3 == 0, F.lit(2)).otherwise(F.col("cluster"))).withColumn(
        "cohort", F.when(F.col("cluster") % 3 == 0, F.lit(1997)).when(F.col("cluster") % 3 == 1, F.lit(1999)))
    df = inject_effect(df.drop("treat", "tau", "tau_cum", "y"), SP, fx.STAGGERED_MU, "y0")
    cells = sg.panel_cells(df, SP)
    fit = sg.etwfe(cells, SP, "cohort")
    raw = rg.ols(sg_treat(df), "y", sg.etwfe_design(SP, "cohort"), cluster="cluster", vcov="CR1")
    np.testing.assert_allclose(fit.coef, raw.coef, rtol=1e-8, atol=1e-9)
    np.testing.assert_allclose(fit.cov, raw.cov, rtol=1e-6, atol=1e-10)


def sg_treat(df):
    return df.withColumn("treat", F.coalesce((F.col("year") >= F.col("cohort")).cast("int"), F.lit(0)))


def test_its_full_model_equals_separate_models(its_df):
    cells = its.its_cells(its_df, fx.ITS)
    full = {r.term: r for r in its.its_effect(its.its_fit(cells, fx.ITS, cohort="full"), fx.ITS, 23).collect()}
    lines = {r.cohort: r for r in its.its_line_effects(its_df, fx.ITS, 23).collect()}
    jumps = {r.cohort: r["treat"] for r in its.its_lines(its_df, fx.ITS).collect()}
    for g in fx.ITS.cohorts:
        assert full[f"effect {g}"].estimate == pytest.approx(lines[g].effect, rel=1e-8)
        assert full[f"untreated {g}"].estimate == pytest.approx(lines[g].untreated, rel=1e-8)
        one = its.its_fit_one(cells, fx.ITS, g)
        assert one.coef[one.index("treat")] == pytest.approx(jumps[g], rel=1e-7)


def test_its_shares_and_weights(its_df):
    shares = its.cohort_shares(its_df, fx.ITS, "unit")
    assert sum(shares.values()) == pytest.approx(1.0)
    fit = its.its_fit(its.its_cells(its_df, fx.ITS), fx.ITS, cohort="full", vcov="CR1")
    got = {r.term: r.estimate for r in its.its_effect(fit, fx.ITS, 23, shares).collect()}
    assert got["effect all"] == pytest.approx(sum(shares[g] * got[f"effect {g}"] for g in shares), rel=1e-9)


def test_unbalanced_absorption(spark, sf_dir):
    df = fx.daily_users(spark, sf_dir).select("unit", "t", "y")
    exact = ab.absorb(df, ["y"], "unit", "t", range(1, 31), "unbalanced").orderBy("unit", "t").toPandas()
    steps = ab.absorb(df, ["y"], "unit", "t", method="iterative").orderBy("unit", "t").toPandas()
    p = df.orderBy("unit", "t").toPandas()
    x = np.column_stack([(p.unit.to_numpy()[:, None] == p.unit.unique()), (p.t.to_numpy()[:, None] == p.t.unique())]).astype(float)
    want = p.y - x @ np.linalg.lstsq(x, p.y, rcond=None)[0]
    np.testing.assert_allclose(exact.y, want, atol=1e-7)
    np.testing.assert_allclose(steps.y, want, atol=1e-6)


def test_two_period_slope_equals_two_way_fixed_effects(spark, sf_dir):
    df = fx.two_period(spark, sf_dir)
    both = df.groupBy("unit").count().filter("count = 2").select("unit")
    df = df.join(both, "unit").withColumn("dp", F.col("dose") * F.col("period"))
    r = ab.absorb_balanced(df.select("unit", "period", "y", "dp"), ["y", "dp"], "unit", "period")
    b = r.agg((F.sum(F.col("y") * F.col("dp")) / F.sum(F.col("dp") * F.col("dp"))).alias("b")).first().b
    assert dose.dose_twfe(df, fx.TWO_PERIOD).first().estimate == pytest.approx(b, rel=1e-9)


def test_zero_variance_dose_gives_null(spark):
    df = spark.createDataFrame([(u, p, 2.0, float(u * p)) for u in range(5) for p in (0, 1)],
                               "unit int, period int, dose double, y double")
    assert dose.dose_twfe(df, fx.TWO_PERIOD).first().estimate is None


def test_too_few_stayers_give_null(spark, sf_dir):
    d = dose.differences(fx.always_on(spark, sf_dir), fx.ALWAYS_ON)  # ten suppliers only
    row = dose.aoss(d, "t", [0.2]).first()
    assert row.estimate is None and row.n_periods == 0


def test_stayer_slope_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(u, t, float(rng.normal(10, 2)), float(rng.normal())) for u in range(80) for t in range(4)]
    df = spark.createDataFrame(rows, "unit int, t int, dose double, y double")
    d = dose.differences(df, fx.ALWAYS_ON)
    p = d.toPandas()
    for q in (0.2, 0.35):
        ests, num, den = [], 0.0, 0.0
        for _, g in p.groupby("t"):
            s = g.d_dose.abs() <= np.quantile(g.d_dose.abs(), q)
            b, a = np.polyfit(g[s].dose_lag, g[s].d_y, 1)
            w = g[~s]
            ce = w.d_y - a - b * w.dose_lag
            ests.append((ce * w.d_dose).sum() / (w.d_dose ** 2).sum())
            num, den = num + (ce * w.d_dose).sum(), den + (w.d_dose ** 2).sum()
        assert dose.aoss(d, "t", [q]).first().estimate == pytest.approx(np.mean(ests), rel=1e-8)
        assert dose.aoss(d, "t", [q], pool="pooled").first().estimate == pytest.approx(num / den, rel=1e-8)


def test_permutation_draw_equals_direct_fit(staggered):
    """One draw, re-estimated the long way on rows with the drawn cohorts."""
    draws = resample.permutation_draws(sg.panel_cells(staggered, SP), SP, 3, 8)
    row = draws.filter("rep = 2").first()
    from panelfx.operators.panel import permute_cohorts
    ids = staggered.select("cluster").distinct().withColumn("rep", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    sizes = resample.cohort_sizes(collapse(staggered, ["cluster", "cohort"], "y"), SP)
    drawn = permute_cohorts(ids, "cluster", sizes, 8, rep="rep").filter("rep = 2").select("cluster", "cohort")
    fit = sg.twfe(sg.panel_cells(staggered.drop("cohort", "treat").join(drawn, "cluster"), SP), SP)
    assert row.estimate == pytest.approx(fit.coef[fit.index("treat")], rel=1e-8)
    assert row.se == pytest.approx(fit.se[fit.index("treat")], rel=1e-7)


def test_random_intercept_against_dense_likelihood(spark):
    rng = np.random.default_rng(4)
    cl = np.repeat(np.arange(12), rng.integers(5, 15, 12))
    x = rng.normal(size=len(cl))
    y = 1.0 + 0.5 * x + rng.normal(0, 1.5, 12)[cl] + rng.normal(size=len(cl))
    df = spark.createDataFrame([(int(c), float(a), float(b)) for c, a, b in zip(cl, x, y)], "c int, x double, y double")
    cells = collapse(df, ["c", "x"], "y")
    from panelfx.operators.design import Design
    got = {r.term: r.estimate for r in bayes.random_intercept(cells, "c", Design().main("x"), 1e6).collect()}
    xx = np.column_stack([np.ones(len(cl)), x])
    z = (cl[:, None] == np.arange(12)).astype(float)

    def crit(ratio):
        v = np.eye(len(cl)) + ratio * z @ z.T
        vi = np.linalg.inv(v)
        b = np.linalg.solve(xx.T @ vi @ xx, xx.T @ vi @ y)
        e = y - xx @ b
        s2 = e @ vi @ e / (len(y) - 2)
        return ((len(y) - 2) * np.log(s2) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(xx.T @ vi @ xx)[1], s2, b)

    ratio = (got["sd_cluster"] / got["sigma"]) ** 2
    best = crit(ratio)
    assert best[0] <= min(crit(ratio * f)[0] for f in (0.98, 1.02)) + 1e-9
    assert got["sigma"] == pytest.approx(np.sqrt(best[1]), rel=1e-6)
    assert got["x"] == pytest.approx(best[2][1], rel=1e-6)


def test_flat_prior_gives_least_squares(cells):
    d = sg.etwfe_design(SP, "cohort")
    flat = {r.term: r.estimate for r in bayes.ridge_posterior(cells, d, 1e6).collect()}
    fit = sg.etwfe(cells, SP, "cohort")
    assert all(flat[t] == pytest.approx(b, rel=1e-5, abs=1e-6) for t, b in zip(fit.terms, fit.coef))


def test_pretrend_of_a_parallel_panel_is_not_rejected(spark):
    rng = np.random.default_rng(9)
    rows = []
    for u in range(400):
        c = u % 20
        g = {0: 3, 1: 5}.get(c % 3)
        for t in range(7):
            rows.append((u, t, c, g, float(c / 10 + 0.3 * t + rng.normal() + (2 if g is not None and t >= g else 0))))
    df = spark.createDataFrame(rows, "unit int, year int, cluster int, cohort int, y double")
    sp = replace(SP, times=tuple(range(7)), cohorts=(3, 5))
    cells = sg.panel_cells(df, sp)
    fit = sg.pretrend_cells(cells, sp)
    assert rg.wald(fit, [t for t in fit.terms if t.startswith("evtreat")]).first().p_f > 0.01
    eff = {r.term: r.estimate for r in sg.att_inference(df, sp, "simple").collect()}
    assert eff["simple"] == pytest.approx(2.0, abs=0.3)


def test_average_predictions_and_slopes_brute_force(staggered, cells):
    from panelfx.operators import post
    fit = sg.etwfe(cells, SP, "cohort")
    treated = cells.filter("treat = 1")
    pred = {r.term: r for r in post.avg_predictions(fit, treated, "treat", weight="n").collect()}
    slope = post.slopes(fit, treated, "treat", weight="n").first()
    assert slope.estimate == pytest.approx(pred["treat=1"].estimate - pred["treat=0"].estimate, rel=1e-9)
    rows = rg.predict(fit, staggered.filter("treat = 1")).agg(F.avg("pred").alias("m")).first().m
    assert pred["treat=1"].estimate == pytest.approx(rows, rel=1e-9)
    # the saturated model reproduces the treated mean
    assert rows == pytest.approx(staggered.filter("treat = 1").agg(F.avg("y")).first()[0], rel=1e-9)


def test_grids(spark):
    from panelfx.operators.describe import dose_grid
    from panelfx.operators.post import value_grid
    g = value_grid(spark, year0=[19], treat=[0, 1], since=[0, 10])
    assert sorted(tuple(r) for r in g.collect()) == [(19, 0, 0), (19, 0, 10), (19, 1, 0), (19, 1, 10)]
    c = dose_grid(spark, 1.0, 25.0, 200, {"half": lambda d: d / 2}).orderBy("d").toPandas()
    assert len(c) == 200 and c.d.iloc[0] == 1.0 and c.d.iloc[-1] == pytest.approx(25.0)
    np.testing.assert_allclose(c.tau, c.d / 2)


def test_bootstrap_spread_approaches_the_analytic_error(staggered):
    rows = sg.att_inference(staggered, SP, "simple", cluster="unit", boot=1000).collect()
    assert rows[0].se_boot == pytest.approx(rows[0].se, rel=0.12)


def test_missing_outcomes_stop_or_drop_units(staggered):
    holes = staggered.withColumn("y", F.when((F.col("unit") % 10 != 3) | (F.col("year") != 1998), F.col("y")))
    with pytest.raises(Exception, match="complete_units"):
        att(holes)
    whole = att(staggered.filter("unit % 10 <> 3"))
    got = att(sg.complete_units(holes, SP))
    assert all(got[k] == pytest.approx(whole[k], rel=1e-12) for k in whole)


def test_clusters_with_several_cohorts(spark, staggered):
    """Influence sums by cluster when cohorts are mixed inside clusters."""
    df = staggered.withColumn("cluster", (F.col("unit") % 7).cast("int"))
    got = {r.term: r.se for r in sg.att_inference(df, SP, "gt").collect()}
    p = df.toPandas()
    w = p.pivot(index="unit", columns="year", values="y")
    g, cl, n = p.groupby("unit").cohort.first(), p.groupby("unit").cluster.first(), w.shape[0]
    for c, t in [(1997, 1998), (1999, 1997)]:
        b = c - 1 if t >= c else t - 1
        d = w[t] - w[b]
        own, ctl = g == c, g.isna() | ((g > max(t, b)) & (g != c))
        psi = own * n / own.sum() * (d - d[own].mean()) - ctl * n / ctl.sum() * (d - d[ctl].mean())
        assert got[f"ATT({c},{t})"] == pytest.approx(np.sqrt((psi.groupby(cl).sum() ** 2).sum()) / n, rel=1e-9)


def test_entry_runs(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.columns == ["kind", "key", "att"] and df.count() == 9
