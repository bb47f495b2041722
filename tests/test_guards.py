"""Inputs that leave the tidy shape: missing weights and cells, NULL groups, unlisted periods, large variance ratios."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelfx import PanelSpec
from panelfx.functions.columns import hash_rank
from panelfx.operators import absorb as ab
from panelfx.operators import bayes, describe, dose, imputation, panel, regress
from panelfx.operators import staggered as sg
from panelfx.operators.design import Design


@pytest.mark.parametrize("k", [2, 10])
def test_null_weight_and_outcome_leave_the_row_out(spark, k):
    rng = np.random.default_rng(k)
    rows = [tuple([float(rng.normal()) for _ in range(k)] + [float(rng.normal()), float(rng.uniform(1, 2))]) for _ in range(200)]
    rows = [r[:-1] + ((None,) if i % 10 == 0 else r[-1:]) for i, r in enumerate(rows)]
    rows = [(*r[:-2], None if i % 17 == 3 else r[-2], r[-1]) for i, r in enumerate(rows)]
    xs = [f"x{i}" for i in range(k)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*xs, "y", "w"]))
    fit = regress.ols(df, "y", xs, weight="w")
    ok = [r for r in rows if r[-1] is not None and r[-2] is not None]
    x = np.column_stack([np.ones(len(ok)), np.array([r[:k] for r in ok])])
    w, y = np.array([r[-1] for r in ok]), np.array([r[-2] for r in ok])
    b = np.linalg.solve(x.T @ (x * w[:, None]), x.T @ (w * y))
    assert fit.n == len(ok) and np.allclose(fit.coef, b, atol=1e-9)


@pytest.mark.parametrize("periods", [3, 16, 17, 40])
def test_panel_cells_do_not_depend_on_the_number_of_periods(spark, periods):
    units = spark.createDataFrame([(1,), (2,)], "u int")
    facts = spark.createDataFrame([(1, 0, 5.0), (1, 1, 6.0), (1, 1, 7.0)], "u int, t int, v double")
    out = panel.balanced_panel(units, facts, "u", "t", range(periods), {"n": F.count, "s": F.sum}, {"n": F.col("v"), "s": F.col("v")}, fill=None)
    got = {(r["u"], r["t"]): (r["n"], r["s"]) for r in out.collect()}
    assert len(got) == 2 * periods and got[1, 0] == (1, 5.0) and got[1, 1] == (2, 13.0)
    assert all(v == (None, None) for k, v in got.items() if k not in {(1, 0), (1, 1)})


@pytest.mark.parametrize("sd", [0.0, 1.0, 50.0])
def test_random_intercept_finds_any_ratio(spark, sd):
    rng = np.random.default_rng(3)
    rows = [(c, float(a + x + e), float(x)) for c in range(60) for a in [rng.normal(0, sd) if sd else 0.0]
            for x, e in zip(rng.normal(size=12), rng.normal(size=12))]
    df = spark.createDataFrame(rows, "cl int, y double, x double")
    cells = df.groupBy("cl", "x").agg(F.count("*").alias("n"), F.sum("y").alias("y_sum"), F.sum(F.col("y") * F.col("y")).alias("y_sumsq"))
    got = {r["term"]: r for r in bayes.random_intercept(cells, "cl", Design().main("x"), 1e4).collect()}
    assert got["sigma"]["estimate"] == pytest.approx(1, abs=.1) and got["sd_cluster"]["estimate"] == pytest.approx(sd, rel=.3, abs=.2)
    assert got["sigma"]["std_error"] is None and got["x"]["estimate"] == pytest.approx(1, abs=.15)


def test_quantiles_keep_the_null_group(spark):
    df = spark.createDataFrame([(g, float(v)) for g in (None, 1) for v in range(11)], "g int, v double")
    got = {r["g"]: r["value"] for r in describe.group_quantile(df, ["g"], "v", 0.5).collect()}
    assert got == {None: 5.0, 1: 5.0}


def test_unbalanced_panels_stop_the_closed_form_and_take_the_exact_path(spark):
    rng = np.random.default_rng(8)
    rows = [(u, t, float(rng.normal() + u), float(rng.normal() + .1 * t)) for u in range(20) for t in range(6) if (u + 2 * t) % 9]
    df = spark.createDataFrame(rows, "u int, t int, y double, d double")
    with pytest.raises(Exception, match="not balanced"):
        ab.absorb_balanced(df, ["y", "d"], "u", "t").collect()
    x = np.array([[float(r[3])] + [float(r[0] == u) for u in range(20)] + [float(r[1] == t) for t in range(1, 6)] for r in rows])
    want = np.linalg.lstsq(x, np.array([r[2] for r in rows]), rcond=None)[0][0]
    sp = PanelSpec(unit="u", time="t", y="y", dose="d")
    holes = df.unionByName(spark.createDataFrame([(0, 0, None, 1.0), (1, 4, 2.0, None)], df.schema))
    for frame in (df, holes):
        assert dose.always_on_twfe(frame, sp).first()["estimate"] == pytest.approx(want, abs=1e-9)


def test_unequal_weights_stop_the_closed_form(spark):
    df = spark.createDataFrame([(u, t, float(u * t), 1.0 + (u == 1 and t == 1)) for u in range(3) for t in range(3)], "u int, t int, y double, w double")
    with pytest.raises(Exception, match="not balanced"):
        ab.absorb_balanced(df, ["y"], "u", "t", "w").collect()


def test_unlisted_periods_are_left_out(spark, staggered):
    from panelfx.plans.fixtures import STAGGERED as sp
    from dataclasses import replace
    short = replace(sp, times=sp.times[:-1])
    a = sg.twfe(sg.panel_cells(staggered, short), short)
    b = sg.twfe(sg.panel_cells(staggered.filter(F.col("year") < sp.times[-1]), short), short)
    assert a.n == b.n and np.allclose(a.coef, b.coef)


def test_one_untreated_period(spark):
    sp = PanelSpec(unit="u", time="t", y="y", cluster="c", cohort="g", times=(1, 2), cohorts=(2,))
    df = spark.createDataFrame([(u, t, float(10 * u + t), u % 3, 2) for u in range(12) for t in (1, 2)], "u int, t int, y double, c int, g int")
    got = imputation.impute_y0(df, sp).filter("t = 1").select("y_it", "pred_var").collect()
    assert len(got) == 12 and abs(sum(r["y_it"] for r in got)) < 1e-9 and all(r["pred_var"] > 0 for r in got)


def test_joint_test_without_a_law(spark):
    """Three clusters leave too few degrees of freedom for a joint test of three coefficients."""
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(c, *map(float, rng.normal(size=4))) for c in range(3) for _ in range(9)], "cl int, a double, b double, c double, y double")
    r = regress.wald(regress.ols(df, "y", ["a", "b", "c"], cluster="cl", vcov="CR2"), ["a", "b", "c"]).first()
    assert r["p_f"] is None and r["df2"] is None and 0 <= r["p_chi2"] <= 1


def test_hash_rank_chooses_ranges(spark):
    df = spark.range(500).select("id", F.md5(F.col("id").cast("string")).alias("h"))
    want = [r["id"] for r in df.orderBy("h").collect()]
    for per_range in (10, 100_000):
        got = hash_rank(df, [], "h", "k", per_range=per_range).orderBy("k").collect()
        assert [r["id"] for r in got] == want and [r["k"] for r in got] == list(range(1, 501))


def test_period_limit_is_a_parameter(spark):
    df = spark.range(30).select(F.col("id").alias("u"), F.col("id").alias("t"), F.lit(1.0).alias("y"))
    sp = PanelSpec(unit="u", time="t", y="y")
    assert len(sp.with_levels(df).times) == 30
    with pytest.raises(ValueError, match="max_levels"):
        sp.with_levels(df, max_levels=10)


def test_discontinuity_and_wald_ratio(spark):
    rows = [(x / 10, 2.0 + .5 * (x / 10) + (3.0 if x >= 0 else 0.0)) for x in range(-40, 41)] + [(None, 1.0), (1.0, None)]
    r = dose.discontinuity(spark.createDataFrame(rows, "x double, y double"), "y", "x", 0.0).first()
    assert r["jump"] == pytest.approx(3) and r["slope_below"] == pytest.approx(.5) and (r["n_below"], r["n_above"]) == (40, 41)
    rows = [(z, float(d + z), 1.0 + 2 * (d + z)) for z in (0, 1) for d in range(5)] + [(None, 1.0, 1.0), (1, None, 9.0)]
    r = dose.wald_ratio(spark.createDataFrame(rows, "z int, d double, y double"), "y", "d", "z").first()
    assert r["ratio"] == pytest.approx(2) and r["first_stage"] == pytest.approx(1) and r["n"] == 10
