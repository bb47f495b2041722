"""Queries for interrupted time series, continuous doses, posteriors and comparison tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bayes as by
from ..operators import compare as cp
from ..operators import dose as do
from ..operators import its
from ..operators import mixed as mx
from ..operators import panel as pn
from ..operators import post as po
from ..operators import regress as rg
from ..operators import staggered as sg
from ..operators.absorb import absorb_exact
from . import effect_queries as eq
from . import fixtures as fx
from .panel_queries import DOSE_FNS
from .registry import query
from .sqltext import FX1, FX2, FX3, FX3D, FX3W, FX4, bias_reduced, demeaned, least_squares, mixed_grid, with_list
from .stage import stage

SP, IT = fx.STAGGERED, fx.ITS
END = IT.times[-1]
EST = "estimate std_error"
QS = [0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40]


def _ls4(xs, names, vcov="CR1", where="true", tag=""):
    return eq._plain(xs, names, vcov, "fx4", where, tag)


def _terms(fit):
    return rg.tidy(fit).select("term", "estimate", "std_error")


# --------------------------------------------------------------------------- interrupted time series

_LINES = f"""WITH {FX4}, ln AS (
  SELECT cohort, regr_slope(y, t) FILTER (WHERE t < cohort) AS b0, regr_intercept(y, t) FILTER (WHERE t < cohort) AS a0,
    regr_slope(y, t) FILTER (WHERE t >= cohort) AS b1, regr_intercept(y, t) FILTER (WHERE t >= cohort) AS a1, count(*) AS n
  FROM fx4 GROUP BY cohort),
seg AS (SELECT CAST(cohort AS INTEGER) AS cohort, a0 AS intercept, b0 AS slope, a1 + b1 * cohort - a0 - b0 * cohort AS treat, b1 - b0 AS since, n FROM ln),
eff AS (SELECT cohort, intercept + slope * {END} AS untreated, intercept + slope * {END} + treat + since * ({END} - cohort) AS treated,
    treat + since * ({END} - cohort) AS effect, n FROM seg)"""


@query("i1_its_lines", f"""{_LINES}
--result
SELECT * FROM seg""", "intercept slope treat since")
def i1(spark, sf):
    return its.its_lines(fx.its_panel(spark, sf), IT)


def _one(g, clock):
    return with_list(FX4, _ls4([clock, "treat", "since"], [clock, "treat", "since"], "CR1", f"cohort = {g}"), recursive=True)


@query("i1_its_one_cohort", f"""{_one(9, "year0")}
--result
SELECT * FROM ls_est""", EST)
def i1c(spark, sf):
    return _terms(its.its_fit_one(its.its_cells(fx.its_panel(spark, sf), IT), IT, 9, vcov="CR1"))


@query("i1_its_event_clock", f"""{_one(14, "yearc")}
--result
SELECT * FROM ls_est""", EST)
def i1e(spark, sf):
    return _terms(its.its_fit_one(its.its_cells(fx.its_panel(spark, sf), IT), IT, 14, "yearc", vcov="CR1"))


@query("i1_its_overlap", f"""{with_list(FX4, _ls4(["yearc", "treat", "since"], ["yearc", "treat", "since"], "CR1", "cohort = 14 AND yearc BETWEEN -9 AND 5"), recursive=True)}
--result
SELECT * FROM ls_est""", EST)
def i1o(spark, sf):
    cells = pn.overlap_window(its.its_cells(fx.its_panel(spark, sf), IT), -9, 5, "yearc")
    return _terms(its.its_fit_one(cells, IT, 14, "yearc", vcov="CR1"))


@query("i2_its_pooled", f"""{with_list(FX4, _ls4(["year0", "treat", "since"], ["year0", "treat", "since"]), recursive=True)}
--result
SELECT * FROM ls_est""", EST)
def i2(spark, sf):
    return _terms(its.its_fit(its.its_cells(fx.its_panel(spark, sf), IT), IT, vcov="CR1"))


@query("i2_its_pooled_event", f"""{with_list(FX4, _ls4(["yearc", "treat", "since"], ["yearc", "treat", "since"]), recursive=True)}
--result
SELECT * FROM ls_est""", EST)
def i2e(spark, sf):
    return _terms(its.its_fit(its.its_cells(fx.its_panel(spark, sf), IT), IT, "yearc", vcov="CR1"))


_LVL, _LVLN = ["year0", "treat", "since", "cohort_14"], ["year0", "treat", "since", "cohort::14"]


@query("i3_its_cohort_level", f"""{with_list(FX4, _ls4(_LVL, _LVLN), recursive=True)}
--result
SELECT * FROM ls_est""", EST)
def i3(spark, sf):
    return _terms(its.its_fit(its.its_cells(fx.its_panel(spark, sf), IT), IT, cohort="level", vcov="CR1"))


_FULL_X = ["cohort_14", "year0", "treat", "since", "cohort_14 * year0", "cohort_14 * treat", "cohort_14 * since"]
_FULL_N = ["cohort::14", "year0", "treat", "since", "cohort::14:year0", "cohort::14:treat", "cohort::14:since"]
_FULL = with_list(FX4, _ls4(_FULL_X, _FULL_N), recursive=True)


def _full_fit(spark, sf, vcov="CR1"):
    return its.its_fit(its.its_cells(fx.its_panel(spark, sf), IT), IT, cohort="full", vcov=vcov)


@query("i4_its_interacted", f"""{_FULL}
--result
SELECT * FROM ls_est""", EST)
def i4(spark, sf):
    return _terms(_full_fit(spark, sf))


@query("i3_its_level_overlap", f"""{with_list(FX4, _ls4(["yearc", "treat", "since", "cohort_14"], ["yearc", "treat", "since", "cohort::14"], where="yearc BETWEEN -9 AND 5"), recursive=True)}
--result
SELECT * FROM ls_est""", EST)
def i3o(spark, sf):
    cells = pn.overlap_window(its.its_cells(fx.its_panel(spark, sf), IT), -9, 5, "yearc")
    return _terms(its.its_fit(cells, IT, "yearc", "level", vcov="CR1"))


@query("i4_its_interacted_overlap", f"""{with_list(FX4, _ls4([x.replace("year0", "yearc") for x in _FULL_X], [n.replace("year0", "yearc") for n in _FULL_N], where="yearc BETWEEN -9 AND 5"), recursive=True)}
--result
SELECT * FROM ls_est""", EST)
def i4o(spark, sf):
    cells = pn.overlap_window(its.its_cells(fx.its_panel(spark, sf), IT), -9, 5, "yearc")
    return _terms(its.its_fit(cells, IT, "yearc", "full", vcov="CR1"))


@query("i4_its_interacted_cr2", f"""{with_list(FX4, _ls4(_FULL_X, _FULL_N, "iid"), bias_reduced(), recursive=True)}
--result
SELECT list_extract(['(Intercept)', {", ".join(f"'{n}'" for n in _FULL_N)}], b.i) AS term, b.b AS estimate, std_error, df
FROM ls_b b JOIN cr2 ON cr2.i = b.i""", "estimate std_error df")
def i4c(spark, sf):
    return eq.reduced_table(spark, _full_fit(spark, sf, "CR2"))


@query("i5_its_level_change", f"""{with_list(FX4, _ls4(["year0", "treat", "cohort_14"], ["year0", "treat", "cohort::14"]), recursive=True)}
--result
SELECT * FROM ls_est""", EST)
def i5(spark, sf):
    return _terms(its.its_fit(its.its_cells(fx.its_panel(spark, sf), IT), IT, cohort="level", slope=False, vcov="CR1"))


def _trend_sql(xs, names):
    return f"""{with_list(FX4, _ls4(xs, names), recursive=True)}
--result
SELECT * FROM ls_est"""


@query("i6_trend", _trend_sql(["year0"], ["year0"]), EST)
def i6(spark, sf):
    return _terms(its.trend_fit(its.its_cells(fx.its_panel(spark, sf), IT), IT))


@query("i6_trend_level", _trend_sql(["year0", "cohort_14"], ["year0", "cohort::14"]), EST)
def i6l(spark, sf):
    return _terms(its.trend_fit(its.its_cells(fx.its_panel(spark, sf), IT), IT, "level"))


@query("i6_trend_full", _trend_sql(["year0", "cohort_14", "year0 * cohort_14"], ["year0", "cohort::14", "year0:cohort::14"]), EST)
def i6f(spark, sf):
    return _terms(its.trend_fit(its.its_cells(fx.its_panel(spark, sf), IT), IT, "full"))


@query("i7_its_effect_lines", f"""{_LINES}
--result
SELECT * FROM eff""", "untreated treated effect")
def i7(spark, sf):
    return its.its_line_effects(fx.its_panel(spark, sf), IT, END)


def _contrast_sql(rows: list[tuple[str, list[float]]]) -> str:
    """Linear combinations of the interacted model's coefficients with clustered errors."""
    parts = []
    for label, w in rows:
        vec = ", ".join(f"CAST({v} AS DOUBLE)" for v in w)
        parts.append(f"SELECT '{label}' AS term, unnest(range(1, {len(w) + 1})) AS i, unnest([{vec}]) AS w")
    return f"""{_FULL}, cw AS ({" UNION ALL ".join(parts)})
--result
SELECT e.term, e.estimate, s.std_error FROM (SELECT term, sum(w * b) AS estimate FROM cw JOIN ls_b ON ls_b.i = cw.i GROUP BY term) e
JOIN (SELECT a.term, sqrt(sum(a.w * v.v * c.w)) AS std_error FROM cw a JOIN ls_full v ON v.i = a.i JOIN cw c ON c.i = v.j AND c.term = a.term GROUP BY a.term) s
ON s.term = e.term"""


# order of the coefficients: intercept, cohort 14, year0, treat, since and the three products
_UN9, _TR9 = [1, 0, END, 0, 0, 0, 0, 0], [1, 0, END, 1, END - 9, 0, 0, 0]
_UN14, _TR14 = [1, 1, END, 0, 0, END, 0, 0], [1, 1, END, 1, END - 14, END, 1, END - 14]
_DIFF9, _DIFF14 = [a - b for a, b in zip(_TR9, _UN9)], [a - b for a, b in zip(_TR14, _UN14)]


@query("i7_its_effect_model", _contrast_sql([
    ("untreated 9", _UN9), ("treated 9", _TR9), ("effect 9", _DIFF9),
    ("untreated 14", _UN14), ("treated 14", _TR14), ("effect 14", _DIFF14)]), EST)
def i7m(spark, sf):
    return its.its_effect(_full_fit(spark, sf), IT, END).select("term", "estimate", "std_error")


@query("i8_its_weighted", f"""{_LINES}
--result
SELECT sum(n * effect) / sum(n) AS effect FROM eff""", "effect")
def i8(spark, sf):
    return its.its_weighted_effect(its.its_line_effects(fx.its_panel(spark, sf), IT, END))


def _avg(a, b):
    return [x / 3 + 2 * y / 3 for x, y in zip(a, b)]


@query("i8_its_weighted_model", _contrast_sql([
    ("untreated all", _avg(_UN9, _UN14)), ("treated all", _avg(_TR9, _TR14)), ("effect all", _avg(_DIFF9, _DIFF14))]), EST)
def i8m(spark, sf):
    out = its.its_effect(_full_fit(spark, sf), IT, END, weights={9: 1 / 3, 14: 2 / 3})
    return out.filter(F.col("term").endswith("all")).select("term", "estimate", "std_error")


@query("i9_its_slopes", _contrast_sql([
    ("treat 9", [0, 0, 0, 1, 0, 0, 0, 0]), ("treat 14", [0, 0, 0, 1, 0, 0, 1, 0]),
    ("since 9", [0, 0, 0, 0, 1, 0, 0, 0]), ("since 14", [0, 0, 0, 0, 1, 0, 0, 1])]), EST)
def i9(spark, sf):
    return its.its_slopes(_full_fit(spark, sf), IT).select("term", "estimate", "std_error")


_SHIFT = "fx4n AS (SELECT * REPLACE (y + CASE WHEN cohort = 14 AND t < 7 THEN CAST(0.5 AS DOUBLE) * (t - 7) ELSE 0 END AS y) FROM fx4)"


@query("i10_its_sensitivity", f"""{with_list(FX4, _SHIFT, _ls4(_FULL_X, _FULL_N, tag="a"),
    eq._plain(_FULL_X, _FULL_N, "CR1", "fx4n", tag="b"), recursive=True)}
--result
SELECT a.term, a.estimate AS before_estimate, a.std_error AS before_std_error, b.estimate AS after_estimate, b.std_error AS after_std_error
FROM lsa_est a JOIN lsb_est b ON b.term = a.term""", "before_estimate before_std_error after_estimate after_std_error")
def i10(spark, sf):
    df = stage(fx.its_panel(spark, sf), "panel")
    after = pn.perturb_trend(df, "y", (F.col("cohort") == 14) & (F.col("t") < 7), F.lit(0.5) * (F.col("t") - 7))
    fits = [(n, its.its_fit(its.its_cells(d, IT), IT, cohort="full", vcov="CR1"))
            for n, d in (("before", df), ("after", after))]
    return cp.compare_models([(n, rg.tidy(f)) for n, f in fits])


@query("f2_predict_grid", _contrast_sql([("0/0", _UN9), ("0/1", _TR9), ("1/0", _UN14), ("1/1", _TR14)])
       .replace("SELECT e.term, e.estimate, s.std_error", "SELECT e.term, e.estimate AS pred, s.std_error AS pred_se"), "pred pred_se")
def f2(spark, sf):
    fit = _full_fit(spark, sf)
    ends = fx.its_panel(spark, sf).groupBy("cohort").agg(F.max("t").alias("year0"))
    grid = pn.skeleton(ends, treat=[0, 1]).withColumn("since", F.col("treat") * (F.col("year0") - F.col("cohort")))
    label = F.concat((F.col("cohort") == 14).cast("int"), F.lit("/"), F.col("treat"))
    return rg.predict(fit, grid).select(label.alias("term"), "pred", "pred_se")


@query("f5_avg_slopes", _contrast_sql([
    ("treat cohort=9", [0, 0, 0, 1, 0, 0, 0, 0]), ("treat cohort=14", [0, 0, 0, 1, 0, 0, 1, 0]),
    ("since cohort=9", [0, 0, 0, 0, 1, 0, 0, 0]), ("since cohort=14", [0, 0, 0, 0, 1, 0, 0, 1])]), EST)
def f5(spark, sf):
    cells = its.its_cells(fx.its_panel(spark, sf), IT)
    fit = its.its_fit(cells, IT, cohort="full", vcov="CR1")
    return po.avg_slopes(fit, cells, ["treat", "since"], ["cohort"], "n").select("term", "estimate", "std_error")


# --------------------------------------------------------------------------- continuous dose

@query("t1_dose_twfe", f"""WITH {FX2}
--result
SELECT regr_slope(delta_y, dose) AS estimate, count(*) AS n FROM fx2w""", "estimate")
def t1(spark, sf):
    return do.dose_twfe(fx.two_period(spark, sf), fx.TWO_PERIOD)


@query("r2_dose_line", f"""WITH {FX2}
--result
SELECT regr_intercept(delta_y, dose) AS intercept, regr_slope(delta_y, dose) AS slope FROM fx2w""", "intercept slope")
def r2d(spark, sf):
    return do.dose_line(fx.two_period(spark, sf), fx.TWO_PERIOD)


@query("t2_mean_true_effect", f"""WITH {FX2}
--result
SELECT avg(20 * exp(-dose / 4)) AS att FROM fx2w""", "att")
def t2(spark, sf):
    wide = pn.two_period_delta(fx.two_period(spark, sf), "unit", "period", "y", ["dose"])
    return do.mean_true_effect(wide, "dose", DOSE_FNS["declining"])


@query("t3_twfe_weights", f"""WITH {FX2}, m AS (SELECT avg(dose) AS m FROM fx2w)
--result
SELECT unit, dose - m AS weight, CASE WHEN dose - m < 0 THEN 'negative' ELSE 'positive' END AS sign FROM fx2w, m""", "weight")
def t3(spark, sf):
    wide = pn.two_period_delta(fx.two_period(spark, sf), "unit", "period", "y", ["dose"])
    return do.twfe_weights(wide, "dose").select("unit", "weight", "sign")


@query("t4_weight_anatomy", f"""WITH {FX2}, m AS (SELECT avg(dose) AS m FROM fx2w), w AS (SELECT dose - m AS w, 20 * exp(-dose / 4) AS a FROM fx2w, m)
--result
SELECT corr(w, a) AS corr, avg(CASE WHEN w < 0 THEN 1 ELSE 0 END) AS negative_share,
  sum(CASE WHEN w < 0 THEN -w ELSE 0 END) / sum(abs(w)) AS negative_weight FROM w""", "corr negative_share negative_weight")
def t4(spark, sf):
    wide = pn.two_period_delta(fx.two_period(spark, sf), "unit", "period", "y", ["dose"])
    return do.weight_anatomy(wide, "dose", DOSE_FNS["declining"])


@query("t5_acrt_at_median", f"""WITH {FX2}
--result
SELECT median(dose) AS median, 3 / sqrt(5 * median(dose)) AS acrt FROM fx2w""", "median acrt")
def t5(spark, sf):
    wide = pn.two_period_delta(fx.two_period(spark, sf), "unit", "period", "y", ["dose"])
    return do.acrt_at_median(wide, "dose", lambda d: F.lit(3.0) / F.sqrt(F.lit(5.0) * d))


@query("t6_estimand_ratio", f"""WITH {FX2}, s AS (SELECT regr_slope(delta_y + dose / 2, dose) AS twfe, avg(dose / 2) AS att FROM fx2w)
--result
SELECT twfe, att, att / twfe AS ratio FROM s""", "twfe att ratio")
def t6(spark, sf):
    df = fx.two_period(spark, sf).withColumn("y", F.col("y") + F.col("period") * DOSE_FNS["linear"](F.col("dose")))
    return do.estimand_ratio(df, fx.TWO_PERIOD, DOSE_FNS["linear"])


@query("t7_always_on_twfe", f"""WITH {FX3W}
--result
SELECT sum(dose * y) / sum(dose * dose) AS estimate FROM fx3w""", "estimate")
def t7(spark, sf):
    return do.always_on_twfe(fx.always_on(spark, sf), fx.ALWAYS_ON)


_Q = [f"CASE WHEN t = {t} THEN 1 ELSE 0 END" for t in range(1, 28)]


@query("t7_always_on_fit", f"""{with_list(FX3, least_squares(demeaned("(SELECT * FROM fx3 WHERE y IS NOT NULL) AS q",
    [("y", "y"), ("x0", "dose")] + [(f"x{i + 1}", q) for i, q in enumerate(_Q)], "unit", "cluster AS cl"),
    [f"x{i}" for i in range(28)], ["dose"] + [f"t::{t}" for t in range(1, 28)], "CR1", 29), recursive=True)}
--result
SELECT * FROM ls_est WHERE term = 'dose'""", EST)
def t7f(spark, sf):
    fit = do.always_on_fit(fx.always_on(spark, sf), fx.ALWAYS_ON)
    return rg.tidy(fit, ["dose"]).select("term", "estimate", "std_error")


@query("t8_always_on_oracle", f"""WITH {FX3W}, s AS (SELECT sum(dose * dose) AS dd, sum(control * control) AS cc, sum(dose * control) AS dc,
  sum(dose * y) AS dy, sum(control * y) AS cy FROM fx3w)
--result
SELECT (cc * dy - dc * cy) / (dd * cc - dc * dc) AS estimate, (dd * cy - dc * dy) / (dd * cc - dc * dc) AS control FROM s""", "estimate control")
def t8(spark, sf):
    return do.always_on_twfe(fx.always_on(spark, sf), fx.ALWAYS_ON, ["control"])


def _aoss_sql(qs: list[float], y: str = "d_y") -> str:
    eps = " UNION ALL ".join(f"SELECT t, CAST({q} AS DOUBLE) AS q, quantile_cont(abs(d_dose), {q}) AS eps FROM fx3d GROUP BY t" for q in qs)
    return f"""WITH {FX3D}, ep AS ({eps}),
mk AS (SELECT d.unit, d.t, q, eps, d_dose, d_y, dose_lag, {y} AS yy, abs(d_dose) <= eps AS is_qs FROM fx3d d JOIN ep ON ep.t = d.t),
ln AS (SELECT t, q, regr_slope(yy, dose_lag) FILTER (WHERE is_qs) AS b, regr_intercept(yy, dose_lag) FILTER (WHERE is_qs) AS a,
  count(*) FILTER (WHERE is_qs) AS n_qs, count(*) FILTER (WHERE NOT is_qs) AS n_sw FROM mk GROUP BY t, q),
ce AS (SELECT mk.t, mk.q, sum((yy - a - b * dose_lag) * d_dose) AS num, sum(d_dose * d_dose) AS den FROM mk JOIN ln ON ln.t = mk.t AND ln.q = mk.q
  WHERE NOT is_qs GROUP BY 1, 2),
pe AS (SELECT ln.t, ln.q, n_qs, n_sw, CASE WHEN n_qs >= 10 AND n_sw >= 10 THEN num END AS num, CASE WHEN n_qs >= 10 AND n_sw >= 10 THEN den END AS den,
  CASE WHEN n_qs >= 10 AND n_sw >= 10 THEN num / den END AS est FROM ln LEFT JOIN ce ON ce.t = ln.t AND ce.q = ln.q),
mean_q AS (SELECT q, avg(est) AS estimate, count(est) AS n_periods FROM pe GROUP BY q)"""


@query("t9_quasi_stayers", f"""{_aoss_sql([0.2])}
--result
SELECT unit, t, eps, is_qs FROM mk""", "eps")
def t9(spark, sf):
    return do.quasi_stayers(do.differences(fx.always_on(spark, sf), fx.ALWAYS_ON), "t", 0.2).select("unit", "t", "eps", "is_qs")


@query("t10_stayer_counterfactual", f"""{_aoss_sql([0.2])}
--result
SELECT unit, mk.t, a + b * dose_lag AS cf, d_y - a - b * dose_lag AS ce FROM mk JOIN ln ON ln.t = mk.t WHERE NOT is_qs""", "cf ce")
def t10(spark, sf):
    return do.stayer_counterfactual(do.differences(fx.always_on(spark, sf), fx.ALWAYS_ON), "t", 0.2).select("unit", "t", "cf", "ce")


@query("t11_aoss_by_period", f"""{_aoss_sql([0.2])}
--result
SELECT t, q, CAST(n_qs AS BIGINT) AS n_qs, CAST(n_sw AS BIGINT) AS n_sw, est FROM pe""", "q est")
def t11p(spark, sf):
    d = do.differences(fx.always_on(spark, sf), fx.ALWAYS_ON)
    return do.aoss_by_period(d, "t", [0.2]).select("t", "q", "n_qs", "n_sw", "est")


@query("t11_aoss", f"""{_aoss_sql([0.2])}
--result
SELECT * FROM mean_q""", "q estimate")
def t11(spark, sf):
    return do.aoss(do.differences(fx.always_on(spark, sf), fx.ALWAYS_ON), "t", [0.2])


@query("t11_aoss_pooled", f"""{_aoss_sql([0.2])}
--result
SELECT q, sum(num) / sum(den) AS estimate, count(est) AS n_periods FROM pe GROUP BY q""", "q estimate")
def t11q(spark, sf):
    return do.aoss(do.differences(fx.always_on(spark, sf), fx.ALWAYS_ON), "t", [0.2], pool="pooled")


@query("t12_aoss_sweep", f"""{_aoss_sql(QS)}
--result
SELECT *, min(estimate) OVER () AS min_estimate, max(estimate) OVER () AS max_estimate FROM mean_q""", "q estimate min_estimate max_estimate")
def t12(spark, sf):
    return do.aoss_sweep(do.differences(fx.always_on(spark, sf), fx.ALWAYS_ON), "t", QS)


@query("t13_bias_ratio", f"""{_aoss_sql([0.2])},
w AS (SELECT unit, t, y - avg(y) OVER (PARTITION BY unit) - avg(y) OVER (PARTITION BY t) + avg(y) OVER () AS y,
  dose - avg(dose) OVER (PARTITION BY unit) - avg(dose) OVER (PARTITION BY t) + avg(dose) OVER () AS d FROM fx3),
b AS (SELECT sum(d * y) / sum(d * d) AS twfe FROM w)
--result
SELECT estimate, twfe, abs(estimate - 1.5) / abs(twfe - 1.5) AS bias_ratio FROM mean_q, b""", "estimate twfe bias_ratio")
def t13(spark, sf):
    df = stage(fx.always_on(spark, sf), "panel")
    twfe = do.always_on_twfe(df, fx.ALWAYS_ON).select("estimate")
    est = do.aoss(do.differences(df, fx.ALWAYS_ON), "t", [0.2]).select("estimate").withColumn("twfe", twfe.scalar())
    return est.withColumn("bias_ratio", do.bias_ratio(F.col("estimate"), F.col("twfe"), 1.5))


@query("t14_confounded_share", f"""WITH {FX3W}, lg AS (SELECT unit, t, control - lag(control) OVER w AS dc, (dose - control) - lag(dose - control) OVER w AS du
  FROM fx3 WINDOW w AS (PARTITION BY unit ORDER BY t))
--result
SELECT 'changes' AS form, var_samp(dc) / (var_samp(dc) + var_samp(du)) AS share FROM lg
UNION ALL SELECT 'within', var_samp(control) / (var_samp(control) + var_samp(dose - control)) FROM fx3w""", "share")
def t14(spark, sf):
    df = fx.always_on(spark, sf).withColumn("u", F.col("dose") - F.col("control"))
    changes = pn.first_diff(df, "unit", "t", {"control": "dc", "u": "du"})
    within = absorb_exact(df.select("unit", "t", "control", "u"), ["control", "u"], "unit", "t", fx.QUARTERS)
    return cp.stack([
        do.confounded_share(changes, "dc", "du").select(F.lit("changes").alias("form"), "share"),
        do.confounded_share(within, "control", "u").select(F.lit("within").alias("form"), "share")])


# --------------------------------------------------------------------------- dose designs described in prose

@query("n1_dose_bins", f"""WITH {FX2}, b AS (SELECT CASE WHEN dose <= 0 THEN 0 WHEN dose <= 2 THEN 1 WHEN dose <= 4 THEN 2 WHEN dose <= 6 THEN 3 WHEN dose <= 8 THEN 4 ELSE 5 END AS bin, dose, delta_y FROM fx2w),
m AS (SELECT bin, avg(delta_y) AS mean_delta, avg(dose) AS mean_dose, count(*) AS n FROM b GROUP BY bin)
--result
SELECT bin, mean_delta, mean_dose, n, mean_delta - (SELECT mean_delta FROM m WHERE bin = 0) AS att FROM m WHERE bin > 0""", "mean_delta mean_dose att")
def n1(spark, sf):
    return do.dose_bins(fx.two_period(spark, sf), fx.TWO_PERIOD, [2, 4, 6, 8])


@query("n2_any_dose_att", f"""WITH {FX2}
--result
SELECT avg(delta_y) FILTER (WHERE dose > 0) - avg(delta_y) FILTER (WHERE dose <= 0) AS att, count(*) FILTER (WHERE dose > 0) AS n_dosed,
  count(*) FILTER (WHERE dose <= 0) AS n_zero FROM fx2w""", "att")
def n2(spark, sf):
    return do.any_dose_att(fx.two_period(spark, sf), fx.TWO_PERIOD)


_POLY = with_list(FX2, least_squares("SELECT delta_y AS y, 0 AS cl, 1 AS x0, dose AS x1, dose * dose AS x2, dose * dose * dose AS x3 FROM fx2w",
                                     [f"x{i}" for i in range(4)], ["c", "a", "b", "d"]), recursive=True)


@query("n3_average_derivative", f"""{_POLY}
--result
SELECT (SELECT b FROM ls_b WHERE i = 2) + 2 * (SELECT b FROM ls_b WHERE i = 3) * avg(dose) + 3 * (SELECT b FROM ls_b WHERE i = 4) * avg(dose * dose) AS acrt,
  count(*) AS n FROM fx2w""", "acrt")
def n3(spark, sf):
    return do.average_derivative(fx.two_period(spark, sf), fx.TWO_PERIOD, 3)


@query("n5_wald_ratio", f"""WITH {FX2}, z AS (SELECT fx2w.*, c_nationkey % 2 AS z FROM fx2w JOIN customer ON c_custkey = unit)
--result
SELECT (avg(delta_y) FILTER (WHERE z = 1) - avg(delta_y) FILTER (WHERE z = 0)) / (avg(dose) FILTER (WHERE z = 1) - avg(dose) FILTER (WHERE z = 0)) AS ratio,
  avg(dose) FILTER (WHERE z = 1) - avg(dose) FILTER (WHERE z = 0) AS first_stage, count(*) AS n FROM z""", "ratio first_stage")
def n5(spark, sf):
    wide = pn.two_period_delta(fx.two_period(spark, sf), "unit", "period", "y", ["dose", "cluster"])
    return do.wald_ratio(wide.withColumn("z", F.col("cluster") % 2), "delta_y", "dose", "z")


@query("n6_discontinuity", """WITH s AS (SELECT c_custkey, c_acctbal / CAST(1000 AS DOUBLE) AS x, sum(o_totalprice / CAST(97531 AS DOUBLE)) AS y
  FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)
--result
SELECT regr_intercept(y, x - 5) FILTER (WHERE x >= 5) - regr_intercept(y, x - 5) FILTER (WHERE x < 5) AS jump,
  regr_slope(y, x - 5) FILTER (WHERE x < 5) AS slope_below, regr_slope(y, x - 5) FILTER (WHERE x >= 5) AS slope_above,
  count(*) FILTER (WHERE x < 5) AS n_below, count(*) FILTER (WHERE x >= 5) AS n_above FROM s""", "jump slope_below slope_above")
def n6(spark, sf):
    y = fx.yearly_orders(spark, sf).groupBy("unit").agg(F.sum("amount").alias("y"))
    x = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("unit"), (F.col("c_acctbal") / 1000.0).alias("x"))
    return do.discontinuity(x.join(y, "unit"), "y", "x", 5.0)


@query("n4_stayer_placebo", f"""{_aoss_sql([0.2], "dyl").replace("fx3d AS (SELECT * FROM fx3_lag WHERE t - tp = 1)",
    "fx3_lag2 AS (SELECT *, lag(d_y) OVER (PARTITION BY unit ORDER BY t) AS dyl FROM fx3_lag), fx3d AS (SELECT * FROM fx3_lag2 WHERE t - tp = 1 AND t >= 2)")}
--result
SELECT * FROM mean_q""", "q estimate")
def n4(spark, sf):
    d = do.differences(fx.always_on(spark, sf), fx.ALWAYS_ON)
    lagged = pn.first_diff(d, "unit", "t", {}, {"d_y": "d_y_before"})
    return do.aoss(lagged, "t", [0.2], y="d_y_before")


# --------------------------------------------------------------------------- posteriors

def _ridge_sql(sd: float, isd: float) -> str:
    """Closed form by adding s2/sd^2 to the diagonal of the normal equations."""
    xs = [*eq.CELL_SQL, *eq._cx, *eq._ty]
    names = [*eq.CELL_NAMES, *eq._cn, *eq._tn]
    k = len(xs) + 1
    base = with_list(FX1, eq._plain(xs, names, "iid"), recursive=True)
    return f"""{base}, s2 AS (SELECT sum(e * e) / (count(*) - {k}) AS s2 FROM ls_e),
pm AS (SELECT i, j, v / (SELECT s2 FROM s2) + CASE WHEN i = j THEN CASE WHEN i = 1 THEN 1 / CAST({isd * isd} AS DOUBLE) ELSE 1 / CAST({sd * sd} AS DOUBLE) END ELSE 0 END AS v
  FROM ls_m WHERE j <= {k} UNION ALL SELECT i, j, v FROM ls_m WHERE j > {k}),
pg(p, i, j, v) AS (SELECT 0, i, j, CAST(v AS DOUBLE) FROM pm UNION ALL
  SELECT r.p + 1, r.i, r.j, CASE WHEN r.i = r.p + 1 THEN r.v / pv.v ELSE r.v - c.v * w.v / pv.v END
  FROM pg r JOIN pg pv ON pv.i = r.p + 1 AND pv.j = r.p + 1 JOIN pg c ON c.i = r.i AND c.j = r.p + 1 JOIN pg w ON w.i = r.p + 1 AND w.j = r.j
  WHERE r.p < {k}),
pi AS (SELECT i, j - {k} AS j, v FROM pg WHERE p = {k} AND j > {k})
--result
SELECT list_extract(['(Intercept)', {", ".join(f"'{n}'" for n in names)}], pi.i) AS term, sum(pi.v * q.v / (SELECT s2 FROM s2)) AS estimate,
  sqrt(max(CASE WHEN pi.i = pi.j THEN pi.v END)) AS std_error FROM pi JOIN ls_xy q ON q.j = pi.j GROUP BY pi.i"""


@query("b1_ridge_posterior", _ridge_sql(100.0, 100.0), EST)
def b1(spark, sf):
    cells = sg.panel_cells(fx.staggered(spark, sf), SP)
    return by.ridge_posterior(cells, sg.etwfe_design(SP, "cohort"), 100.0).select("term", "estimate", "std_error")


@query("b1_ridge_informative", _ridge_sql(5.0, 10.0), EST)
def b1i(spark, sf):
    cells = sg.panel_cells(fx.staggered(spark, sf), SP)
    return by.ridge_posterior(cells, sg.etwfe_design(SP, "cohort"), 5.0, 10.0).select("term", "estimate", "std_error")


@query("b2_random_intercept")
def b2(spark, sf):
    cells = sg.panel_cells(fx.staggered(spark, sf), SP)
    return by.random_intercept(cells, "cluster", sg.etwfe_design(SP, "cohort"), 5.0, 10.0).select(
        "term", "estimate", "std_error")


# Deviations of the posterior's grid; the log density is given by row, as a sum over many rows has few digits left.
_B2_SIGMAS, _B2_TAUS = [1.5, 2.0, 2.5, 3.0, 3.5], [0.0, 0.05, 0.1, 0.25, 0.5]
_B2_NAMES = ["(Intercept)", *eq.CELL_NAMES, *eq._cn, *eq._tn]
_B2 = with_list(FX1, mixed_grid(
    "SELECT cluster AS cl, 0 AS v, y, 1 AS x0, " + ", ".join(f"{x} AS x{i + 1}" for i, x in enumerate([*eq.CELL_SQL, *eq._cx, *eq._ty])) + " FROM fx1",
    eq._xs(len(_B2_NAMES)), _B2_SIGMAS, _B2_TAUS, [1 / 100.0, *[1 / 25.0] * (len(_B2_NAMES) - 1)]), recursive=True)


def _b2_posterior(spark, sf):
    r = mx.reduce_rows(sg.panel_cells(fx.staggered(spark, sf), SP), "cluster", sg.etwfe_design(SP, "cohort"))
    return r, mx.posterior_on_grid(r, mx.Priors(sd=5.0, intercept_sd=10.0), _B2_SIGMAS, _B2_TAUS)


@query("b2_deviation_posterior", f"""{_B2}
--result
SELECT sigma, tau AS sd_cluster, (v - tau - 2.0 * ln(1 + sigma * sigma / (2.5 * 2.5) / 3.0)) / (SELECT count(*) FROM fx1) AS log_density_by_row FROM mx_log""", "sigma sd_cluster log_density_by_row")
def b2d(spark, sf):
    r, p = _b2_posterior(spark, sf)
    return spark.createDataFrame([(float(s), float(t), float(v) / r.n) for (s, t), v in zip(p.nodes, p.log)],
                                 "sigma double, sd_cluster double, log_density_by_row double")


@query("b2_posterior_on_grid", eq.mixture_sql(_B2, _B2_NAMES), EST)
def b2g(spark, sf):
    return _b2_posterior(spark, sf)[1].table(spark).select("term", "estimate", "std_error")


_DRAWS = [(g, t) for g in SP.cohorts for t in SP.times if t >= g]


def _draws(spark, sf):
    """One row per unit: change of the outcome since before the treatment, a column per (cohort, period)."""
    rows = fx.staggered(spark, sf)
    at = {t: F.sum(F.when(F.col("year") == t, F.col("y"))) for t in SP.times}
    return rows.groupBy("unit").agg(*[(at[t] - at[g - 1]).alias(f"att_{g}_{t}") for g, t in _DRAWS]).drop("unit")


@query("b3_summarise_draws", f"""WITH {FX1}, dr AS ({" UNION ALL ".join(
    f"SELECT 'att_{g}_{t}' AS param, {g} AS cohort, {t} AS year, sum(y) FILTER (WHERE year = {t}) - sum(y) FILTER (WHERE year = {g - 1}) AS value FROM fx1 GROUP BY unit"
    for g, t in _DRAWS)}),
md AS (SELECT param, cohort, year, median(value) AS median, quantile_cont(value, 0.025) AS low, quantile_cont(value, 0.975) AS high FROM dr GROUP BY 1, 2, 3)
--result
SELECT CAST(md.cohort AS INTEGER) AS cohort, CAST(md.year AS INTEGER) AS year, md.param, median, median(abs(value - median)) * 1.4826 AS mad, low, high
FROM dr JOIN md ON md.param = dr.param GROUP BY ALL""", "median mad low high")
def b3(spark, sf):
    return by.summarise_draws(_draws(spark, sf), [f"att_{g}_{t}" for g, t in _DRAWS])


# --------------------------------------------------------------------------- comparison tables

def _t24(x: str) -> str:
    """SQL of the two-sided tail of the t law with 24 degrees of freedom, a finite sum for an even number."""
    return f"""1 - abs({x}) / sqrt(24 + {x} * {x}) * list_sum(list_transform(range(12), lambda j:
  exp(lgamma(2 * j + 1) - 2 * lgamma(j + 1) - j * ln(CAST(4 AS DOUBLE))) * pow(24 / (24 + {x} * {x}), j)))"""


@query("c1_tidy", f"""{eq._D9}
--result
SELECT term, estimate, std_error, estimate / std_error AS statistic, {_t24("(estimate / std_error)")} AS p_value, estimate - 2.0638985616280205 * std_error AS conf_low,
  estimate + 2.0638985616280205 * std_error AS conf_high, false AS dropped FROM ls_est""", "estimate std_error statistic p_value conf_low conf_high")
def c1(spark, sf):
    return rg.tidy(sg.etwfe(sg.panel_cells(fx.staggered(spark, sf), SP), SP, "cluster"))


_C2 = with_list(FX1, eq._absorbed(["treat", *eq._ty], ["treat", *eq._tn], tag="a"),
                eq._absorbed([*eq.CELL_SQL, *eq._ty], [*eq.CELL_NAMES, *eq._tn], tag="b"), recursive=True)


@query("c2_compare_models", f"""{_C2}
--result
SELECT coalesce(a.term, b.term) AS term, a.estimate AS twfe_estimate, a.std_error AS twfe_std_error, b.estimate AS etwfe_estimate, b.std_error AS etwfe_std_error
FROM lsa_est a FULL JOIN lsb_est b ON b.term = a.term""", "twfe_estimate twfe_std_error etwfe_estimate etwfe_std_error")
def c2(spark, sf):
    cells = sg.panel_cells(fx.staggered(spark, sf), SP)
    return cp.compare_models([("twfe", rg.tidy(sg.twfe(cells, SP))), ("etwfe", rg.tidy(sg.etwfe(cells, SP)))])


# The same SQL tables serve both comparisons: the average of the group-time effects next to the two-way slope.
_C2S = f"""{eq._agg_sql("post = 1", "'treat'").split("--result")[0]}""" + """, cs AS (
  SELECT ai.term, max(agg) AS estimate, sqrt(sum(v * v)) / max(n_all) AS std_error FROM ai JOIN tot ON tot.term = ai.term GROUP BY ai.term)"""


def _next_to_cs(body: str) -> str:
    return "WITH RECURSIVE " + _C2S.removeprefix("WITH RECURSIVE ").removeprefix("WITH ") + ",\n" + body


@query("c2_compare_twfe_cs", _next_to_cs(eq._absorbed(["treat", *eq._ty], ["treat", *eq._tn], tag="a")) + """
--result
SELECT a.term, a.estimate AS twfe_estimate, a.std_error AS twfe_std_error, cs.estimate AS cs_estimate, cs.std_error AS cs_std_error
FROM lsa_est a LEFT JOIN cs ON cs.term = a.term""", "twfe_estimate twfe_std_error cs_estimate cs_std_error")
def c2s(spark, sf):
    df = fx.staggered(spark, sf)
    cs = sg.att_intervals(sg.att_inference(df, SP, "simple")).withColumn("term", F.lit("treat"))
    return cp.compare_models([("twfe", rg.tidy(sg.twfe(sg.panel_cells(df, SP), SP))), ("cs", cs)])


_EVENT = eq._ATT + ", dyn AS (SELECT event, sum(n_treated * att) / sum(n_treated) AS estimate FROM attgt GROUP BY event)"


@query("c3_stack_base_row", f"""{_EVENT}
--result
SELECT event, estimate FROM dyn UNION ALL SELECT -4, CAST(0 AS DOUBLE)""", "estimate")
def c3(spark, sf):
    dyn = sg.agg_att(sg.att_gt(fx.staggered(spark, sf), SP), "dynamic").filter(F.col("key").isNotNull())
    each = dyn.select(F.col("key").alias("event"), F.col("att").alias("estimate"))
    halves = cp.stack([each.filter("event < 0"), each.filter("event >= 0")])
    return cp.add_base_row(halves, event=-4, estimate=0.0)


@query("c4_attach_truth", f"""{_EVENT}
--result
SELECT event, estimate, CAST(CASE WHEN event < 0 THEN 0 WHEN event < 2 THEN 1.5 * (event + 1) ELSE 2 * (event + 1) END AS DOUBLE) AS truth,
  CASE WHEN event < 0 THEN 'Pre' ELSE 'Post' END AS phase FROM dyn""", "estimate truth")
def c4(spark, sf):
    dyn = sg.agg_att(sg.att_gt(fx.staggered(spark, sf), SP), "dynamic").filter(F.col("key").isNotNull())
    each = dyn.select(F.col("key").alias("event"), F.col("att").alias("estimate"))
    e = F.col("event")
    truth = F.when(e < 0, F.lit(0.0)).when(e < 2, F.lit(1.5) * (e + 1)).otherwise(F.lit(2.0) * (e + 1))
    return cp.attach_truth(each, "event", truth)


def _scenario_sql(fn: str) -> str:
    return f"SELECT regr_slope(delta_y + {fn}, dose) AS e, avg({fn}) AS tr FROM fx2w"


@query("c5_scenario_summary", f"""WITH {FX2}, a AS ({_scenario_sql("CAST(0.5 AS DOUBLE) * dose")}), b AS ({_scenario_sql("6 * (sqrt(dose / 5) - 1)")}), c AS ({_scenario_sql("20 * exp(-dose / 4)")})
--result
SELECT 'linear' AS scenario, 'two periods' AS setting, round(e, 2) AS estimate, CAST(NULL AS DOUBLE) AS alternative, round(tr, 2) AS truth FROM a
UNION ALL SELECT 'concave', 'two periods', round(e, 2), NULL, round(tr, 2) FROM b
UNION ALL SELECT 'declining', 'two periods', round(e, 2), NULL, round(tr, 2) FROM c""", "estimate alternative truth")
def c5(spark, sf):
    df = fx.two_period(spark, sf)
    rows = []
    for name, fn in DOSE_FNS.items():
        y = df.withColumn("y", F.col("y") + F.col("period") * fn(F.col("dose")))
        wide = pn.two_period_delta(y, "unit", "period", "y", ["dose"])
        rows.append((name, "two periods", wide.agg(
            F.regr_slope("delta_y", "dose").alias("estimate"), F.avg(fn(F.col("dose"))).alias("truth"))))
    return cp.scenario_summary(rows)


@query("c6_labels", f"""{eq._ATT}
--result
SELECT 'ATT(' || g || ',' || t || ')' AS label, 'Relative time: ' || event AS relative, printf('%.2f', round(att, 2)) AS shown FROM attgt""")
def c6(spark, sf):
    att = sg.att_gt(fx.staggered(spark, sf), SP).withColumn("rel", F.concat(F.lit("rel_"), F.col("event")))
    return att.select(cp.att_label("g", "t").alias("label"), cp.strip_prefix("rel", "rel_", "Relative time: ").alias("relative"),
                      cp.fixed_number(F.round("att", 2)).alias("shown"))


@query("c6_rename_terms", f"""{eq._D9}
--result
SELECT 'ATT(' || substr(term, 15, 4) || ',' || substr(term, 26, 4) || ')' AS term, estimate FROM ls_est WHERE term LIKE 'treat%'""", "estimate")
def c6r(spark, sf):
    names = {n: f"ATT({g},{t})" for n, (g, t) in zip(eq.CELL_NAMES, eq.CELLS)}
    return cp.rename_terms(eq.d9(spark, sf), names).select("term", "estimate")
