"""Queries for regression, staggered-adoption estimators, imputation and randomisation inference."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import absorb as ab
from ..operators import imputation as im
from ..operators import mixed as mx
from ..operators import panel as pn
from ..operators import post as po
from ..operators import regress as rg
from ..operators import resample as rs
from ..operators import staggered as sg
from ..operators.design import Design
from ..operators.its import its_cells, its_fit
from . import fixtures as fx
from .registry import query
from .sqltext import (FX1, FX1_GRID, FX2, FX3, FX3W, FX4, FX5, bias_reduced, demeaned, joint_reduced,
                      least_squares, mixed_grid, with_list)
from .stage import stage

SP = fx.STAGGERED
EST = "estimate std_error"
YEARS = list(SP.times)
CELLS = [(g, t) for g in SP.cohorts for t in SP.times if t >= g]
CELL_NAMES = [f"treat:cohort::{g}:year::{t}" for g, t in CELLS]
CELL_SQL = [f"CASE WHEN treat = 1 AND cohort = {g} AND year = {t} THEN 1 ELSE 0 END" for g, t in CELLS]


def _case(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


def _years(first: int) -> tuple[list[str], list[str]]:
    ts = [t for t in YEARS if t >= first]
    return [_case(f"year = {t}") for t in ts], [f"year::{t}" for t in ts]


def _within(xs: list[str], where: str = "true", y: str = "y") -> str:
    """Rows of the staggered panel centered by cluster, as y, cl, x1..xk."""
    cols = [("y", y)] + [(f"x{i}", x) for i, x in enumerate(xs)]
    return demeaned(f"(SELECT * FROM fx1 WHERE {where}) AS q", cols, "cluster", "cluster AS cl")


def _xs(k: int) -> list[str]:
    return [f"x{i}" for i in range(k)]


def _absorbed(xs: list[str], names: list[str], vcov: str = "CR1", where: str = "true", tag: str = "") -> str:
    return least_squares(_within(xs, where), _xs(len(xs)), names, vcov, len(xs) + 1, tag)


def _rows(xs: list[str], src: str = "fx1", where: str = "true", y: str = "y") -> str:
    return (f"SELECT {y} AS y, cluster AS cl, 1 AS x0, "
            + ", ".join(f"{x} AS x{i + 1}" for i, x in enumerate(xs)) + f" FROM {src} WHERE {where}")


def _plain(xs: list[str], names: list[str], vcov: str, src: str = "fx1", where: str = "true", tag: str = "") -> str:
    return least_squares(_rows(xs, src, where), _xs(len(xs) + 1), ["(Intercept)", *names], vcov, None, tag)


def _term_table(fit, keep=None):
    return rg.tidy(fit, keep).filter(~F.col("dropped")).select("term", "estimate", "std_error")


def _keep(prefix: str) -> str:
    return f"SELECT * FROM ls_est WHERE term LIKE '{prefix}%'"


# --------------------------------------------------------------------------- regression

X3, N3 = ["dose", "control"], ["dose", "control"]


@query("r1_ols", f"""{with_list(FX3, _plain(X3, N3, "iid", "fx3", "y IS NOT NULL"), recursive=True)}
--result
SELECT * FROM ls_est""", EST)
def r1(spark, sf):
    return _term_table(rg.ols(stage(fx.always_on(spark, sf), "panel"), "y", ["dose", "control"]))


@query("r2_line_fit", f"""WITH {FX3}
--result
SELECT t, regr_slope(y, dose) AS slope, regr_intercept(y, dose) AS intercept FROM fx3 GROUP BY t""", "slope intercept")
def r2(spark, sf):
    return fx.always_on(spark, sf).groupBy("t").agg(
        F.regr_slope("y", "dose").alias("slope"), F.regr_intercept("y", "dose").alias("intercept"))


_r3x = [_case("cohort = 1997"), _case("cohort = 1999"), "year - 1995",
        f"{_case('cohort = 1997')} * (year - 1995)", f"{_case('cohort = 1999')} * (year - 1995)"]
_r3n = ["cohort::1997", "cohort::1999", "clock", "cohort::1997:clock", "cohort::1999:clock"]


@query("r3_design", f"""{with_list(FX1, _plain(_r3x, _r3n, "HC1"), recursive=True)}
--result
SELECT * FROM ls_est""", EST)
def r3(spark, sf):
    cells = sg.panel_cells(fx.staggered(spark, sf), SP).withColumn("clock", F.col("year") - 1995)
    d = Design().crossed(Design().factor("cohort", SP.cohorts), Design().main("clock"))
    return _term_table(rg.ols(cells, None, d, cells=True, vcov="HC1"))


@query("r4_absorb", f"""WITH {FX1}
--result
SELECT unit, year, y - avg(y) OVER (PARTITION BY unit) - avg(y) OVER (PARTITION BY year) + avg(y) OVER () AS y,
  treat - avg(treat) OVER (PARTITION BY unit) - avg(treat) OVER (PARTITION BY year) + avg(treat) OVER () AS treat FROM fx1""", "y treat")
def r4(spark, sf):
    df = fx.staggered(spark, sf).select("unit", "year", "y", F.col("treat").cast("double").alias("treat"))
    return ab.absorb(df, ["y", "treat"], "unit", "year")


_days = list(range(2, 31))
_fx5_rows = demeaned("fx5", [("y", "y")] + [(f"x{i}", _case(f"t = {t}")) for i, t in enumerate(_days)], "unit", "unit AS cl")
_fx5 = with_list(FX5, least_squares(_fx5_rows, _xs(len(_days)), [str(t) for t in _days]), """
lam AS (SELECT CAST(term AS INTEGER) AS t, estimate AS l FROM ls_est UNION ALL SELECT 1, 0.0),
adj AS (SELECT unit, fx5.t, y - l AS r FROM fx5 JOIN lam ON lam.t = fx5.t)""", recursive=True)


@query("r4_absorb_unbalanced", f"""{_fx5}
--result
SELECT unit, t, r - avg(r) OVER (PARTITION BY unit) AS y FROM adj""", "y")
def r4u(spark, sf):
    df = stage(fx.daily_users(spark, sf).select("unit", "t", "y"), "users")
    times = [r["t"] for r in df.select("t").distinct().orderBy("t").collect()]
    return ab.absorb(df, ["y"], "unit", "t", times, method="unbalanced")


@query("r4_absorb_iterative", f"""{_fx5}
--result
SELECT unit, t, r - avg(r) OVER (PARTITION BY unit) AS y FROM adj""", "y")
def r4i(spark, sf):
    return ab.absorb(fx.daily_users(spark, sf).select("unit", "t", "y"), ["y"], "unit", "t", method="iterative")


@query("r4_absorb_gradient", f"""{_fx5}
--result
SELECT unit, t, r - avg(r) OVER (PARTITION BY unit) AS y FROM adj""", "y")
def r4g(spark, sf):
    return ab.absorb(fx.daily_users(spark, sf).select("unit", "t", "y"), ["y"], "unit", "t", method="gradient")


# days are linked where a user has both
@query("r4_effect_components", f"""{with_list(FX5, """
e AS (SELECT DISTINCT a.t, b.t AS u FROM fx5 a JOIN fx5 b ON a.unit = b.unit),
reach(t, u) AS (SELECT t, u FROM e UNION SELECT reach.t, e.u FROM reach JOIN e ON e.t = reach.u),
c AS (SELECT count(DISTINCT m) AS n FROM (SELECT t, min(u) AS m FROM reach GROUP BY t))""", recursive=True)}
--result
SELECT n AS components, (SELECT count(DISTINCT unit) + count(DISTINCT t) FROM fx5) - n AS rank FROM c""")
def r4c(spark, sf):
    links = ab.key_links(fx.daily_users(spark, sf), ["y"], "unit", "t")
    return spark.createDataFrame([ab.effect_components(links)], "components long, rank long")


@query("r5_within_resid", f"""WITH {FX3W}
--result
SELECT unit, t, y, dose, control FROM fx3w WHERE y IS NOT NULL""", "y dose control")
def r5(spark, sf):
    df = fx.always_on(spark, sf).select("unit", "t", "y", "dose", "control")
    return ab.absorb_exact(df, ["y", "dose", "control"], "unit", "t", fx.QUARTERS)


# Untreated two-way fit with cluster effects: period effects from centered rows, then cluster means.
_d17_years, _d17_names = _years(1996)
_fs = with_list(FX1, least_squares(_within(_d17_years, "treat = 0"), _xs(len(YEARS) - 1), [str(t) for t in YEARS[1:]]), """
lam AS (SELECT CAST(term AS INTEGER) AS year, estimate AS l FROM ls_est UNION ALL SELECT 1995, 0.0),
alpha AS (SELECT cluster, avg(y - l) AS a FROM fx1 JOIN lam ON lam.year = fx1.year WHERE treat = 0 GROUP BY cluster),
imp AS (
  SELECT unit, fx1.cluster, cohort, fx1.year, treat, CAST(fx1.year - cohort AS INTEGER) AS event, a + l AS pred, y - a - l AS y_it
  FROM fx1 JOIN lam ON lam.year = fx1.year JOIN alpha ON alpha.cluster = fx1.cluster)""", recursive=True)


@query("r6_add_predictions", f"""{_fs}
--result
SELECT unit, year, pred FROM imp""", "pred")
def r6(spark, sf):
    df = fx.staggered(spark, sf)
    return im.add_predictions(df, im.first_stage(df, SP)).select("unit", "year", "pred")


@query("r7_collinear", f"""{with_list(FX3, _plain(["dose", "control"], ["dose", "control"], "iid", "fx3", "y IS NOT NULL"), recursive=True)}
--result
SELECT term, estimate, std_error, false AS dropped FROM ls_est UNION ALL SELECT 'sum', NULL, NULL, true""", EST)
def r7(spark, sf):
    df = stage(fx.always_on(spark, sf), "panel").withColumn("sum", F.col("dose") + 2 * F.col("control") + 3)
    return rg.tidy(rg.ols(df, "y", ["dose", "control", "sum"])).select("term", "estimate", "std_error", "dropped")


@query("r8_weighted_ols", f"""WITH {FX2}, w AS (
  SELECT sum(y1) AS sw, sum(y1 * dose) / sum(y1) AS mx, sum(y1 * delta_y) / sum(y1) AS my FROM fx2w)
--result
SELECT 'dose' AS term, sum(y1 * (dose - mx) * (delta_y - my)) / sum(y1 * (dose - mx) * (dose - mx)) AS estimate FROM fx2w, w""", "estimate")
def r8(spark, sf):
    wide = stage(pn.two_period_delta(fx.two_period(spark, sf), "unit", "period", "y", ["dose"]), "delta")
    return rg.tidy(rg.ols(wide, "delta_y", ["dose"], weight="y1"), ["dose"]).select("term", "estimate")


# --------------------------------------------------------------------------- staggered adoption

_ty, _tn = _years(1996)


@query("d1_twfe", f"""{with_list(FX1, _absorbed(["treat", *_ty], ["treat", *_tn]), recursive=True)}
--result
SELECT * FROM ls_est WHERE term = 'treat'""", EST)
def d1(spark, sf):
    return _term_table(sg.twfe(sg.panel_cells(fx.staggered(spark, sf), SP), SP), ["treat"])


@query("d1_twfe_closed_form", f"""WITH {FX1}, w AS (
  SELECT y - avg(y) OVER (PARTITION BY unit) - avg(y) OVER (PARTITION BY year) + avg(y) OVER () AS y,
    treat - avg(treat) OVER (PARTITION BY unit) - avg(treat) OVER (PARTITION BY year) + avg(treat) OVER () AS d FROM fx1)
--result
SELECT sum(d * y) / sum(d * d) AS estimate FROM w""", "estimate")
def d1c(spark, sf):
    cells = sg.panel_cells(fx.staggered(spark, sf), SP)
    return sg.twfe_slope(cells, "treat", "cluster", "year")


_rel = [e for e in sg.relative_times(SP) if e != -1]
_rx = [_case(f"year - cohort = {e}") for e in _rel] + _ty
_rn = [f"rel::{e}" for e in _rel] + _tn


@query("d2_twfe_event", f"""{with_list(FX1, _absorbed(_rx, _rn), recursive=True)}
--result
{_keep("rel")}""", EST)
def d2(spark, sf):
    fit = sg.twfe_event(sg.panel_cells(fx.staggered(spark, sf), SP), SP)
    return _term_table(fit, [t for t in fit.terms if t.startswith("rel")])


_ATT = f"WITH {FX1}, {FX1_GRID.strip()}"


@query("d3_att_gt", f"""{_ATT}
--result
SELECT g, t, event, post, att, n_treated, n_control FROM attgt""", "att")
def d3(spark, sf):
    return sg.att_table(sg.att_gt(fx.staggered(spark, sf), SP))


_NEVER = _ATT.replace("a.cohort IS NULL OR (a.cohort > cut AND a.cohort <> g)", "a.cohort IS NULL")


@query("d3_att_gt_never", f"""{_NEVER}
--result
SELECT g, t, event, post, att, n_treated, n_control FROM attgt""", "att")
def d3n(spark, sf):
    return sg.att_table(sg.att_gt(fx.staggered(spark, sf), SP, control="nevertreated"))


# On a logarithm some units have no value in some years; only units with a value in all years are compared.
_LOGGED = ("fxl AS (SELECT unit, cluster, cohort, year, ln(y) AS y FROM fx1 "
           "WHERE unit IN (SELECT unit FROM fx1 GROUP BY unit HAVING min(y) > 0)), ")
_ATT_LOG = _ATT.replace("prof AS (", _LOGGED + "prof AS (").replace(
    "ct AS (SELECT cohort, year AS yr, sum(y) AS s, count(*) AS n FROM fx1 GROUP BY 1, 2)",
    "ct AS (SELECT cohort, year AS yr, sum(y) AS s, count(*) AS n FROM fxl GROUP BY 1, 2)")


@query("d4_att_gt_log", f"""{_ATT_LOG}
--result
SELECT g, t, event, post, att, n_treated, n_control FROM attgt""", "att")
def d4(spark, sf):
    df, sp = sg.logged(fx.staggered(spark, sf), SP)
    return sg.att_table(sg.att_gt(df, sp))


@query("d5_agg_simple", f"""{_ATT}
--result
SELECT 'simple' AS kind, CAST(NULL AS INTEGER) AS key, sum(n_treated * att) / sum(n_treated) AS att FROM attgt WHERE post = 1""", "att")
def d5(spark, sf):
    return sg.agg_att(sg.att_gt(fx.staggered(spark, sf), SP), "simple")


@query("d6_agg_dynamic", f"""{_ATT}, dyn AS (SELECT event AS key, sum(n_treated * att) / sum(n_treated) AS att FROM attgt GROUP BY event)
--result
SELECT 'dynamic' AS kind, key, att FROM dyn UNION ALL SELECT 'dynamic', NULL, avg(att) FROM dyn WHERE key >= 0""", "att")
def d6(spark, sf):
    return sg.agg_att(sg.att_gt(fx.staggered(spark, sf), SP), "dynamic")


@query("d7_agg_group", f"""{_ATT}, grp AS (SELECT g AS key, avg(att) AS att, max(n_treated) AS n FROM attgt WHERE post = 1 GROUP BY g)
--result
SELECT 'group' AS kind, key, att FROM grp UNION ALL SELECT 'group', NULL, sum(n * att) / sum(n) FROM grp""", "att")
def d7(spark, sf):
    return sg.agg_att(sg.att_gt(fx.staggered(spark, sf), SP), "group")


@query("d8_agg_calendar", f"""{_ATT}, cal AS (SELECT t AS key, sum(n_treated * att) / sum(n_treated) AS att FROM attgt WHERE post = 1 GROUP BY t)
--result
SELECT 'calendar' AS kind, key, att FROM cal UNION ALL SELECT 'calendar', NULL, avg(att) FROM cal""", "att")
def d8(spark, sf):
    return sg.agg_att(sg.att_gt(fx.staggered(spark, sf), SP), "calendar")


_D9 = with_list(FX1, _absorbed([*CELL_SQL, *_ty], [*CELL_NAMES, *_tn]), recursive=True)


@query("d9_etwfe_cluster", f"""{_D9}
--result
{_keep("treat")}""", EST)
def d9(spark, sf):
    fit = sg.etwfe(sg.panel_cells(fx.staggered(spark, sf), SP), SP, "cluster")
    return _term_table(fit, CELL_NAMES)


_cx, _cn = [_case("cohort = 1997"), _case("cohort = 1999")], ["cohort::1997", "cohort::1999"]


@query("d10_etwfe_cohort", f"""{with_list(FX1, _plain([*CELL_SQL, *_cx, *_ty], [*CELL_NAMES, *_cn, *_tn], "CR1"), recursive=True)}
--result
{_keep("treat")}""", EST)
def d10(spark, sf):
    fit = sg.etwfe(sg.panel_cells(fx.staggered(spark, sf), SP), SP, "cohort")
    return _term_table(fit, CELL_NAMES)


@query("d11_etwfe_explicit", f"""{with_list(FX1, _plain([*CELL_SQL, *_cx, *_ty], [*CELL_NAMES, *_cn, *_tn], "iid"), recursive=True)}
--result
SELECT * FROM ls_est""", EST)
def d11(spark, sf):
    return _term_table(sg.etwfe(sg.panel_cells(fx.staggered(spark, sf), SP), SP, "explicit", vcov="iid"))


# Saturated: the fitted value of a cell is its mean, whatever terms are dropped for collinearity.
@query("d12_etwfe_crossed", f"""WITH {FX1}
--result
SELECT cohort, year, avg(y) AS pred, count(*) AS n FROM fx1 GROUP BY 1, 2""", "pred")
def d12(spark, sf):
    cells = sg.panel_cells(fx.staggered(spark, sf), SP)
    fit = sg.etwfe(cells, SP, "crossed", vcov="iid")
    by = cells.groupBy("cohort", "year", "treat").agg(F.sum("n").alias("n"))
    return rg.predict(fit, by).select("cohort", "year", "pred", "n")


_late, _laten = _years(1997)


@query("d13_etwfe_late_years", f"""{with_list(FX1, _absorbed([*CELL_SQL, *_late], [*CELL_NAMES, *_laten]), recursive=True)}
--result
SELECT * FROM ls_est""", EST)
def d13(spark, sf):
    return _term_table(sg.etwfe(sg.panel_cells(fx.staggered(spark, sf), SP), SP, "cluster", time_from=1997))


@query("d14_twfe_dummies", f"""{with_list(FX1, _absorbed(["treat", *_ty], ["treat", *_tn]), recursive=True)}
--result
SELECT * FROM ls_est""", EST)
def d14(spark, sf):
    return _term_table(sg.twfe(sg.panel_cells(fx.staggered(spark, sf), SP), SP))


_pre = [(1997, 1996), (1999, 1996), (1999, 1997), (1999, 1998)]
_PRE_X = [_case(f"cohort = {g} AND year = {t}") for g, t in _pre] + _cx + _ty
_PRE_N = [f"evtreat:cohort::{g}:year::{t}" for g, t in _pre] + _cn + _tn
_PRE = with_list(FX1, _plain(_PRE_X, _PRE_N, "CR1", where="treat = 0"), recursive=True)


@query("d15_pretrend_cells", f"""{_PRE}
--result
SELECT * FROM ls_est""", EST)
def d15(spark, sf):
    return _term_table(sg.pretrend_cells(sg.panel_cells(fx.staggered(spark, sf), SP), SP))


_LIN_N = ["ever_treated", "time_since", "ever_treated:time_since"]
_LIN_X = [_case("cohort IS NOT NULL"), "year - 1995", f"{_case('cohort IS NOT NULL')} * (year - 1995)"]


@query("d16_pretrend_linear", f"""{with_list(FX1, _plain(_LIN_X, _LIN_N, "CR1", where="treat = 0"), recursive=True)}
--result
SELECT * FROM ls_est""", EST)
def d16(spark, sf):
    return _term_table(sg.pretrend_linear(fx.staggered(spark, sf), SP))


_LOG_SRC = "(SELECT unit, cluster, cohort, year, treat, ln(y) AS y FROM fx1 WHERE y > 0) AS lg"


@query("d16_pretrend_linear_log", f"""{with_list(FX1, _plain(_LIN_X, _LIN_N, "CR1", _LOG_SRC, "treat = 0"), recursive=True)}
--result
SELECT * FROM ls_est""", EST)
def d16l(spark, sf):
    return _term_table(sg.pretrend_linear(fx.staggered(spark, sf), SP, log=True))


@query("d17_impute_y0", f"""{_fs}
--result
SELECT unit, year, treat, event, pred, y_it FROM imp""", "pred y_it")
def d17(spark, sf):
    return im.impute_y0(fx.staggered(spark, sf), SP).select("unit", "year", "treat", "event", "pred", "y_it")


def _imputed_cells(spark, sf):
    """One pass over the rows: both stages work on the same cells."""
    return im.impute_cells(sg.panel_cells(fx.staggered(spark, sf), SP), SP)


@query("d18_imputation_by_treat", f"""{_fs}
--result
SELECT treat, avg(y_it) AS mean_y_it, count(*) AS n FROM imp GROUP BY treat""", "mean_y_it")
def d18(spark, sf):
    return im.treat_averages(_imputed_cells(spark, sf))


def _imp_sql(key: str) -> str:
    return f"""{_fs}, tr AS (SELECT {key} AS key, y_it FROM imp WHERE treat = 1),
gm AS (SELECT key, avg(y_it) AS estimate, count(*) AS n FROM tr GROUP BY key),
rs AS (SELECT gm.key, estimate, n, sum((y_it - estimate) * (y_it - estimate)) AS rss FROM tr JOIN gm ON gm.key = tr.key GROUP BY 1, 2, 3),
sz AS (SELECT sum(n) AS n, count(*) AS k FROM gm)
--result
SELECT key, estimate, sqrt(rss * CAST(sz.n AS DOUBLE) / (sz.n - sz.k)) / rs.n AS se_second_stage, rs.n AS n FROM rs, sz"""


@query("d19_imputation_simple", _imp_sql("'all'"), "estimate se_second_stage")
def d19s(spark, sf):
    return im.imputation_att(_imputed_cells(spark, sf))


@query("d19_imputation_cohort", _imp_sql("cohort"), "estimate se_second_stage")
def d19c(spark, sf):
    return im.imputation_att(_imputed_cells(spark, sf), "cohort")


@query("d19_imputation_calendar", _imp_sql("year"), "estimate se_second_stage")
def d19t(spark, sf):
    return im.imputation_att(_imputed_cells(spark, sf), "year")


@query("d19_imputation_dynamic", _imp_sql("event"), "estimate se_second_stage")
def d19e(spark, sf):
    return im.imputation_att(_imputed_cells(spark, sf), "event")


# The same predictions with their variance, and the rows of the second stage with a known error.
_PRED_VAR = f"""{_fs}, shares AS (
  SELECT cluster, count(*) AS n0, {", ".join(f"avg({_case(f'year = {t}')}) AS s{t}" for t in YEARS[1:])} FROM fx1 WHERE treat = 0 GROUP BY cluster),
res AS (SELECT sum(y_it * y_it) / (count(*) - count(DISTINCT cluster) - {len(YEARS) - 1}) AS s2 FROM imp WHERE treat = 0),
dv AS (SELECT DISTINCT imp.cluster, imp.year, s.n0, unnest({list(range(1, len(YEARS)))}) AS i,
  unnest([{", ".join(f"{_case(f'imp.year = {t}')} - s{t}" for t in YEARS[1:])}]) AS d FROM imp JOIN shares s ON s.cluster = imp.cluster),
vr AS MATERIALIZED (SELECT a.cluster, a.year, (SELECT s2 FROM res) * (1.0 / a.n0 + sum(a.d * m.v * b.d)) AS pv
  FROM dv a JOIN dv b ON b.cluster = a.cluster AND b.year = a.year JOIN ls_inv m ON m.i = a.i AND m.j = b.i GROUP BY a.cluster, a.year, a.n0)"""
_SIGMAS, _TAUS = [0.5 + 0.25 * i for i in range(15)], [0.0, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5]
_COHORT_TREAT = [_case(f"treat = 1 AND cohort = {g}") for g in SP.cohorts]
_COHORT_NAMES = [f"treat:cohort::{g}" for g in SP.cohorts]


def _measured(xs: list[str], precision: list[float]) -> str:
    rows = ("SELECT imp.cluster AS cl, pv AS v, y_it AS y, " + ", ".join(f"{x} AS x{i}" for i, x in enumerate(xs))
            + " FROM imp JOIN vr ON vr.cluster = imp.cluster AND vr.year = imp.year")
    return f"{_PRED_VAR},{mixed_grid(rows, _xs(len(xs)), _SIGMAS, _TAUS, precision)}"


def _best_sql(xs: list[str], names: list[str]) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return f"""{_measured(xs, [0.0] * len(xs))},
top AS (SELECT node, sigma, tau FROM mx_log ORDER BY v DESC, sigma, tau LIMIT 1)
--result
SELECT list_extract([{listed}], b.i) AS term, b.b AS estimate, sqrt(b.var) AS std_error FROM mx_b b JOIN top ON top.node = b.node
UNION ALL SELECT 'sd_cluster', tau, NULL FROM top UNION ALL SELECT 'sigma', sigma, NULL FROM top"""


def mixture_sql(head: str, names: list[str]) -> str:
    """Posterior means and deviations over the nodes of ``head``; priors on the deviations as in mixed.Priors."""
    listed = ", ".join(f"'{n}'" for n in names)
    return f"""{head},
lp AS (SELECT node, sigma, tau, v - tau - 2.0 * ln(1 + sigma * sigma / (2.5 * 2.5) / 3.0) AS lp FROM mx_log),
ms AS (SELECT node, sigma, tau, exp(lp - max(lp) OVER ()) / sum(exp(lp - (SELECT max(lp) FROM lp))) OVER () AS w FROM lp)
--result
SELECT term, sum(w * m) AS estimate, sqrt(greatest(sum(w * (var + m * m)) - sum(w * m) * sum(w * m), 0)) AS std_error FROM (
  SELECT list_extract([{listed}], b.i) AS term, w, b.b AS m, b.var FROM mx_b b JOIN ms ON ms.node = b.node
  UNION ALL SELECT 'sd_cluster', w, tau, 0 FROM ms UNION ALL SELECT 'sigma', w, sigma, 0 FROM ms) GROUP BY term"""


@query("d20_imputation_weighted", f"""{_PRED_VAR},
tw AS (SELECT imp.cohort AS key, y_it, 1.0 / pv AS w FROM imp JOIN vr ON vr.cluster = imp.cluster AND vr.year = imp.year WHERE treat = 1),
gm AS (SELECT key, sum(w * y_it) / sum(w) AS estimate, sum(w) AS sw, count(*) AS n FROM tw GROUP BY key),
sz AS (SELECT CAST(sum(n) AS DOUBLE) AS n, count(*) AS k FROM gm)
--result
SELECT tw.key, max(estimate) AS estimate, sqrt(sum(w * w * (y_it - estimate) * (y_it - estimate)) * max(sz.n / (sz.n - sz.k))) / max(sw) AS se_second_stage,
  max(gm.n) AS n FROM tw JOIN gm ON gm.key = tw.key, sz GROUP BY tw.key""", "estimate se_second_stage")
def d20(spark, sf):
    df = _imputed_cells(spark, sf)
    return im.imputation_att(df, "cohort", F.lit(1.0) / F.col("pred_var"))


@query("d20_measured_error", _best_sql(["treat"], ["treat"]), EST)
def d20m(spark, sf):
    r = im.measured_error(_imputed_cells(spark, sf), SP)
    return mx.restricted_table(spark, r, mx.restricted_on_grid(r, _SIGMAS, _TAUS))


@query("d20_measured_error_cohort", _best_sql(_COHORT_TREAT, _COHORT_NAMES), EST)
def d20mc(spark, sf):
    r = im.measured_error(_imputed_cells(spark, sf), SP, by_cohort=True)
    return mx.restricted_table(spark, r, mx.restricted_on_grid(r, _SIGMAS, _TAUS))


@query("d20_measured_error_posterior", mixture_sql(_measured(_COHORT_TREAT, [1 / 25.0] * 2), _COHORT_NAMES), EST)
def d20mp(spark, sf):
    r = im.measured_error(_imputed_cells(spark, sf), SP, by_cohort=True)
    return mx.posterior_on_grid(r, mx.Priors(sd=5.0), _SIGMAS, _TAUS).table(spark).select("term", "estimate", "std_error")


_PERM = f"""WITH {FX1}, cl AS (SELECT cluster, min(cohort) AS cohort FROM fx1 GROUP BY cluster),
sz AS (SELECT count(*) FILTER (WHERE cohort = 1997) AS a, count(*) FILTER (WHERE cohort = 1999) AS b, count(*) AS n FROM cl),
rk AS (SELECT rep, cluster, row_number() OVER (PARTITION BY rep ORDER BY md5(concat_ws('|', '5', rep, cluster))) AS slot
  FROM cl CROSS JOIN (SELECT unnest(range(1, 201)) AS rep)),
dr AS (SELECT CAST(rep AS INTEGER) AS rep, cluster, CASE WHEN slot <= a THEN 1997 WHEN slot <= a + b THEN 1999 END AS g FROM rk, sz),
cc AS (SELECT cluster, year, count(*) AS w, avg(y) AS y FROM fx1 GROUP BY 1, 2),
px AS (SELECT rep, cc.cluster, cc.year, w, y, CAST(CASE WHEN year >= g THEN 1 ELSE 0 END AS DOUBLE) AS d FROM dr JOIN cc ON cc.cluster = dr.cluster),
pw AS (SELECT rep, cluster, year, w,
  y - sum(w * y) OVER (PARTITION BY rep, cluster) / sum(w) OVER (PARTITION BY rep, cluster)
    - sum(w * y) OVER (PARTITION BY rep, year) / sum(w) OVER (PARTITION BY rep, year)
    + sum(w * y) OVER (PARTITION BY rep) / sum(w) OVER (PARTITION BY rep) AS y,
  d - sum(w * d) OVER (PARTITION BY rep, cluster) / sum(w) OVER (PARTITION BY rep, cluster)
    - sum(w * d) OVER (PARTITION BY rep, year) / sum(w) OVER (PARTITION BY rep, year)
    + sum(w * d) OVER (PARTITION BY rep) / sum(w) OVER (PARTITION BY rep) AS d FROM px),
pb AS (SELECT rep, sum(w * d * y) / sum(w * d * d) AS b, sum(w * d * d) AS dd, sum(w) AS n FROM pw GROUP BY rep),
ps AS (SELECT pw.rep, cluster, sum(w * d * (y - b * d)) AS s FROM pw JOIN pb ON pb.rep = pw.rep GROUP BY 1, 2),
pr AS (SELECT pb.rep, b AS estimate, sqrt(sum(s * s) * count(*) / (count(*) - 1.0) * (max(n) - 1) / (max(n) - {len(YEARS) + 1})) / max(dd) AS se
  FROM ps JOIN pb ON pb.rep = ps.rep GROUP BY pb.rep, b)"""


@query("d21_permutation_draws", f"""{_PERM}
--result
SELECT rep, estimate, se FROM pr""", "estimate se")
def d21(spark, sf):
    return rs.permutation_draws(sg.panel_cells(fx.staggered(spark, sf), SP), SP, 200, 5).select("rep", "estimate", "se")


# 2.0638985616280205 is the 0.975 quantile of the t law with 24 degrees of freedom (25 clusters)
@query("d21_permutation_test", f"""{_PERM}, ob AS (
  SELECT y - avg(y) OVER (PARTITION BY unit) - avg(y) OVER (PARTITION BY year) + avg(y) OVER () AS y,
    treat - avg(treat) OVER (PARTITION BY unit) - avg(treat) OVER (PARTITION BY year) + avg(treat) OVER () AS d FROM fx1),
o AS (SELECT sum(d * y) / sum(d * d) AS observed FROM ob)
--result
SELECT observed, (count(*) FILTER (WHERE abs(estimate) >= abs(observed)) + 1) / CAST(count(*) + 1 AS DOUBLE) AS p_value,
  avg(CASE WHEN abs(estimate / se) >= 2.0638985616280205 THEN 1 ELSE 0 END) AS rejection_share, count(*) AS n_reps
FROM pr, o GROUP BY observed""", "observed p_value rejection_share")
def d21t(spark, sf):
    cells = sg.panel_cells(fx.staggered(spark, sf), SP)
    return rs.permutation_test(rs.permutation_draws(cells, SP, 200, 5), sg.twfe_slope(cells, "treat", "cluster", "year"))


@query("v11_rejection_share", f"""{_PERM.replace("avg(y) AS y FROM fx1 GROUP BY 1, 2),", "avg(y0) AS y FROM fx1 GROUP BY 1, 2),", 1)}
--result
SELECT avg(CASE WHEN abs(estimate / se) >= 2.0638985616280205 THEN 1 ELSE 0 END) AS rejection_share, count(*) AS n_reps,
  avg(estimate) AS mean_estimate, stddev_samp(estimate) AS sd_estimate FROM pr""", "rejection_share mean_estimate sd_estimate")
def v11(spark, sf):
    df = fx.staggered(spark, sf).withColumn("y", F.col("y0"))
    return po.rejection_share(rs.permutation_draws(sg.panel_cells(df, SP), SP, 200, 5))


# --------------------------------------------------------------------------- inference

_IX = ["year0", "treat", "since", "cohort_14"]
_ITS_N = ["year0", "treat", "since", "cohort::14"]


@query("v1_vcov_iid", f"""{with_list(FX4, _plain(_IX, _ITS_N, "iid", "fx4"), recursive=True)}
--result
SELECT * FROM ls_est""", EST)
def v1(spark, sf):
    return _its_level(spark, sf, "iid")


@query("v2_vcov_hc1", f"""{with_list(FX4, _plain(_IX, _ITS_N, "HC1", "fx4"), recursive=True)}
--result
SELECT * FROM ls_est""", EST)
def v2(spark, sf):
    return _its_level(spark, sf, "HC1")


@query("v3_vcov_cr1", f"""{with_list(FX4, _plain(_IX, _ITS_N, "CR1", "fx4"), recursive=True)}
--result
SELECT * FROM ls_est""", EST)
def v3(spark, sf):
    return _its_level(spark, sf, "CR1")


@query("v4_vcov_cr2", f"""{with_list(FX4, _plain(_IX, _ITS_N, "iid", "fx4"), bias_reduced(), recursive=True)}
--result
SELECT list_extract(['(Intercept)', 'year0', 'treat', 'since', 'cohort::14'], b.i) AS term, b.b AS estimate, std_error, df
FROM ls_b b JOIN cr2 ON cr2.i = b.i""", "estimate std_error df")
def v4(spark, sf):
    return reduced_table(spark, its_fit(its_cells(fx.its_panel(spark, sf), fx.ITS), fx.ITS, "year0", "level"))


_V4_X, _V4_N = ["treat", *_years(1996)[0]], ["treat", *_years(1996)[1]]


@query("v4_cr2_absorbed", f"""{with_list(FX1, _absorbed(_V4_X, _V4_N, "iid"), bias_reduced(), recursive=True)}
--result
SELECT list_extract([{", ".join(f"'{n}'" for n in _V4_N)}], b.i) AS term, b.b AS estimate, std_error, df FROM ls_b b JOIN cr2 ON cr2.i = b.i""",
       "estimate std_error df")
def v4a(spark, sf):
    return reduced_table(spark, sg.twfe(sg.panel_cells(fx.staggered(spark, sf), SP), SP, vcov="CR2"))


def reduced_table(spark, fit):
    """Estimates with bias-reduced errors and their degrees of freedom."""
    dof = spark.createDataFrame([(t, float(d)) for t, d in zip(fit.terms, fit.df)], "term string, df double")
    return rg.tidy(fit).join(dof, "term").select("term", "estimate", "std_error", "df")


def _its_level(spark, sf, vcov):
    return _term_table(its_fit(its_cells(fx.its_panel(spark, sf), fx.ITS), fx.ITS, "year0", "level", vcov=vcov))


def _influence_sql(cl: str) -> str:
    """Influence sums by cluster for every (g, t), from unit-level rows."""
    return f"""{_ATT}, lng AS (
  SELECT a.unit, a.{cl} AS cl, a.cohort, gr.g, gr.t, gr.cut, a.y - o.y AS dy
  FROM grid gr JOIN fx1 a ON a.year = gr.t JOIN fx1 o ON o.year = gr.b AND o.unit = a.unit),
psi AS (
  SELECT l.cl, l.g, l.t, sum(CASE
      WHEN l.cohort = l.g THEN CAST(n_all AS DOUBLE) / n_treated * (dy - mt)
      WHEN l.cohort IS NULL OR (l.cohort > l.cut AND l.cohort <> l.g) THEN -(CAST(n_all AS DOUBLE) / n_control) * (dy - mc)
      ELSE 0 END) AS psi
  FROM lng l JOIN attgt ON attgt.g = l.g AND attgt.t = l.t GROUP BY 1, 2, 3),
nn AS (SELECT count(DISTINCT unit) AS n FROM fx1),
se AS (SELECT g, t, sqrt(sum(psi * psi)) / max(n) AS se FROM psi, nn GROUP BY 1, 2),
bt AS (SELECT rep, g, t, sum(CASE WHEN substr(md5(concat_ws('|', '3', (rep - 1) // 32, cl)), CAST((rep - 1) % 32 + 1 AS BIGINT), 1) < '8' THEN psi ELSE -psi END) / max(n) AS d
  FROM psi, nn, (SELECT unnest(range(1, 51)) AS rep) GROUP BY 1, 2, 3),
sb AS (SELECT g, t, stddev_samp(d) AS se_boot FROM bt GROUP BY 1, 2)
--result
SELECT 'ATT(' || a.g || ',' || a.t || ')' AS term, a.att AS estimate, se, se_boot
FROM attgt a JOIN se ON se.g = a.g AND se.t = a.t JOIN sb ON sb.g = a.g AND sb.t = a.t"""


@query("v5_bootstrap_cluster", _influence_sql("cluster"), "estimate se se_boot")
def v5(spark, sf):
    return sg.att_inference(fx.staggered(spark, sf), SP, "gt", boot=50, seed=3)


@query("v6_bootstrap_unit", _influence_sql("unit"), "estimate se se_boot")
def v6(spark, sf):
    return sg.att_inference(fx.staggered(spark, sf), SP, "gt", cluster="unit", boot=50, seed=3)


_AGG_INFLUENCE = _influence_sql("cluster").split(",\nse AS (")[0]


def _agg_sql(members: str, label: str, over: str = "") -> str:
    """Clustered errors of share-weighted averages, with the term for estimated shares; ``over`` says which
    of them make up the overall average."""
    overall = f"""
UNION ALL
SELECT 'overall', (SELECT avg(agg) FROM tot WHERE {over}), sqrt(sum(v * v)) / (SELECT max(n_all) FROM tot)
FROM (SELECT cl, avg(v) AS v FROM ai WHERE {over} GROUP BY cl)""" if over else ""
    return f"""{_AGG_INFLUENCE}, mem AS (SELECT {label} AS term, g, t, att, n_treated, n_all FROM attgt WHERE {members}),
tot AS (SELECT term, sum(n_treated) AS p, sum(n_treated * att) / sum(n_treated) AS agg, max(n_all) AS n_all FROM mem GROUP BY term),
cg AS (SELECT cluster AS cl, cohort, count(DISTINCT unit) AS n FROM fx1 GROUP BY 1, 2),
cn AS (SELECT cluster AS cl, count(DISTINCT unit) AS n FROM fx1 GROUP BY 1),
ai AS (SELECT mem.term, cn.cl, sum(n_treated / CAST(tot.p AS DOUBLE) * psi.psi
    + (att - agg) * tot.n_all / CAST(tot.p AS DOUBLE) * (coalesce(cg.n, 0) - cn.n * n_treated / CAST(tot.n_all AS DOUBLE))) AS v
  FROM mem JOIN tot ON tot.term = mem.term CROSS JOIN cn LEFT JOIN cg ON cg.cl = cn.cl AND cg.cohort = mem.g
    JOIN psi ON psi.cl = cn.cl AND psi.g = mem.g AND psi.t = mem.t GROUP BY 1, 2)
--result
SELECT ai.term, max(agg) AS estimate, sqrt(sum(v * v)) / max(n_all) AS se FROM ai JOIN tot ON tot.term = ai.term GROUP BY ai.term{overall}"""


@query("v5_agg_simple_se", _agg_sql("post = 1", "'simple'"), "estimate se")
def v5s(spark, sf):
    return sg.att_inference(fx.staggered(spark, sf), SP, "simple")


@query("v5_agg_calendar_se", _agg_sql("post = 1", "'time ' || t", "true"), "estimate se")
def v5c(spark, sf):
    return sg.att_inference(fx.staggered(spark, sf), SP, "calendar")


@query("v5_agg_dynamic_se", _agg_sql("true", "'event ' || event", "term NOT LIKE 'event -%'"), "estimate se")
def v5d(spark, sf):
    return sg.att_inference(fx.staggered(spark, sf), SP, "dynamic")


@query("v5_agg_group_se", f"""{_AGG_INFLUENCE}, mem AS (SELECT g, t, att, n_treated, n_all FROM attgt WHERE post = 1),
gr AS (SELECT g, avg(att) AS agg, max(n_treated) AS p, max(n_all) AS n_all FROM mem GROUP BY g),
ov AS (SELECT sum(p * agg) / sum(p) AS agg, CAST(sum(p) AS DOUBLE) AS p, max(n_all) AS n_all FROM gr),
gi AS (SELECT mem.g, psi.cl, avg(psi.psi) AS v FROM mem JOIN psi ON psi.g = mem.g AND psi.t = mem.t GROUP BY 1, 2),
cg AS (SELECT cluster AS cl, cohort, count(DISTINCT unit) AS n FROM fx1 GROUP BY 1, 2),
cn AS (SELECT cluster AS cl, count(DISTINCT unit) AS n FROM fx1 GROUP BY 1),
oi AS (SELECT gi.cl, sum(gr.p / ov.p * gi.v + (gr.agg - ov.agg) * ov.n_all / ov.p * (coalesce(cg.n, 0) - cn.n * gr.p / CAST(ov.n_all AS DOUBLE))) AS v
  FROM gi JOIN gr ON gr.g = gi.g JOIN cn ON cn.cl = gi.cl LEFT JOIN cg ON cg.cl = gi.cl AND cg.cohort = gi.g CROSS JOIN ov GROUP BY gi.cl)
--result
SELECT 'group ' || gi.g AS term, max(agg) AS estimate, sqrt(sum(v * v)) / max(n_all) AS se FROM gi JOIN gr ON gr.g = gi.g GROUP BY gi.g
UNION ALL SELECT 'overall', (SELECT agg FROM ov), sqrt(sum(v * v)) / (SELECT n_all FROM ov) FROM oi""", "estimate se")
def v5g(spark, sf):
    return sg.att_inference(fx.staggered(spark, sf), SP, "group")


_INTERVALS = _influence_sql("cluster").split(",\nbt AS (")[0] + """
--result
SELECT 'ATT(' || a.g || ',' || a.t || ')' AS term, a.att AS estimate, se AS std_error, a.att - 1.96 * se AS conf_low, a.att + 1.96 * se AS conf_high
FROM attgt a JOIN se ON se.g = a.g AND se.t = a.t"""


@query("v5_gt_intervals", _INTERVALS, "estimate std_error conf_low conf_high")
def v5i(spark, sf):
    return sg.att_intervals(sg.att_inference(fx.staggered(spark, sf), SP, "gt"))


# studentised maxima over all terms of a replicate; order statistics as in percentile_disc
def _band_sql(head: str, reps: int, alone: str = "false") -> str:
    """``head`` gives bt (rep, term, d) and es (term, estimate)."""
    at = lambda p: f"max(d) FILTER (WHERE rn = {math.ceil(p * reps - 1e-9)})"
    return f"""{head}, rk AS (SELECT term, d, row_number() OVER (PARTITION BY term ORDER BY d) AS rn FROM bt),
sp AS (SELECT term, CASE WHEN {alone} THEN term ELSE '' END AS fam, ({at(0.75)} - {at(0.25)}) / 1.3489795003921634 AS se_boot FROM rk GROUP BY term),
mx AS (SELECT fam, rep, max(abs(d / se_boot)) AS m FROM bt JOIN sp ON sp.term = bt.term WHERE se_boot > 0 GROUP BY 1, 2),
cr AS (SELECT fam, m AS crit FROM (SELECT fam, m, row_number() OVER (PARTITION BY fam ORDER BY m) AS rn FROM mx) WHERE rn = {math.ceil(0.95 * reps - 1e-9)})
--result
SELECT es.term, estimate, se_boot, crit, estimate - crit * se_boot AS conf_low, estimate + crit * se_boot AS conf_high
FROM es JOIN sp ON sp.term = es.term JOIN cr ON cr.fam = sp.fam"""


def _signed(reps: int, seed: int, cl: str) -> str:
    return (f"CASE WHEN substr(md5(concat_ws('|', '{seed}', (rep - 1) // 32, {cl})), CAST((rep - 1) % 32 + 1 AS BIGINT), 1) < '8' THEN 1 ELSE -1 END")


_REPS = 199
_GT_BANDS = _band_sql(f"""{_AGG_INFLUENCE},
bt AS (SELECT rep, 'ATT(' || g || ',' || t || ')' AS term, sum({_signed(_REPS, 7, "cl")} * psi) / max(n) AS d
  FROM psi, nn, (SELECT unnest(range(1, {_REPS + 1})) AS rep) GROUP BY 1, 2),
es AS (SELECT 'ATT(' || g || ',' || t || ')' AS term, att AS estimate FROM attgt)""", _REPS)


@query("v5_gt_bands", _GT_BANDS, "estimate se_boot crit conf_low conf_high")
def v5gb(spark, sf):
    return sg.att_bands(fx.staggered(spark, sf), SP, "gt", boot=_REPS, seed=7)


_DYNAMIC = _agg_sql("true", "'event ' || event", "term NOT LIKE 'event -%'").split("\n--result")[0]
_DYNAMIC_BANDS = _band_sql(f"""{_DYNAMIC},
al AS (SELECT term, cl, v FROM ai UNION ALL SELECT 'overall', cl, avg(v) FROM ai WHERE term NOT LIKE 'event -%' GROUP BY cl),
bt AS (SELECT rep, term, sum({_signed(_REPS, 7, "cl")} * v) / (SELECT max(n_all) FROM tot) AS d
  FROM al, (SELECT unnest(range(1, {_REPS + 1})) AS rep) GROUP BY 1, 2),
es AS (SELECT term, agg AS estimate FROM tot UNION ALL SELECT 'overall', avg(agg) FROM tot WHERE term NOT LIKE 'event -%')""",
                           _REPS, "term = 'overall'")


@query("v5_dynamic_bands", _DYNAMIC_BANDS, "estimate se_boot crit conf_low conf_high")
def v5db(spark, sf):
    return sg.att_bands(fx.staggered(spark, sf), SP, "dynamic", boot=_REPS, seed=7)


@query("v7_ci_normal", f"""{_D9}
--result
SELECT term, estimate, std_error, estimate - 1.96 * std_error AS conf_low, estimate + 1.96 * std_error AS conf_high
FROM ls_est WHERE term LIKE 'treat%'""", "estimate std_error conf_low conf_high")
def v7(spark, sf):
    return po.ci_normal(d9(spark, sf))


@query("v8_ci_t", f"""{_D9}
--result
SELECT term, estimate, estimate - 2.0638985616280205 * std_error AS conf_low, estimate + 2.0638985616280205 * std_error AS conf_high
FROM ls_est WHERE term LIKE 'treat%'""", "estimate conf_low conf_high")
def v8(spark, sf):
    return po.ci_t(d9(spark, sf), 24.0).select("term", "estimate", "conf_low", "conf_high")


@query("v9_se_from_ci", f"""{_D9}
--result
SELECT term, std_error, std_error AS std_error_back FROM ls_est WHERE term LIKE 'treat%'""", "std_error std_error_back")
def v9(spark, sf):
    return po.ci_normal(d9(spark, sf)).select("term", "std_error", po.se_from_ci("conf_low", "conf_high").alias("std_error_back"))


# normal tail by Simpson's rule on exp(-z^2/2) from z to z + 12
@query("v10_p_value", f"""{_PERM}, z AS (SELECT rep, abs(estimate / se) AS z FROM pr),
q AS (SELECT rep, sum((CASE WHEN i IN (0, 4800) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-(z + i * 0.0025) * (z + i * 0.0025) / 2)) * 0.0025 / 3 * 2 / sqrt(2 * pi()) AS p
  FROM z, (SELECT unnest(range(0, 4801)) AS i) GROUP BY rep)
--result
SELECT rep, p AS p_value, CASE WHEN p <= 0.05 THEN 1 ELSE 0 END AS sig FROM q""", "p_value")
def v10(spark, sf):
    draws = rs.permutation_draws(sg.panel_cells(fx.staggered(spark, sf), SP), SP, 200, 5)
    p = po.normal_p_value(F.col("estimate") / F.col("se"))
    return draws.select("rep", p.alias("p_value")).withColumn("sig", po.significant("p_value"))


# --------------------------------------------------------------------------- after the fit

def _slope_sql(key: str, label: str, where: str = "treat = 1") -> str:
    return f"""{_D9}, wt AS (SELECT {key} AS k, cohort, year, count(*) AS n FROM fx1 WHERE {where} GROUP BY 1, 2, 3),
cf AS (SELECT wt.k, e.i, wt.n / CAST(sum(wt.n) OVER (PARTITION BY wt.k) AS DOUBLE) AS w, b.b FROM wt
  JOIN (SELECT unnest(range(1, {len(CELLS) + 1})) AS i, unnest([{", ".join(f"'{n}'" for n in CELL_NAMES)}]) AS nm) e
    ON e.nm = 'treat:cohort::' || wt.cohort || ':year::' || wt.year JOIN ls_b b ON b.i = e.i),
sl AS (SELECT k, sum(w * b) AS estimate FROM cf GROUP BY k),
vv AS (SELECT a.k, sqrt(sum(a.w * v.v * c.w)) AS std_error FROM cf a JOIN cf c ON c.k = a.k JOIN ls_full v ON v.i = a.i AND v.j = c.i GROUP BY a.k)
--result
SELECT {label} AS term, estimate, std_error FROM sl JOIN vv ON vv.k = sl.k"""


def _d9_slopes(spark, sf, by):
    cells = sg.panel_cells(fx.staggered(spark, sf), SP)
    fit = sg.etwfe(cells, SP, "cluster")
    rows = cells.filter("treat = 1").withColumn("event", F.col("year") - F.col("cohort"))
    return po.slopes(fit, rows, "treat", by, "n").select("term", "estimate", "std_error")


@query("f1_slopes_simple", _slope_sql("1", "'treat'"), EST)
def f1(spark, sf):
    return _d9_slopes(spark, sf, [])


@query("f1_slopes_cohort", _slope_sql("cohort", "'treat cohort=' || sl.k"), EST)
def f1c(spark, sf):
    return _d9_slopes(spark, sf, ["cohort"])


@query("f1_slopes_calendar", _slope_sql("year", "'treat year=' || sl.k"), EST)
def f1t(spark, sf):
    return _d9_slopes(spark, sf, ["year"])


@query("f1_slopes_event", _slope_sql("year - cohort", "'treat event=' || sl.k"), EST)
def f1e(spark, sf):
    return _d9_slopes(spark, sf, ["event"])


_PRE_CELLS = "(SELECT unnest([2, 3, 4, 5]) AS i, unnest([1997, 1999, 1999, 1999]) AS g, unnest([1996, 1996, 1997, 1998]) AS t)"


@query("f1_slopes_pre", f"""{_PRE}, wt AS (SELECT year - cohort AS k, cohort, year, count(*) AS n FROM fx1
  WHERE treat = 0 AND year - cohort > -4 GROUP BY 1, 2, 3),
cf AS (SELECT wt.k, e.i, wt.n / CAST(sum(wt.n) OVER (PARTITION BY wt.k) AS DOUBLE) AS w FROM wt LEFT JOIN {_PRE_CELLS} e ON e.g = wt.cohort AND e.t = wt.year)
--result
SELECT 'evtreat event=' || a.k AS term, (SELECT sum(x.w * b.b) FROM cf x JOIN ls_b b ON b.i = x.i WHERE x.k = a.k) AS estimate,
  sqrt(sum(a.w * v.v * c.w)) AS std_error FROM cf a JOIN cf c ON c.k = a.k JOIN ls_full v ON v.i = a.i AND v.j = c.i GROUP BY a.k""", EST)
def f1p(spark, sf):
    cells = sg.panel_cells(fx.staggered(spark, sf), SP)
    rows = (cells.filter("treat = 0").withColumn("evtreat", F.col("cohort").isNotNull().cast("int"))
            .withColumn("event", F.col("year") - F.col("cohort")).filter("event > -4"))
    return po.slopes(sg.pretrend_cells(cells, SP), rows, "evtreat", ["event"], "n").select("term", "estimate", "std_error")


@query("f3_lincom_pretrend", f"""{_PRE}
--result
SELECT 'sum of pre-trends' AS term, (SELECT sum(b) FROM ls_b WHERE i BETWEEN 2 AND 5) AS estimate,
  (SELECT sqrt(sum(v)) FROM ls_full WHERE i BETWEEN 2 AND 5 AND j BETWEEN 2 AND 5) AS std_error""", EST)
def f3(spark, sf):
    fit = sg.pretrend_cells(sg.panel_cells(fx.staggered(spark, sf), SP), SP)
    parts = {t: 1.0 for t in fit.terms if t.startswith("evtreat")}
    return rg.lincom(fit, [("sum of pre-trends", parts)]).select("term", "estimate", "std_error")


_WALD_ELIM = """
w_m AS (SELECT i - 1 AS i, j - 1 AS j, v FROM ls_full WHERE i BETWEEN 2 AND 5 AND j BETWEEN 2 AND 5
  UNION ALL SELECT i - 1, 5, b FROM ls_b WHERE i BETWEEN 2 AND 5),
w_g(p, i, j, v) AS (SELECT 0, i, j, v FROM w_m UNION ALL
  SELECT r.p + 1, r.i, r.j, CASE WHEN r.i = r.p + 1 THEN r.v / pv.v ELSE r.v - c.v * w.v / pv.v END
  FROM w_g r JOIN w_g pv ON pv.i = r.p + 1 AND pv.j = r.p + 1 JOIN w_g c ON c.i = r.i AND c.j = r.p + 1
    JOIN w_g w ON w.i = r.p + 1 AND w.j = r.j WHERE r.p < 4)"""


@query("f4_wald_pretrend", f"""{_PRE}, {_WALD_ELIM.strip()}
--result
SELECT 4 AS n_restrictions, sum(b.b * w.v) AS chi2, sum(b.b * w.v) / 4 AS f FROM w_g w JOIN ls_b b ON b.i = w.i + 1 WHERE w.p = 4 AND w.j = 5""", "chi2 f")
def f4(spark, sf):
    fit = sg.pretrend_cells(sg.panel_cells(fx.staggered(spark, sf), SP), SP)
    return rg.wald(fit, [t for t in fit.terms if t.startswith("evtreat")]).select("n_restrictions", "chi2", "f")


# tail areas in closed form: chi-square with 4, F with 4 and an even number of degrees of freedom
@query("f4_wald_p_values", f"""{_PRE}, {_WALD_ELIM.strip()},
wt AS (SELECT sum(b.b * w.v) AS x FROM w_g w JOIN ls_b b ON b.i = w.i + 1 WHERE w.p = 4 AND w.j = 5),
fz AS (SELECT x, CAST(24 AS DOUBLE) / (24 + x) AS z FROM wt)
--result
SELECT exp(-x / 2) * (1 + x / 2) AS p_chi2, pow(z, 12) * (1 + 12 * (1 - z)) AS p_f FROM fz""", "p_chi2 p_f")
def f4p(spark, sf):
    fit = sg.pretrend_cells(sg.panel_cells(fx.staggered(spark, sf), SP), SP)
    return rg.wald(fit, [t for t in fit.terms if t.startswith("evtreat")]).select("p_chi2", "p_f")


# four restrictions: the F law's tail is a closed form for any second degrees of freedom
@query("f4_wald_cr2", f"""{with_list(FX1, _plain(_PRE_X, _PRE_N, "iid", where="treat = 0"), bias_reduced(), joint_reduced(2, 5), recursive=True)},
hf AS (SELECT chi2, eta - 3 AS df2, chi2 * (eta - 3) / (eta * 4) AS f FROM ht),
hz AS (SELECT *, df2 / (df2 + 4 * f) AS z FROM hf)
--result
SELECT CAST(4 AS INTEGER) AS n_restrictions, chi2, f, df2, exp(-chi2 / 2) * (1 + chi2 / 2) AS p_chi2,
  pow(z, df2 / 2) * (1 + df2 / 2 * (1 - z)) AS p_f FROM hz""", "chi2 f df2 p_chi2 p_f")
def f4c(spark, sf):
    fit = sg.pretrend_cells(sg.panel_cells(fx.staggered(spark, sf), SP), SP, vcov="CR2")
    return rg.wald(fit, [t for t in fit.terms if t.startswith("evtreat")])


_D10 = with_list(FX1, _plain([*CELL_SQL, *_cx, *_ty], [*CELL_NAMES, *_cn, *_tn], "CR1"), recursive=True)
_F6X = ["1", *CELL_SQL, *_cx, *_ty]


@query("f6_avg_predictions", f"""{_D10}, tr AS (SELECT *  FROM fx1 WHERE treat = 1),
md AS (SELECT unnest(range(1, {len(_F6X) + 1})) AS i, unnest([{", ".join(f"avg({x})" for x in _F6X)}]) AS hi FROM tr),
ml AS (SELECT i, hi, CASE WHEN i BETWEEN 2 AND {len(CELLS) + 1} THEN 0.0 ELSE hi END AS lo FROM md)
--result
SELECT 'treat=1' AS term, sum(hi * b) AS estimate, (SELECT sqrt(sum(a.hi * v.v * c.hi)) FROM ml a JOIN ls_full v ON v.i = a.i JOIN ml c ON c.i = v.j) AS std_error
FROM ml JOIN ls_b b ON b.i = ml.i
UNION ALL SELECT 'treat=0', sum(lo * b), (SELECT sqrt(sum(a.lo * v.v * c.lo)) FROM ml a JOIN ls_full v ON v.i = a.i JOIN ml c ON c.i = v.j)
FROM ml JOIN ls_b b ON b.i = ml.i""", EST)
def f6(spark, sf):
    cells = sg.panel_cells(fx.staggered(spark, sf), SP)
    return po.avg_predictions(sg.etwfe(cells, SP, "cohort"), cells.filter("treat = 1"), "treat", weight="n").select(
        "term", "estimate", "std_error")


@query("f7_event_predictions", f"""{_fs}
--result
SELECT 'pred event=' || event AS term, avg(y_it) AS estimate FROM imp WHERE treat = 1 GROUP BY event""", "estimate")
def f7(spark, sf):
    cells = im.net_cells(_imputed_cells(spark, sf)).filter("treat = 1")
    fit = rg.ols(cells, None, Design().factor("event", range(0, 5)), intercept=False, cells=True, vcov="HC1")
    return po.group_predictions(fit, cells, ["event"], "n").select("term", "estimate")
