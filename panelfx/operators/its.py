"""Interrupted time series: segmented lines for clusters that are all treated at some point."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import flag
from ..plans.stage import stage
from ..spec import PanelSpec
from .describe import collapse
from .design import Design
from .regress import INTERCEPT, Fit, contrast_table, ols


def its_cells(df: DataFrame, sp: PanelSpec) -> DataFrame:
    """(cluster, cohort, period) sums with the clocks of the segmented model, written once."""
    t, g = F.col(sp.time), F.col(sp.cohort)
    cells = stage(collapse(df, [sp.cluster, sp.cohort, sp.time], sp.y), "its")
    return cells.withColumns({
        "year0": t - F.lit(sp.times[0]), "yearc": t - g, "treat": flag(t >= g),
        "since": flag(t >= g) * (t - g)})


def its_lines(df: DataFrame, sp: PanelSpec) -> DataFrame:
    """Segmented model per cohort from two straight lines: the model has its own level and slope before
    and after, so one conditional aggregate gives it. ``slope`` is before the intervention, ``treat``
    the jump at it, ``since`` the change of slope."""
    t, y, g = F.col(sp.time) - F.lit(sp.times[0]), F.col(sp.y), F.col(sp.cohort) - F.lit(sp.times[0])
    pre, post = t < g, t >= g

    def on(cond, fn, arg_y, arg_x):
        return fn(F.when(cond, arg_y), F.when(cond, arg_x))

    fits = df.groupBy(sp.cohort).agg(
        on(pre, F.regr_slope, y, t).alias("b0"), on(pre, F.regr_intercept, y, t).alias("a0"),
        on(post, F.regr_slope, y, t).alias("b1"), on(post, F.regr_intercept, y, t).alias("a1"),
        F.count(y).alias("n"))
    return fits.select(
        sp.cohort, F.col("a0").alias("intercept"), F.col("b0").alias("slope"),
        (F.col("a1") + F.col("b1") * g - F.col("a0") - F.col("b0") * g).alias("treat"),
        (F.col("b1") - F.col("b0")).alias("since"), "n")


def its_line_effects(df: DataFrame, sp: PanelSpec, at: int) -> DataFrame:
    """Untreated and treated prediction at one period and their difference, per cohort."""
    x = F.lit(at - sp.times[0])
    g = F.col(sp.cohort) - F.lit(sp.times[0])
    return its_lines(df, sp).select(
        sp.cohort, (F.col("intercept") + F.col("slope") * x).alias("untreated"),
        (F.col("intercept") + F.col("slope") * x + F.col("treat") + F.col("since") * (x - g)).alias("treated"),
        (F.col("treat") + F.col("since") * (x - g)).alias("effect"), "n")


def its_weighted_effect(effects: DataFrame, weights: DataFrame | None = None, key: str = "cohort") -> DataFrame:
    """Average effect over cohorts, by the row counts or by given weights (key, weight)."""
    if weights is None:
        e = effects.withColumn("weight", F.col("n").cast("double"))
    else:
        e = effects.join(weights, key)
    return e.agg((F.sum(F.col("weight") * F.col("effect")) / F.sum("weight")).alias("effect"))


def its_design(sp: PanelSpec, clock: str = "year0", cohort: str = "none", slope: bool = True) -> Design:
    core = Design().main(clock, "treat")
    if slope:
        core.main("since")
    if cohort == "none":
        return core
    level = Design().factor(sp.cohort, sp.cohorts, ref=sp.cohorts[0])
    if cohort == "level":
        return Design(core.terms + level.terms, core.nullable)
    return Design().crossed(level, core)


def its_fit(cells: DataFrame, sp: PanelSpec, clock: str = "year0", cohort: str = "none",
            slope: bool = True, vcov: str = "CR2") -> Fit:
    """Segmented regression. ``clock`` is year0 (calendar) or yearc (event); ``cohort`` is none, level
    (own intercept) or full (everything interacted)."""
    return ols(cells, None, its_design(sp, clock, cohort, slope), cells=True, cluster=sp.cluster, vcov=vcov)


def its_fit_one(cells: DataFrame, sp: PanelSpec, g: int, clock: str = "year0", vcov: str = "CR2") -> Fit:
    return its_fit(cells.filter(F.col(sp.cohort) == F.lit(g)), sp, clock, "none", True, vcov)


def trend_fit(cells: DataFrame, sp: PanelSpec, cohort: str = "none", vcov: str = "CR1") -> Fit:
    """Plain time trend, with a cohort level or a cohort slope."""
    trend = Design().main("year0")
    level = Design().factor(sp.cohort, sp.cohorts, ref=sp.cohorts[0])
    d = {"none": trend, "level": Design(trend.terms + level.terms, trend.nullable),
         "full": Design().crossed(trend, level)}[cohort]
    return ols(cells, None, d, cells=True, cluster=sp.cluster, vcov=vcov)


def _value(term: str, sp: PanelSpec, g: int, values: Mapping[str, float]) -> float:
    """Value of a model term for a cohort: cohort indicator times regressor, either may be absent."""
    indicator, head = 1.0, f"{sp.cohort}::"
    if term.startswith(head):
        level, _, term = term[len(head):].partition(":")
        indicator = float(level == str(g))
    if term in ("", INTERCEPT):
        return indicator
    return indicator * float(values.get(term, 0.0))


def _row(fit: Fit, sp: PanelSpec, g: int, values: Mapping[str, float]) -> np.ndarray:
    return np.array([_value(t, sp, g, values) for t in fit.terms])


def its_effect(fit: Fit, sp: PanelSpec, at: int, weights: Mapping[int, float] | None = None) -> DataFrame:
    """Untreated and treated prediction and their difference at the end of follow-up per cohort and, with
    ``weights``, averaged."""
    labels, rows = [], []
    acc = {k: np.zeros(len(fit.terms)) for k in ("untreated", "treated", "effect")}
    for g in sp.cohorts:
        x0 = float(at - sp.times[0])
        base = {"year0": x0, "yearc": float(at - g)}
        lo = _row(fit, sp, g, base)
        hi = _row(fit, sp, g, {**base, "treat": 1.0, "since": float(at - g)})
        for name, r in (("untreated", lo), ("treated", hi), ("effect", hi - lo)):
            labels.append(f"{name} {g}")
            rows.append(r)
            if weights:
                acc[name] = acc[name] + weights[g] * r
    if weights:
        for name, r in acc.items():
            labels.append(f"{name} all")
            rows.append(r)
    return contrast_table(fit, labels, np.array(rows))


def its_slopes(fit: Fit, sp: PanelSpec) -> DataFrame:
    """Level shift and post-intervention slope change per cohort."""
    labels, rows = [], []
    for name in ("treat", "since"):
        for g in sp.cohorts:
            labels.append(f"{name} {g}")
            rows.append(_row(fit, sp, g, {name: 1.0}) - _row(fit, sp, g, {}))
    return contrast_table(fit, labels, np.array(rows))


def cohort_shares(df: DataFrame, sp: PanelSpec, of: str | None = None) -> dict[int, float]:
    """Share of clusters (or of another id) per cohort; cohorts are few."""
    ids = df.select(of or sp.cluster, sp.cohort).distinct().groupBy(sp.cohort).count().collect()
    total = sum(r["count"] for r in ids)
    return {r[0]: r["count"] / total for r in ids}
