"""Closed-form posteriors from sums, a random-intercept model, and summaries of posterior draws."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stage import stage
from . import mixed
from .describe import group_quantiles
from .design import Design
from .gram import gram, independent
from .panel import to_long
from .regress import INTERCEPT, normal_table


def _system(cells: DataFrame, design: Design):
    full = Design([(INTERCEPT, F.lit(1.0)), *design.terms], set(design.nullable))
    keep = [(F.col("y_sum") / F.col("n")).alias("_y"), F.col("n").cast("double").alias("_w"),
            (F.col("y_sumsq") - F.col("y_sum") * F.col("y_sum") / F.col("n")).alias("_ss")]
    base, xs = full.attach(cells.filter(F.col("n") > 0), keep)
    return full, base, xs


def _prior(names: Sequence[str], sd: float, intercept_sd: float) -> np.ndarray:
    return np.diag([1.0 / (intercept_sd if n == INTERCEPT else sd) ** 2 for n in names])


def ridge_posterior(cells: DataFrame, design: Design, prior_sd: float, intercept_sd: float | None = None) -> DataFrame:
    """Posterior of a linear model with independent normal priors centered at zero, the error variance
    set to its least-squares value. The data enter through one cross-product matrix."""
    full, base, xs = _system(cells, design)
    m = gram(base, [*xs, "_y"], "_w")
    k = len(xs)
    kept = independent(m[:k, :k])
    names = [full.names[i] for i in kept]
    xx, xy = m[np.ix_(kept, kept)], m[kept, k]
    n, ss = base.agg(F.sum("_w"), F.sum("_ss")).first()
    sigma2 = (m[k, k] - xy @ np.linalg.solve(xx, xy) + ss) / (n - len(kept))
    cov = np.linalg.inv(xx / sigma2 + _prior(names, prior_sd, intercept_sd or prior_sd))
    mean = cov @ (xy / sigma2)
    return normal_table(cells.sparkSession, [
        (t, float(b), float(np.sqrt(v))) for t, b, v in zip(names, mean, np.diag(cov))])


def random_intercept(cells: DataFrame, cluster: str, design: Design, prior_sd: float = 100.0,
                     intercept_sd: float | None = None) -> DataFrame:
    """Linear model with a normal intercept per cluster: restricted maximum likelihood for the two variances,
    then the normal posterior of the coefficients given them. The standard deviations have no standard error."""
    r = mixed.reduce_rows(cells, cluster, design)
    sigma, tau, _, _ = mixed.fit_restricted(r)
    precision = np.diag(_prior(r.names, prior_sd, intercept_sd or prior_sd))
    _, mean, cov = mixed.conditional(r, [(sigma, tau)], precision)
    rows = [(t, float(b), float(np.sqrt(v))) for t, b, v in zip(r.names, mean[0], np.diag(cov[0]))]
    return normal_table(cells.sparkSession, [*rows, ("sd_cluster", tau, None), ("sigma", sigma, None)])


def random_intercept_posterior(cells: DataFrame, cluster: str, design: Design, priors: mixed.Priors = mixed.Priors()) -> DataFrame:
    """The same model with priors on both deviations: the coefficients' posterior is a mixture over a grid of the two,
    placed where the posterior has its mass."""
    return mixed.posterior(mixed.reduce_rows(cells, cluster, design), priors).table(cells.sparkSession)


def summarise_draws(df: DataFrame, columns: Sequence[str], pattern: str = r"(\d+)\D+(\d+)") -> DataFrame:
    """Median, scaled median absolute deviation and central 95% interval of each parameter of a table of
    draws; cohort and period are read from the parameter name."""
    long = stage(to_long(df, [], columns, "param", "value").filter(F.col("value").isNotNull()), "draws")
    q = group_quantiles(long, ["param"], "value", [0.025, 0.5, 0.975])
    wide = stage(q.groupBy("param").agg(
        F.max(F.when(F.col("q") == 0.5, F.col("value"))).alias("median"),
        F.max(F.when(F.col("q") == 0.025, F.col("value"))).alias("low"),
        F.max(F.when(F.col("q") == 0.975, F.col("value"))).alias("high")), "centers")
    dev = long.join(wide.select("param", "median"), "param").select(
        "param", F.abs(F.col("value") - F.col("median")).alias("dev"))
    mad = group_quantiles(dev, ["param"], "dev", [0.5]).select(
        "param", (F.col("value") * F.lit(1.4826)).alias("mad"))
    return wide.join(mad, "param").select(
        F.regexp_extract("param", pattern, 1).cast("int").alias("cohort"),
        F.regexp_extract("param", pattern, 2).cast("int").alias("year"),
        "param", "median", "mad", "low", "high")
