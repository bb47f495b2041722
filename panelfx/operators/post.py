"""What is made from a fit: marginal effects, predictions, intervals, rejection flags."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tails import t_quantile
from .panel import skeleton
from .regress import Fit, contrast_table


def _means(fit: Fit, df: DataFrame, by: Sequence[str], variable: str, values: Sequence[float],
           weight: str | None) -> list[tuple[tuple, list[np.ndarray]]]:
    """Average regressors per group with ``variable`` set to each value; one row per group comes back."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    work = df.withColumn("_wt", w)
    cols = []
    for i, v in enumerate(values):
        work = work.withColumn("_keep", F.col(variable)).withColumn(variable, F.lit(v))
        names = [f"_v{i}_{j}" for j in range(len(fit.design.terms))]
        work = work.withColumns({n: c for n, (_, c) in zip(names, fit.design.terms)})
        work = work.withColumn(variable, F.col("_keep")).drop("_keep")
        cols.append(names)
    rows = work.groupBy(*by).agg(*[(F.sum(F.col("_wt") * F.col(n)) / F.sum("_wt")).alias(n)
                                   for names in cols for n in names]).collect()
    out = []
    for r in rows:
        out.append((tuple(r[b] for b in by), [np.array([float(r[n]) for n in names]) for names in cols]))
    return sorted(out, key=lambda o: tuple((x is None, x) for x in o[0]))


def _label(prefix: str, by: Sequence[str], key: tuple) -> str:
    return prefix if not by else f"{prefix} " + ",".join(f"{b}={k}" for b, k in zip(by, key))


def slopes(fit: Fit, df: DataFrame, variable: str = "treat", by: Sequence[str] = (),
           weight: str | None = None) -> DataFrame:
    """Average effect of moving ``variable`` from 0 to 1 over the rows of ``df``, per group.

    The rows are reduced in Spark to one average regressor vector per group; the estimate and its error
    are then products with the coefficients and their covariance.
    """
    got = _means(fit, df, by, variable, [0, 1], weight)
    return contrast_table(fit, [_label(variable, by, k) for k, _ in got],
                          np.array([hi - lo for _, (lo, hi) in got]))


def avg_slopes(fit: Fit, df: DataFrame, variables: Sequence[str], by: Sequence[str] = (),
               weight: str | None = None) -> DataFrame:
    labels, rows = [], []
    for v in variables:
        for k, (lo, hi) in _means(fit, df, by, v, [0, 1], weight):
            labels.append(_label(v, by, k))
            rows.append(hi - lo)
    return contrast_table(fit, labels, np.array(rows))


def avg_predictions(fit: Fit, df: DataFrame, variable: str, values: Sequence[float] = (0, 1),
                    by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Average prediction with ``variable`` set to each value, on the same rows."""
    labels, rows = [], []
    for k, vectors in _means(fit, df, by, variable, values, weight):
        for v, x in zip(values, vectors):
            labels.append(_label(f"{variable}={v}", by, k))
            rows.append(x)
    return contrast_table(fit, labels, np.array(rows))


def group_predictions(fit: Fit, df: DataFrame, by: Sequence[str], weight: str | None = None) -> DataFrame:
    """Average prediction per group."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    k = len(fit.design.terms)
    rows = (df.select(*by, w.alias("_wt"), *[c.alias(f"_x{j}") for j, (_, c) in enumerate(fit.design.terms)])
            .groupBy(*by).agg(*[(F.sum(F.col("_wt") * F.col(f"_x{j}")) / F.sum("_wt")).alias(f"_x{j}")
                                for j in range(k)]).orderBy(*by).collect())
    return contrast_table(fit, [_label("pred", by, tuple(r[b] for b in by)) for r in rows],
                          np.array([[float(r[f"_x{j}"]) for j in range(k)] for r in rows]))


def value_grid(spark: SparkSession, **axes: Sequence) -> DataFrame:
    """All combinations of the given regressor values."""
    return skeleton(spark.range(1).select(), **axes)


def ci_normal(df: DataFrame, estimate: str = "estimate", se: str = "std_error", z: float = 1.96) -> DataFrame:
    return df.withColumns({"conf_low": F.col(estimate) - F.lit(z) * F.col(se),
                           "conf_high": F.col(estimate) + F.lit(z) * F.col(se)})


def ci_t(df: DataFrame, dof: float, estimate: str = "estimate", se: str = "std_error",
         level: float = 0.95) -> DataFrame:
    return ci_normal(df, estimate, se, t_quantile(0.5 + level / 2, dof))


def se_from_ci(low: str | Column, high: str | Column, z: float = 1.96) -> Column:
    lo = F.col(low) if isinstance(low, str) else low
    hi = F.col(high) if isinstance(high, str) else high
    return (hi - lo) / F.lit(2.0 * z)


def normal_p_value(z: Column) -> Column:
    """Two-sided p-value of the normal law as a column: 1 - erf(|z| / sqrt 2), by the series near zero and
    the continued fraction in the tail."""
    x = F.abs(z) / F.lit(2.0 ** 0.5)
    x2 = x * x
    series = F.lit(0.0)
    for n in range(40, 0, -1):
        series = F.lit(2.0) * x2 / F.lit(2.0 * n + 1.0) * (F.lit(1.0) + series)
    near = F.lit(1.0) - F.lit(2.0 / np.pi ** 0.5) * x * F.exp(-x2) * (F.lit(1.0) + series)
    frac = F.lit(0.0)
    for n in range(60, 0, -1):
        frac = F.lit(n / 2.0) / (x + frac)
    far = F.exp(-x2) / (F.lit(np.pi ** 0.5) * (x + frac))
    return F.when(x < F.lit(2.0), near).otherwise(far)


def significant(p: str | Column, level: float = 0.05) -> Column:
    c = F.col(p) if isinstance(p, str) else p
    return (c <= F.lit(level)).cast("int")


def rejection_share(df: DataFrame, sig: str = "sig", estimate: str = "estimate") -> DataFrame:
    return df.agg(F.avg(F.col(sig).cast("double")).alias("rejection_share"), F.count(sig).alias("n_reps"),
                  F.avg(estimate).alias("mean_estimate"), F.stddev_samp(estimate).alias("sd_estimate"))
