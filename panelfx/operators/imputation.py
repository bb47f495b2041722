"""Imputation: fit the untreated outcome on untreated rows, then average what the treated rows exceed it by."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import flag
from ..plans.stage import stage
from ..spec import PanelSpec
from . import mixed
from .absorb import center_by_window, lookup
from .describe import collapse
from .design import Design
from .gram import gram


@dataclass
class FirstStage:
    """Period effects (NULL where no untreated row identifies them) and a table of group effects."""

    sp: PanelSpec
    group: str
    periods: list[int]
    lam: np.ndarray
    bread: np.ndarray
    sigma2: float
    effects: DataFrame


def first_stage(df: DataFrame, sp: PanelSpec, group: str | None = None, cells: bool = False) -> FirstStage:
    """Two-way effects of the untreated rows. ``group`` is the cluster (default), the cohort or the unit.

    Rows (or with ``cells`` the sums made by ``collapse``) are reduced to (group, period) cells. The group effects are centered out, so the only system to
    solve has one unknown per period; the group effects are an aggregate and stay in Spark.
    """
    group = group or sp.cluster
    free = df.filter(F.coalesce(F.col(sp.time) < F.col(sp.cohort), F.lit(True)))
    if cells:
        sums = free.groupBy(group, sp.time).agg(*[F.sum(c).alias(c) for c in ("n", "y_sum", "y_sumsq")])
    else:
        sums = collapse(free, [group, sp.time], sp.y)
    cells = stage(sums, "untreated").withColumns({
        "_y": F.col("y_sum") / F.col("n"), "_w": F.col("n").cast("double")})
    seen = {r[0] for r in cells.select(sp.time).distinct().collect()}
    periods = [t for t in sp.times if t in seen]
    names = [f"_d{i}" for i in range(1, len(periods))]
    wide = cells.select(group, "_y", "_w", *[flag(F.col(sp.time) == F.lit(t)).cast("double").alias(n)
                                             for t, n in zip(periods[1:], names)])
    m = gram(center_by_window(wide, ["_y", *names], group, "_w"), [*names, "_y"], "_w")
    k = len(names)
    bread = np.linalg.pinv(m[:k, :k], hermitian=True) if k else np.zeros((0, 0))
    lam = np.concatenate([[0.0], bread @ m[:k, k]])
    share = [F.sum(F.col("_w") * flag(F.col(sp.time) == F.lit(t))) / F.sum("_w") for t in periods[1:]]
    rest = F.col("_y") - lookup(sp.time, periods, lam)
    effects = cells.groupBy(group).agg(
        (F.sum(F.col("_w") * rest) / F.sum("_w")).alias("_alpha"), F.sum("_w").alias("_n0"),
        F.array(*share).alias("_share") if share else F.array().cast("array<double>").alias("_share"))
    effects = stage(effects, "effects")
    ss = cells.agg(F.sum("y_sumsq").alias("a"), F.sum(F.col("_w") * F.col("_y") * F.col("_y")).alias("b"),
                   F.sum("n").alias("n")).first()
    within = m[k, k] - (bread @ m[:k, k]) @ m[:k, k]
    rank = effects.count() + (np.linalg.matrix_rank(m[:k, :k], hermitian=True) if k else 0)
    sigma2 = float((ss["a"] - ss["b"]) + within) / (ss["n"] - rank)
    return FirstStage(sp, group, periods, lam, bread, sigma2, effects)


def add_predictions(df: DataFrame, fs: FirstStage) -> DataFrame:
    """Untreated prediction of every row with its classical variance; NULL where the group or the period
    has no untreated row."""
    sp = fs.sp
    eff = fs.effects.withColumnRenamed(fs.group, "_g")
    out = df.join(eff, F.col(fs.group).eqNullSafe(F.col("_g")), "left")
    pred = F.col("_alpha") + lookup(sp.time, fs.periods, fs.lam)
    k = len(fs.periods) - 1
    if k:
        # variance of alpha + lambda_t: 1/n0 plus a quadratic form in (period indicator - period shares)
        dev = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: flag(
            F.col(sp.time) == F.element_at(F.array(*[F.lit(t) for t in fs.periods[1:]]), i)).cast("double")
            - F.element_at("_share", i))
        rows = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in fs.bread])
        mv = F.transform(rows, lambda r: F.aggregate(F.zip_with(r, F.col("_dev"), lambda a, b: a * b), F.lit(0.0),
                                                     lambda acc, x: acc + x))
        quad = F.aggregate(F.zip_with(mv, F.col("_dev"), lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    else:
        # one period: the prediction is the group's mean
        dev, quad = F.array().cast("array<double>"), F.lit(0.0)
    out = out.withColumn("pred", pred).withColumn("_dev", dev)
    return (out.withColumn("pred_var", F.when(F.col("pred").isNotNull(),
                                              F.lit(fs.sigma2) * (F.lit(1.0) / F.col("_n0") + quad)))
            .drop("_g", "_alpha", "_n0", "_share", "_dev"))


def impute_y0(df: DataFrame, sp: PanelSpec, group: str | None = None) -> DataFrame:
    """All rows with ``pred`` and ``y_it`` = outcome minus untreated prediction."""
    return add_predictions(df, first_stage(df, sp, group)).withColumns({
        "y_it": F.col(sp.y) - F.col("pred"),
        "treat": flag(F.col(sp.time) >= F.col(sp.cohort)),
        "event": F.col(sp.time) - F.col(sp.cohort)})


def impute_cells(cells: DataFrame, sp: PanelSpec, group: str | None = None) -> DataFrame:
    """The same on (cluster, cohort, period) sums: the prediction is constant in a cell, so all averages
    of ``y_it`` follow without another pass over the rows."""
    return add_predictions(cells, first_stage(cells, sp, group, cells=True)).withColumns({
        "treat": flag(F.col(sp.time) >= F.col(sp.cohort)),
        "event": F.col(sp.time) - F.col(sp.cohort)})


def net_cells(imputed: DataFrame) -> DataFrame:
    """Sums of ``y_it`` and of its square per row of an imputed table, whether its rows are cells or not."""
    if "y_sumsq" not in imputed.columns:
        y = F.col("y_it")
        return imputed.withColumns({"n": F.lit(1), "y_sum": y, "y_sumsq": y * y})
    s, q, n, p = (F.col(c) for c in ("y_sum", "y_sumsq", "n", "pred"))
    return imputed.withColumns({"y_sum": s - n * p, "y_sumsq": q - 2 * p * s + n * p * p})


def treat_averages(imputed: DataFrame) -> DataFrame:
    return net_cells(imputed).filter(F.col("y_sum").isNotNull()).groupBy("treat").agg(
        (F.sum("y_sum") / F.sum("n")).alias("mean_y_it"), F.sum("n").cast("long").alias("n"))


def imputation_att(imputed: DataFrame, by: str | None = None, weight: Column | None = None) -> DataFrame:
    """Average of ``y_it`` over treated rows, overall or by a column.

    ``se_second_stage`` is the heteroskedasticity-robust error of the second regression alone; it does
    not carry the uncertainty of the first stage. ``weight`` weights the rows, for example by
    1 / pred_var; for cells it must be constant in a cell.
    """
    rows = net_cells(imputed).filter((F.col("treat") == 1) & F.col("y_sum").isNotNull())
    w = F.lit(1.0) if weight is None else weight
    key = F.col(by) if by else F.lit("all")
    w2 = F.col("w") * F.col("w")
    sums = rows.select(key.alias("key"), w.alias("w"), "n", "y_sum", "y_sumsq").groupBy("key").agg(
        F.sum("n").cast("long").alias("n"), F.sum(F.col("w") * F.col("n")).alias("sw"),
        F.sum(F.col("w") * F.col("y_sum")).alias("swy"), F.sum(w2 * F.col("n")).alias("sww"),
        F.sum(w2 * F.col("y_sum")).alias("swwy"), F.sum(w2 * F.col("y_sumsq")).alias("swwyy"))
    size = sums.agg(F.struct(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).alias("s")).scalar()
    b = F.col("swy") / F.col("sw")
    rss = F.col("swwyy") - 2 * b * F.col("swwy") + b * b * F.col("sww")
    adj = size["n"] / (size["n"] - size["k"])
    return sums.select("key", b.alias("estimate"),
                       (F.sqrt(F.greatest(rss, F.lit(0.0)) * adj) / F.col("sw")).alias("se_second_stage"), "n")


def measured_error(imputed: DataFrame, sp: PanelSpec, by_cohort: bool = False) -> mixed.Reduced:
    """Second stage that carries the first one's error: ``y_it`` of all rows on the treatment (or on the treatment of each
    cohort), with an intercept per cluster, and the prediction's variance as known part of each row's error variance.

    Rows without a prediction are left out. The result is what ``mixed`` fits: restricted likelihood or posterior.
    """
    rows = net_cells(imputed).filter(F.col("y_sum").isNotNull() & F.col("pred_var").isNotNull())
    own = Design().main("treat")
    design = Design().interact(own, Design().factor(sp.cohort, sp.cohorts)) if by_cohort else own
    return mixed.reduce_rows(rows, sp.cluster, design, intercept=False, error="pred_var")
