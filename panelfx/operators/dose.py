"""Continuous doses: two-period slopes, weights of the slope, and the quasi-stayer slope."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import DoseFn, flag
from ..plans.stage import stage
from ..spec import PanelSpec
from .absorb import absorb_exact
from .describe import group_quantiles
from .design import Design
from .panel import first_diff, two_period_delta
from .regress import Fit, ols

# --------------------------------------------------------------------------- two periods


def dose_twfe(df: DataFrame, sp: PanelSpec) -> DataFrame:
    """Cov(D, dY) / Var(D); one row."""
    wide = two_period_delta(df, sp.unit, sp.time, sp.y, [sp.dose])
    return wide.agg(F.regr_slope("delta_y", sp.dose).alias("estimate"), F.count("delta_y").alias("n"))


def dose_line(df: DataFrame, sp: PanelSpec) -> DataFrame:
    wide = two_period_delta(df, sp.unit, sp.time, sp.y, [sp.dose])
    return wide.agg(F.regr_intercept("delta_y", sp.dose).alias("intercept"),
                    F.regr_slope("delta_y", sp.dose).alias("slope"))


def mean_true_effect(df: DataFrame, dose: str, fn: DoseFn) -> DataFrame:
    return df.agg(F.avg(fn(F.col(dose))).alias("att"))


def twfe_weights(df: DataFrame, dose: str) -> DataFrame:
    """Each unit's weight in the slope, up to scale, and its sign."""
    mean = df.agg(F.avg(dose).alias("m")).scalar()
    return df.withColumn("weight", F.col(dose) - mean).withColumn(
        "sign", F.when(F.col("weight") < 0, F.lit("negative")).otherwise(F.lit("positive")))


def weight_anatomy(df: DataFrame, dose: str, fn: DoseFn) -> DataFrame:
    """Correlation of weight and effect, share of units with negative weight, and the share of the total
    absolute weight that is negative."""
    w = twfe_weights(df, dose).withColumn("att", fn(F.col(dose)))
    neg = F.col("weight") < 0
    return w.agg(
        F.corr("weight", "att").alias("corr"),
        F.avg(neg.cast("double")).alias("negative_share"),
        (F.sum(F.when(neg, -F.col("weight")).otherwise(0.0)) / F.sum(F.abs("weight"))).alias("negative_weight"))


def acrt_at_median(df: DataFrame, dose: str, derivative: DoseFn) -> DataFrame:
    """Marginal response at the median dose."""
    return group_quantiles(df, [], dose, [0.5]).select(
        F.col("value").alias("median"), derivative(F.col("value")).alias("acrt"))


def estimand_ratio(df: DataFrame, sp: PanelSpec, fn: DoseFn) -> DataFrame:
    """Average effect over slope: by what factor the slope understates the effect."""
    wide = two_period_delta(df, sp.unit, sp.time, sp.y, [sp.dose])
    return (wide.agg(F.regr_slope("delta_y", sp.dose).alias("twfe"), F.avg(fn(F.col(sp.dose))).alias("att"))
            .withColumn("ratio", F.col("att") / F.col("twfe")))


# --------------------------------------------------------------------------- dose that is always on


def always_on_twfe(df: DataFrame, sp: PanelSpec, controls: Sequence[str] = ()) -> DataFrame:
    """Slope of the outcome on the dose with unit and period effects, and with at most one control.
    The panel is written once, since centering reads it several times. The normal equations after centering are solved as
    column expressions."""
    cols = [sp.y, sp.dose, *controls]
    rows = stage(df.select(sp.unit, sp.time, *cols), "panel")
    sp = sp.with_levels(rows)
    r = absorb_exact(rows, cols, sp.unit, sp.time, sp.times)

    def s(a: str, b: str) -> Column:
        return F.sum(F.col(a) * F.col(b))

    d, y = sp.dose, sp.y
    if not controls:
        return r.agg((s(d, y) / s(d, d)).alias("estimate"))
    if len(controls) > 1:
        raise ValueError("use always_on_fit for more than one control")
    c = controls[0]
    det = s(d, d) * s(c, c) - s(d, c) * s(d, c)
    return r.agg(((s(c, c) * s(d, y) - s(d, c) * s(c, y)) / det).alias("estimate"),
                 ((s(d, d) * s(c, y) - s(d, c) * s(d, y)) / det).alias("control"))


def always_on_fit(df: DataFrame, sp: PanelSpec, controls: Sequence[str] = (), vcov: str = "CR1") -> Fit:
    """The same with standard errors and any number of controls."""
    d = Design().main(sp.dose, *controls).factor(sp.time, sp.times, ref=sp.times[0])
    cluster = sp.cluster or sp.unit
    rows = stage(df.select(*dict.fromkeys([sp.unit, sp.time, sp.y, sp.dose, *controls, cluster])), "panel")
    return ols(rows, sp.y, d, absorb=sp.unit, cluster=cluster, vcov=vcov)


# --------------------------------------------------------------------------- quasi-stayers


def differences(df: DataFrame, sp: PanelSpec, extra: dict[str, str] | None = None) -> DataFrame:
    """Changes of dose and outcome between adjacent periods and the lagged dose, written once."""
    out = first_diff(df, sp.unit, sp.time, {sp.dose: "d_dose", sp.y: "d_y", **(extra or {})},
                     {sp.dose: "dose_lag"})
    return stage(out, "diffs")


def thresholds(diffs: DataFrame, time: str, qs: Sequence[float]) -> DataFrame:
    """Per period and q, the size of change at or under which a unit counts as a stayer."""
    return stage(group_quantiles(diffs, [time], F.abs(F.col("d_dose")), qs).withColumnRenamed("value", "eps"), "eps")


def quasi_stayers(diffs: DataFrame, time: str, q: float) -> DataFrame:
    eps = thresholds(diffs, time, [q]).select(time, "eps")
    return diffs.join(eps, time).withColumn("is_qs", F.abs("d_dose") <= F.col("eps"))


def stayer_counterfactual(diffs: DataFrame, time: str, q: float) -> DataFrame:
    """Switchers with the change they would have had on the stayers' line, and the excess ``ce``."""
    marked = quasi_stayers(diffs, time, q)
    x, y = F.col("dose_lag"), F.col("d_y")
    line = stage(marked.filter("is_qs").groupBy(time).agg(
        F.regr_intercept(y, x).alias("cf_intercept"), F.regr_slope(y, x).alias("cf_slope")), "line")
    return (marked.filter(~F.col("is_qs")).join(line, time)
            .withColumn("cf", F.col("cf_intercept") + F.col("cf_slope") * x)
            .withColumn("ce", y - F.col("cf")))


def aoss_by_period(diffs: DataFrame, time: str, qs: Sequence[float], min_n: int = 10,
                   y: str = "d_y") -> DataFrame:
    """Quasi-stayer slope of every period and q.

    The excess of a switcher over the stayers' line is linear in the line's two numbers, so the slope
    needs only sums: line and switchers come out of the same aggregate and no row is joined to a line.
    """
    marked = diffs.join(thresholds(diffs, time, qs), time).select(
        time, "q", "d_dose", F.col(y).alias("_y"), F.col("dose_lag").alias("_x"),
        (F.abs("d_dose") <= F.col("eps")).alias("_qs"))
    if y != "d_y":
        marked = marked.filter(F.col("_y").isNotNull())
    qs_, sw, d = F.col("_qs"), ~F.col("_qs"), F.col("d_dose")
    sums = marked.groupBy(time, "q").agg(
        F.sum(qs_.cast("int")).alias("n_qs"), F.sum(sw.cast("int")).alias("n_sw"),
        F.regr_intercept(F.when(qs_, F.col("_y")), F.when(qs_, F.col("_x"))).alias("a"),
        F.regr_slope(F.when(qs_, F.col("_y")), F.when(qs_, F.col("_x"))).alias("b"),
        F.sum(F.when(sw, F.col("_y") * d)).alias("yd"), F.sum(F.when(sw, d)).alias("d1"),
        F.sum(F.when(sw, F.col("_x") * d)).alias("xd"), F.sum(F.when(sw, d * d)).alias("dd"))
    enough = (F.col("n_qs") >= min_n) & (F.col("n_sw") >= min_n)
    num = F.col("yd") - F.col("a") * F.col("d1") - F.col("b") * F.col("xd")
    return sums.select(time, "q", "n_qs", "n_sw", F.when(enough, num).alias("num"),
                       F.when(enough, F.col("dd")).alias("den"),
                       F.when(enough, num / F.col("dd")).alias("est"))


def aoss(diffs: DataFrame, time: str, qs: Sequence[float], min_n: int = 10, pool: str = "mean",
         y: str = "d_y") -> DataFrame:
    """Average of the period slopes (``mean``), or one ratio over all periods (``pooled``), per q."""
    each = aoss_by_period(diffs, time, qs, min_n, y)
    value = F.avg("est") if pool == "mean" else F.sum("num") / F.sum("den")
    return each.groupBy("q").agg(value.alias("estimate"), F.count("est").alias("n_periods"))


def aoss_sweep(diffs: DataFrame, time: str, qs: Sequence[float], min_n: int = 10) -> DataFrame:
    """Slope by q with the smallest and largest of the sweep."""
    s = stage(aoss(diffs, time, qs, min_n), "sweep")
    ends = s.agg(F.struct(F.min("estimate").alias("lo"), F.max("estimate").alias("hi")).alias("e")).scalar()
    return s.withColumns({"min_estimate": ends["lo"], "max_estimate": ends["hi"]})


def bias_ratio(estimate: Column, benchmark: Column, truth: float | Column) -> Column:
    """What is left of the benchmark's bias."""
    t = truth if isinstance(truth, Column) else F.lit(float(truth))
    return F.abs(estimate - t) / F.abs(benchmark - t)


def confounded_share(df: DataFrame, c: str, u: str) -> DataFrame:
    """Var(c) / (Var(c) + Var(u)) of two columns, for changes or for within residuals."""
    return df.agg((F.var_samp(c) / (F.var_samp(c) + F.var_samp(u))).alias("share"))


# --------------------------------------------------------------------------- summaries of a dose design


def dose_bins(df: DataFrame, sp: PanelSpec, edges: Sequence[float]) -> DataFrame:
    """Mean change by dose bin minus the mean change at dose 0."""
    wide = two_period_delta(df, sp.unit, sp.time, sp.y, [sp.dose])
    d = F.col(sp.dose)
    bin_ = F.when(d <= 0, F.lit(0))
    for i, e in enumerate(edges, start=1):
        bin_ = bin_.when(d <= F.lit(float(e)), F.lit(i))
    bins = stage(wide.groupBy(bin_.otherwise(F.lit(len(edges) + 1)).alias("bin"))
                 .agg(F.avg("delta_y").alias("mean_delta"), F.avg(d).alias("mean_dose"),
                      F.count("delta_y").alias("n")), "bins")
    zero = bins.filter(F.col("bin") == 0).agg(F.max("mean_delta").alias("z")).scalar()
    return bins.filter(F.col("bin") > 0).withColumn("att", F.col("mean_delta") - zero)


def any_dose_att(df: DataFrame, sp: PanelSpec) -> DataFrame:
    """Two-group contrast of any dose against none."""
    wide = two_period_delta(df, sp.unit, sp.time, sp.y, [sp.dose])
    on = F.col(sp.dose) > 0
    return wide.agg((F.avg(F.when(on, F.col("delta_y"))) - F.avg(F.when(~on, F.col("delta_y")))).alias("att"),
                    F.sum(flag(on)).alias("n_dosed"), F.sum(flag(~on)).alias("n_zero"))


def average_derivative(df: DataFrame, sp: PanelSpec, degree: int = 3) -> DataFrame:
    """Average derivative of a polynomial regression of the change on the dose."""
    wide = stage(two_period_delta(df, sp.unit, sp.time, sp.y, [sp.dose]), "delta")
    d = Design()
    for p in range(1, degree + 1):
        d.expr(f"d^{p}", F.pow(F.col(sp.dose), F.lit(float(p))))
    fit = ols(wide, "delta_y", d, vcov="HC1")
    slope = sum((F.lit(float(p * fit.coef[fit.index(f"d^{p}")])) * F.pow(F.col(sp.dose), F.lit(float(p - 1)))
                 for p in range(1, degree + 1) if f"d^{p}" in fit.terms), F.lit(0.0))
    return wide.agg(F.avg(slope).alias("acrt"), F.count("delta_y").alias("n"))


def wald_ratio(df: DataFrame, y: str, dose: str, instrument: str) -> DataFrame:
    """Outcome contrast over dose contrast between the two values (0 and 1) of an instrument. Rows with a
    NULL in one of the three are left out."""
    known = F.col(y).isNotNull() & F.col(dose).isNotNull()

    def gap(c: str) -> Column:
        return F.avg(F.when(known & (F.col(instrument) == 1), F.col(c))) - F.avg(F.when(known & (F.col(instrument) == 0), F.col(c)))

    return df.agg((gap(y) / gap(dose)).alias("ratio"), gap(dose).alias("first_stage"),
                  F.count(F.when(known & F.col(instrument).isin(0, 1), F.lit(1))).alias("n"))


def discontinuity(df: DataFrame, y: str, running: str, cutoff: float, bandwidth: float | None = None) -> DataFrame:
    """Jump of the outcome at a cutoff, from a line on each side, within ``bandwidth`` of it if given."""
    x = F.col(running) - F.lit(float(cutoff))
    if bandwidth is not None:
        df = df.filter(F.abs(x) <= bandwidth)
    known = df.filter(F.col(y).isNotNull() & F.col(running).isNotNull())

    def side(fn, on: Column) -> Column:
        return fn(F.when(on, F.col(y)), F.when(on, x))

    low, high = x < 0, x >= 0
    return known.agg((side(F.regr_intercept, high) - side(F.regr_intercept, low)).alias("jump"),
                     side(F.regr_slope, low).alias("slope_below"), side(F.regr_slope, high).alias("slope_above"),
                     F.count(F.when(low, F.lit(1))).alias("n_below"), F.count(F.when(high, F.lit(1))).alias("n_above"))
