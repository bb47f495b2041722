"""Descriptive aggregates: cell sums, cohort means, histograms, exact quantiles, curves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import DoseFn, col
from ..plans.stage import drop_stage, stage
from ..spec import PanelSpec
from .panel import to_long


def collapse(df: DataFrame, keys: Sequence[str], y: str) -> DataFrame:
    """Count, sum and sum of squares per cell. Every estimator whose regressors are constant within a
    cell gives the same answer from these sums as from the rows."""
    return df.groupBy(*keys).agg(
        F.count(y).alias("n"), F.sum(y).alias("y_sum"), F.sum(F.col(y) * F.col(y)).alias("y_sumsq"))


def cohort_means(df: DataFrame, sp: PanelSpec, clock: str | None = None) -> DataFrame:
    """Mean outcome by cohort and calendar period, or by another clock column."""
    return df.groupBy(sp.cohort, clock or sp.time).agg(F.avg(sp.y).alias("mean_y"), F.count(sp.y).alias("n"))


def grand_means(df: DataFrame, sp: PanelSpec, clock: str | None = None) -> DataFrame:
    """Cohort means and the mean of all rows at each period, in one table (``is_total`` = 1 for the
    latter). Rows are reduced to cells before the grouping sets copy them."""
    t = clock or sp.time
    cells = collapse(df, [sp.cohort, t], sp.y)
    return (cells.groupingSets([[sp.cohort, t], [t]], sp.cohort, t)
            .agg((F.sum("y_sum") / F.sum("n")).alias("mean_y"), F.sum("n").alias("n"),
                 F.grouping(sp.cohort).cast("int").alias("is_total")))


def treat_means(df: DataFrame, y: str, treat: str, time: str | None = None) -> DataFrame:
    keys = [time, treat] if time else [treat]
    return df.groupBy(*keys).agg(F.avg(y).alias("mean_y"), F.count(y).alias("n"))


def true_effect_means(df: DataFrame, cohort: str, treat: str, effect: str) -> DataFrame:
    return (df.filter(F.col(treat) == 1).groupBy(cohort)
            .agg(F.avg(effect).alias("mean_effect"), F.count(effect).alias("n")))


def histogram(df: DataFrame, column: str, bins: int = 60) -> DataFrame:
    """Equal-width bins between the extremes; the last bin is closed. Empty bins are listed with 0."""
    span = df.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi")).alias("s"))
    s = span.scalar()
    v = F.col(column)
    width = (s["hi"] - s["lo"]) / F.lit(float(bins))
    k = F.when(v >= s["hi"], F.lit(bins - 1)).otherwise(F.floor((v - s["lo"]) / width).cast("int"))
    counts = df.filter(v.isNotNull()).groupBy(k.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (every.join(counts, "bin", "left")
            .select("bin",
                    (s["lo"] + F.col("bin") * width).alias("lo"),
                    (s["lo"] + (F.col("bin") + 1) * width).alias("hi"),
                    F.coalesce("n", F.lit(0).cast("long")).alias("n")))


def group_quantiles(df: DataFrame, by: Sequence[str], value: str | Column, probs: Sequence[float],
                    accuracy: int = 10_000, most: int = 10_000) -> DataFrame:
    """Exact linear-interpolated quantiles per group, one row per (group, q).

    The built-in exact percentile keeps every distinct value of a group in one task. Here a mergeable
    sketch of bounded size gives, for each q, a bracket that must hold the two order statistics wanted.
    A second pass counts the rows under the bracket and the distinct values inside it. While a bracket may hold more than
    ``most`` distinct values, they are cut into 64 parts of about equal size and only the parts that hold the two order
    statistics go on; then the few that are left are sorted, never more than ``most`` by group and q, however large the
    group. ``df`` is read twice. The bracket is chosen from a ladder of widths: the narrowest one that is wider
    than the sketch error at the size of the group, and the whole range when the group is tiny.
    """
    by = list(by)
    keys = by
    base = df.select(*keys, col(value).alias("_v")).filter(F.col("_v").isNotNull())
    probs = sorted(probs)
    ladder = [2.0 / accuracy, 20.0 / accuracy, 200.0 / accuracy, 0.1]

    sketch = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", [min(1.0, max(0.0, p + s * m)) for p in probs for m in ladder for s in (-1, 1)],
                            accuracy).alias("_a"))
    need = F.lit(1.0 / accuracy) + F.lit(2.0) / F.col("_n")

    def bound(i: int, high: bool) -> Column:
        out = F.col("_max") if high else F.col("_min")
        for j in reversed(range(len(ladder))):
            a = F.col("_a")[(i * len(ladder) + j) * 2 + int(high)]
            out = F.when(F.lit(ladder[j]) >= need, a).otherwise(out)
        return out

    idx = range(len(probs))
    brackets = sketch.select(*keys, "_n", *[bound(i, high).alias(f"_{'hi' if high else 'lo'}{i}")
                                            for i in idx for high in (False, True)])
    # written out so that its size is known: small, it is broadcast and the rows are not shuffled
    brackets = stage(brackets, "brackets")
    n = brackets.agg(F.max("_n")).first()[0] or 0
    # distinct values in the widest bracket of a group of that size, by the sketch's error
    held = n * min(1.0, 2 * next((m for m in ladder if m >= 1.0 / accuracy + 2.0 / max(n, 1)), 1.0) + 2.0 / accuracy)
    v = F.col("_v")
    inside, passed = F.lit(False), F.lit(0)
    for i in idx:
        inside = inside | v.between(F.col(f"_lo{i}"), F.col(f"_hi{i}"))
        passed = passed + (v > F.col(f"_hi{i}")).cast("int")

    def attach(left: DataFrame, right: DataFrame) -> DataFrame:
        """Join on the group, NULL being one; without groups the one-row table is a scalar subquery."""
        if by:
            there = right.withColumnsRenamed({k: f"_g{i}" for i, k in enumerate(keys)})
            same = [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)]
            return left.join(there, same).drop(*[f"_g{i}" for i in range(len(keys))])
        one = right.select(F.struct(*right.columns).alias("s")).scalar()
        return left.withColumn("_s", one).select(*left.columns, "_s.*")

    carried = ["_n", *[f"_{e}{i}" for i in idx for e in ("lo", "hi")]]
    spans = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("q"), F.col(f"_lo{i}").alias("lo"),
                               F.col(f"_hi{i}").alias("hi")) for i, p in enumerate(probs)])
    counts = (attach(base, brackets)
              .select(*keys, *carried, F.when(inside, v).alias("_k"), F.when(~inside, passed).alias("_passed"))
              .groupBy(*keys, "_k", "_passed").agg(
                  F.count(F.lit(1)).alias("_c"), *[F.max(c).alias(c) for c in carried])
              .withColumnRenamed("_k", "_v"))
    each = (counts.withColumn("b", F.explode(spans))
            .withColumn("_in", F.when(v.between(F.col("b.lo"), F.col("b.hi")), v))
            .withColumn("_below", F.when(F.col("_v").isNull(), F.col("_passed") <= F.col("b.i"))
                        .otherwise(v < F.col("b.lo")))
            .filter(F.col("_in").isNotNull() | F.col("_below")))
    parts = each.select(*keys, F.col("b.i").alias("_i"), F.col("b.q").alias("q"), "_n", F.col("_in").alias("_v"), "_c")
    if held > most:
        parts = _narrowed(parts, keys, most)
    own = Window.partitionBy(*keys, "_i")
    w = own.orderBy(F.col("_v").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    pos = F.col("q") * (F.col("_n") - 1).cast("double")
    ranked = parts.withColumn("_cum", F.sum("_c").over(w)).filter(F.col("_v").isNotNull())
    picked = ranked.groupBy(*keys, "_i", "q", "_n").agg(
        F.min(F.when(F.col("_cum") > F.floor(pos), F.col("_v"))).alias("_lo"),
        F.min(F.when(F.col("_cum") > F.ceil(pos), F.col("_v"))).alias("_hi"))
    return picked.select(
        *by, "q", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (pos - F.floor(pos))).alias("value"))


def _narrowed(parts: DataFrame, keys: Sequence[str], most: int, cuts: int = 64) -> DataFrame:
    """``parts`` (keys, _i, q, _n, _v, _c: how often a value occurs; NULL counts what lies below) with at most ``most``
    values by group and q, among them the order statistics wanted.

    The values of a group are cut at their own approximate quantiles, so that a part has about one ``cuts``-th of them,
    whatever their distribution. Counts by part are few and are added up in order; parts below the wanted ones become
    one count, parts above them go.
    """
    group = [*keys, "_i"]
    total = F.sum("_c").alias("_c")

    def attach(left: DataFrame, right: DataFrame) -> DataFrame:
        there = right.withColumnsRenamed({k: f"_g{j}" for j, k in enumerate(group)})
        same = [F.col(k).eqNullSafe(F.col(f"_g{j}")) for j, k in enumerate(group)]
        return left.join(there, same).drop(*[f"_g{j}" for j in range(len(group))])

    parts = stage(parts.groupBy(*group, "q", "_n", "_v").agg(total), "parts")
    while True:
        known = parts.filter(F.col("_v").isNotNull())
        sizes = known.groupBy(*group).agg(F.count(F.lit(1)).alias("m"), F.percentile_approx(
            "_v", [j / cuts for j in range(1, cuts)], 100 * cuts).alias("_cuts"))
        sizes = stage(sizes, "sizes")
        if (sizes.agg(F.max("m")).first()[0] or 0) <= most:
            return parts
        place = F.when(F.col("_v").isNull(), F.lit(-1)).otherwise(F.size(F.filter("_cuts", lambda c: F.col("_v") > c)))
        placed = attach(parts, sizes.drop("m")).withColumn("_at", place).drop("_cuts")
        tally = placed.groupBy(*group, "q", "_n", "_at").agg(total)
        upto = F.sum("_c").over(Window.partitionBy(*group).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        pos = F.col("q") * (F.col("_n") - 1).cast("double")
        chosen = tally.withColumn("_cum", upto).groupBy(*group).agg(
            F.min(F.when(F.col("_cum") > F.floor(pos), F.col("_at"))).alias("_from"), F.min(F.when(F.col("_cum") > F.ceil(pos), F.col("_at"))).alias("_to"))
        kept = attach(placed, stage(chosen, "chosen")).filter(F.col("_at") <= F.col("_to"))
        narrower = kept.withColumn("_v", F.when(F.col("_at") >= F.col("_from"), F.col("_v")))
        narrower = stage(narrower.groupBy(*group, "q", "_n", "_v").agg(total), "parts")
        drop_stage(parts)
        drop_stage(sizes)
        parts = narrower


def group_quantile(df: DataFrame, by: Sequence[str], value: str | Column, q: float) -> DataFrame:
    return group_quantiles(df, by, value, [q])


def summary_stats(df: DataFrame, column: str, other: str | None = None) -> DataFrame:
    """Mean, exact median, extremes and, with ``other``, the correlation."""
    aggs = [F.avg(column).alias("mean"), F.min(column).alias("min"), F.max(column).alias("max")]
    if other:
        aggs.append(F.corr(column, other).alias("corr"))
    med = group_quantiles(df, [], column, [0.5]).select("value")
    return df.agg(*aggs).withColumn("median", med.scalar())


def dose_grid(spark: SparkSession, lo: float, hi: float, n: int, fns: Mapping[str, DoseFn]) -> DataFrame:
    """Named curves on an even grid of n doses, long form."""
    step = (hi - lo) / (n - 1)
    grid = spark.range(n).select((F.lit(lo) + F.col("id") * F.lit(step)).alias("d"))
    wide = grid.select("d", *[fn(F.col("d")).cast("double").alias(k) for k, fn in fns.items()])
    return to_long(wide, ["d"], list(fns), "curve", "tau")


def dose_grid_over(df: DataFrame, column: str, n: int, fns: Mapping[str, DoseFn]) -> DataFrame:
    """The same on the range a column covers."""
    s = df.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi")).alias("s")).scalar()
    grid = df.sparkSession.range(n).select(
        (s["lo"] + F.col("id") * ((s["hi"] - s["lo"]) / F.lit(float(n - 1)))).alias("d"))
    wide = grid.select("d", *[fn(F.col("d")).cast("double").alias(k) for k, fn in fns.items()])
    return to_long(wide, ["d"], list(fns), "curve", "tau")
