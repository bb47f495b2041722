"""Randomisation inference on cluster cells."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tails import t_quantile
from ..plans.stage import stage
from ..spec import PanelSpec
from .absorb import absorb_balanced
from .panel import permute_cohorts


def cohort_sizes(cells: DataFrame, sp: PanelSpec) -> dict[int | None, int]:
    """Number of clusters per cohort, never treated last; cohorts are few."""
    rows = cells.select(sp.cluster, sp.cohort).distinct().groupBy(sp.cohort).count().collect()
    got = {r[0]: r["count"] for r in rows}
    return {g: got[g] for g in sorted(got, key=lambda g: (g is None, g or 0))}


def permutation_draws(cells: DataFrame, sp: PanelSpec, reps: int, seed: int,
                      sizes: Mapping[int | None, int] | None = None) -> DataFrame:
    """Re-draw which clusters belong to which cohort ``reps`` times and re-estimate the static two-way
    effect each time: one row per draw with estimate, clustered error and rejection flag.

    ``cells`` are (cluster, cohort, period) sums of the rows. The outcome, centered by cluster and period,
    does not depend on the draw, so a draw only needs sums over clusters of the centered outcome after
    the drawn period. What is repeated is one short row per cluster.
    """
    times = list(sp.times)
    k = len(times)
    sizes = sizes or cohort_sizes(cells, sp)
    n_clusters = sum(sizes.values())
    flat = cells.groupBy(sp.cluster, sp.time).agg(F.sum("n").alias("w"), F.sum("y_sum").alias("s"))
    y = flat.select(sp.cluster, sp.time, F.col("w").cast("double").alias("w"), (F.col("s") / F.col("w")).alias("y"))
    y = absorb_balanced(y, ["y"], sp.cluster, sp.time, "w")
    wide = stage(y.groupBy(sp.cluster).agg(
        F.max("w").alias("w"),
        F.array(*[F.sum(F.when(F.col(sp.time) == F.lit(t), F.col("y"))) for t in times]).alias("y")), "wide")

    draws = permute_cohorts(
        wide.select(sp.cluster).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))),
        sp.cluster, sizes, seed, rep="rep", out="g")
    on = F.array(*[F.coalesce((F.lit(t) >= F.col("g")).cast("double"), F.lit(0.0)) for t in times])
    rows = draws.join(wide, sp.cluster).select("rep", "w", "y", on.alias("d"))

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)

    def total(a):
        return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)

    share = rows.groupBy("rep").agg(
        F.sum("w").alias("total_w"),
        F.array(*[F.sum(F.col("w") * F.col("d")[i]) / F.sum("w") for i in range(k)]).alias("dt"),
        F.sum(F.col("w") * dot(F.col("y"), F.col("d"))).alias("num"))
    both = rows.join(share, "rep")
    mean_d = total(F.col("d")) / k
    grand = total(F.col("dt")) / k
    # residual treatment of a cluster: its path minus its mean minus the period means plus the grand mean
    dev = F.zip_with("d", "dt", lambda a, b: a - b)
    dev = F.transform(dev, lambda v: v - (mean_d - grand))
    scored = both.select("rep", "total_w", "w", "num", dev.alias("dv"), "y").select(
        "rep", "total_w", "num", (F.col("w") * dot(F.col("dv"), F.col("dv"))).alias("sdd"),
        (F.col("w") * dot(F.col("dv"), F.col("y"))).alias("sdy"))
    n = F.first("total_w") * k
    rank = k + 1
    g = float(n_clusters)
    # sum over clusters of (sdy - b sdd)^2, expanded so that one aggregate is enough
    sums = scored.groupBy("rep").agg(
        n.alias("n"), F.sum("sdd").alias("dd"), F.sum("sdy").alias("dy"),
        F.sum(F.col("sdy") * F.col("sdy")).alias("q0"), F.sum(F.col("sdy") * F.col("sdd")).alias("q1"),
        F.sum(F.col("sdd") * F.col("sdd")).alias("q2"))
    b = F.col("dy") / F.col("dd")
    meat = F.greatest(F.col("q0") - 2 * b * F.col("q1") + b * b * F.col("q2"), F.lit(0.0))
    adj = F.lit(g / (g - 1.0)) * (F.col("n") - 1) / (F.col("n") - rank)
    se = F.sqrt(meat * adj) / F.col("dd")
    crit = t_quantile(0.975, g - 1.0)
    return (sums.select("rep", b.alias("estimate"), se.alias("se"))
            .withColumn("sig", (F.abs(F.col("estimate") / F.col("se")) >= F.lit(crit)).cast("int")))


def permutation_test(draws: DataFrame, observed: DataFrame) -> DataFrame:
    """Share of draws at least as far from zero as the observed estimate (one-row table), and the share of
    draws that reject."""
    obs = observed.select("estimate").scalar()
    return draws.agg(
        F.first(obs).alias("observed"),
        ((F.sum((F.abs("estimate") >= F.abs(obs)).cast("int")) + 1) / (F.count("estimate") + 1)).alias("p_value"),
        F.avg(F.col("sig").cast("double")).alias("rejection_share"), F.count("estimate").alias("n_reps"))
