"""Effects of a treatment that clusters take up at different times."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import coin_text, flag, safe_log
from ..plans.stage import stage
from ..spec import PanelSpec
from .absorb import absorb_balanced
from .describe import collapse
from .design import Design, post_cells, pre_cells
from .gram import partial_sums
from .regress import Fit, ols

# --------------------------------------------------------------------------- cells


def panel_cells(df: DataFrame, sp: PanelSpec, extra: Sequence[str] = (), label: str = "cells") -> DataFrame:
    """Counts and sums by (cluster, cohort, period), written once. This is the only pass over the rows;
    all estimators below work on its result. Rows of periods that the panel does not list are left out."""
    keys = [sp.cluster, sp.cohort, sp.time, *extra]
    listed = df.filter(F.col(sp.time).isin([*sp.times])) if sp.times else df
    out = stage(collapse(listed, keys, sp.y), label)
    return out.withColumn(sp.treat, flag(F.col(sp.time) >= F.col(sp.cohort)))


# --------------------------------------------------------------------------- two-way fixed effects


def twfe_slope(cells: DataFrame, treat: str, cluster: str, time: str) -> DataFrame:
    """Closed form on a balanced panel: one row with the coefficient of the treatment."""
    x = cells.select(cluster, time, F.col(treat).cast("double").alias("d"),
                     (F.col("y_sum") / F.col("n")).alias("y"), F.col("n").cast("double").alias("w"))
    r = absorb_balanced(x, ["d", "y"], cluster, time, "w")
    return r.agg((F.sum(F.col("w") * F.col("d") * F.col("y"))
                  / F.sum(F.col("w") * F.col("d") * F.col("d"))).alias("estimate"))


def twfe(cells: DataFrame, sp: PanelSpec, vcov: str = "CR1") -> Fit:
    """Static effect with cluster and period effects."""
    d = Design().main(sp.treat).factor(sp.time, sp.times, ref=sp.times[0])
    return ols(cells, None, d, cells=True, absorb=sp.cluster, cluster=sp.cluster, vcov=vcov)


def relative_times(sp: PanelSpec) -> list[int]:
    return sorted({t - g for g in sp.cohorts for t in sp.times})


def twfe_event(cells: DataFrame, sp: PanelSpec, base: int = -1, vcov: str = "CR1") -> Fit:
    """Event study: one coefficient per relative period other than the base; zero for the never treated."""
    rel = F.col(sp.time) - F.col(sp.cohort)
    d = Design()
    for e in relative_times(sp):
        if e != base:
            d.expr(f"rel::{e}", flag(rel == F.lit(e)))
    d.factor(sp.time, sp.times, ref=sp.times[0])
    return ols(cells, None, d, cells=True, absorb=sp.cluster, cluster=sp.cluster, vcov=vcov)


# --------------------------------------------------------------------------- group-time effects


def att_grid(sp: PanelSpec) -> list[dict]:
    """The (cohort, period) pairs with their base period: the last one before treatment for treated
    periods, the previous one before that. Positions refer to the list of periods."""
    times = list(sp.times)
    out = []
    for g in sp.cohorts:
        before = [i for i, t in enumerate(times) if t < g]
        if not before:
            continue
        for i in range(1, len(times)):
            b = before[-1] if times[i] >= g else i - 1
            out.append({"g": g, "t": times[i], "ti": i, "bi": b, "post": int(times[i] >= g),
                        "cut": max(times[i], times[b])})
    return out


def profile(df: DataFrame, sp: PanelSpec, by: Sequence[str]) -> DataFrame:
    """One row per group with its number of units and its outcome sum in every period, from one
    aggregate with partial sums before the shuffle. A mean change is the change of the mean only if the
    same units have an outcome in every period; a group whose counts differ stops the query."""
    at = [F.when(F.col(sp.time) == F.lit(t), F.col(sp.y)) for t in sp.times]
    counted = df.groupBy(*by).agg(F.array(*[F.count(y) for y in at]).alias("_c"),
                                  F.array(*[F.sum(y) for y in at]).alias("s"))
    keep = [c for c in counted.columns if c not in ("_c", "s")]
    n = F.col("_c")[0]
    stop = F.raise_error(F.lit(f"{sp.y} is missing for some units in some periods; see complete_units"))
    return counted.select(*keep, n.alias("n"), F.when(
        F.array_min("_c") == F.array_max("_c"), F.col("s")).otherwise(stop.cast("array<double>")).alias("s"))


def complete_units(df: DataFrame, sp: PanelSpec) -> DataFrame:
    """Only the units that have an outcome in every period."""
    seen = F.count(F.col(sp.y)).over(Window.partitionBy(sp.unit))
    return df.withColumn("_seen", seen).filter(F.col("_seen") == len(sp.times)).drop("_seen")


def _is_control(cohort: Column, g: Column, cut: Column, control: str) -> Column:
    if control == "nevertreated":
        return cohort.isNull()
    return cohort.isNull() | ((cohort > cut) & (cohort != g))


def att_gt(df: DataFrame, sp: PanelSpec, control: str = "notyettreated") -> DataFrame:
    """ATT(g, t): change of the cohort since its base period minus the change of the controls.

    Controls are units not treated by either period. On a balanced panel the mean change is the change
    of the mean, so the sums by cohort and period are enough and no unit is joined with another.
    """
    return att_from_profile(profile(df, sp, [sp.cohort]), sp, control)


def att_from_profile(p: DataFrame, sp: PanelSpec, control: str = "notyettreated") -> DataFrame:
    """The same from a profile that has one row per cohort."""
    grid = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in c.items()]) for c in att_grid(sp)])
    rows = p.withColumn("c", F.explode(grid))
    delta = F.element_at("s", F.col("c.ti") + 1) - F.element_at("s", F.col("c.bi") + 1)
    own = F.col(sp.cohort) == F.col("c.g")
    ctl = _is_control(F.col(sp.cohort), F.col("c.g"), F.col("c.cut"), control)
    sums = rows.groupBy(F.col("c.g").alias("g"), F.col("c.t").alias("t"), F.col("c.post").alias("post"),
                        F.col("c.ti").alias("ti"), F.col("c.bi").alias("bi"), F.col("c.cut").alias("cut")).agg(
        F.sum(F.when(own, delta)).alias("_dt"), F.sum(F.when(own, F.col("n"))).alias("n_treated"),
        F.sum(F.when(ctl, delta)).alias("_dc"), F.sum(F.when(ctl, F.col("n"))).alias("n_control"),
        F.sum("n").alias("n_all"))
    out = sums.withColumns({"mean_treated": F.col("_dt") / F.col("n_treated"),
                            "mean_control": F.col("_dc") / F.col("n_control")})
    return (out.withColumns({"att": F.col("mean_treated") - F.col("mean_control"),
                             "event": F.col("t") - F.col("g")})
            .filter(F.col("att").isNotNull()))


def att_table(att: DataFrame) -> DataFrame:
    return att.select("g", "t", "event", "post", "att", "n_treated", "n_control")


def agg_att(att: DataFrame, kind: str) -> DataFrame:
    """Averages of ATT(g, t) with cohort shares as weights: simple, dynamic (by event time), group or
    calendar. The row with NULL key is the overall number."""
    p, a = F.col("n_treated"), F.col("att")
    post = att.filter(F.col("post") == 1)
    if kind == "simple":
        return post.agg((F.sum(p * a) / F.sum(p)).alias("att")).select(
            F.lit("simple").alias("kind"), F.lit(None).cast("int").alias("key"), "att")
    if kind == "dynamic":
        each = att.groupBy(F.col("event").alias("key")).agg((F.sum(p * a) / F.sum(p)).alias("att"))
        overall = each.filter(F.col("key") >= 0).agg(F.avg("att").alias("att"))
    elif kind == "group":
        each = post.groupBy(F.col("g").alias("key")).agg(F.avg("att").alias("att"), F.first("n_treated").alias("_p"))
        overall = each.agg((F.sum(F.col("_p") * a) / F.sum("_p")).alias("att"))
        each = each.drop("_p")
    elif kind == "calendar":
        each = post.groupBy(F.col("t").alias("key")).agg((F.sum(p * a) / F.sum(p)).alias("att"))
        overall = each.agg(F.avg("att").alias("att"))
    else:
        raise ValueError(kind)
    return each.select(F.lit(kind).alias("kind"), "key", "att").unionByName(
        overall.select(F.lit(kind).alias("kind"), F.lit(None).cast("int").alias("key"), "att"))


def _estimands(grid: list[dict], kind: str) -> list[dict]:
    """Each wanted number as weights on the ATT cells and on the estimated cohort sizes."""
    groups = sorted({c["g"] for c in grid})
    k = len(grid)

    def combine(label, members, fixed: bool):
        size = sum(grid[i]["n"] for i in members)
        w = [0.0] * k
        for i in members:
            w[i] = (1.0 / len(members)) if fixed else grid[i]["n"] / size
        value = sum(w[i] * grid[i]["att"] for i in members)
        share = [0.0] * len(groups)
        if not fixed:
            for i in members:
                share[groups.index(grid[i]["g"])] += (grid[i]["att"] - value) * grid[i]["n_all"] / size
        return {"label": label, "w": w, "c": share, "value": value}

    def average(label, parts, weights=None, sizes=None):
        m = len(parts)
        ws = weights or [1.0 / m] * m
        out = {"label": label, "w": [sum(a * p["w"][i] for a, p in zip(ws, parts)) for i in range(k)],
               "c": [sum(a * p["c"][j] for a, p in zip(ws, parts)) for j in range(len(groups))],
               "value": sum(a * p["value"] for a, p in zip(ws, parts))}
        if sizes:
            total = sum(n for _, n, _ in sizes)
            for (g, _, n_all), p in zip(sizes, parts):
                out["c"][groups.index(g)] += (p["value"] - out["value"]) * n_all / total
        return out

    post = [i for i in range(k) if grid[i]["post"]]
    if kind == "gt":
        return [combine(f"ATT({c['g']},{c['t']})", [i], True) for i, c in enumerate(grid)]
    if kind == "simple":
        return [combine("simple", post, False)]
    if kind == "dynamic":
        levels = sorted({c["t"] - c["g"] for c in grid})
        parts = [combine(f"event {e}", [i for i in range(k) if grid[i]["t"] - grid[i]["g"] == e], False)
                 for e in levels]
        return parts + [average("overall", [p for p, e in zip(parts, levels) if e >= 0])]
    if kind == "group":
        parts, sizes = [], []
        for g in groups:
            mine = [i for i in post if grid[i]["g"] == g]
            if mine:
                parts.append(combine(f"group {g}", mine, True))
                sizes.append((g, grid[mine[0]]["n"], grid[mine[0]]["n_all"]))
        total = sum(n for _, n, _ in sizes)
        return parts + [average("overall", parts, [n / total for _, n, _ in sizes], sizes)]
    if kind == "calendar":
        levels = sorted({grid[i]["t"] for i in post})
        parts = [combine(f"time {t}", [i for i in post if grid[i]["t"] == t], False) for t in levels]
        return parts + [average("overall", parts)]
    raise ValueError(kind)


@dataclass
class Replicates:
    """Estimands with their labels and values (model-sized), and rows ``i``, ``x``: with k estimands, totals below k are the
    sums of squared influences, total r k + j is the influence sum of estimand j with the signs of replicate r (from 1)."""

    spark: SparkSession
    wanted: list[dict]
    n_all: float
    totals: DataFrame

    def names(self) -> DataFrame:
        return self.spark.createDataFrame([(i, e["label"], float(e["value"])) for i, e in enumerate(self.wanted)],
                                          "i int, term string, estimate double")

    def draws(self) -> DataFrame:
        """One row per replicate and estimand: its deviation from the estimate."""
        k = F.lit(len(self.wanted))
        return self.totals.filter(F.col("i") >= k).select(
            F.floor(F.col("i") / k).cast("int").alias("rep"), (F.col("i") % k).cast("int").alias("i"),
            (F.col("x") / F.lit(self.n_all)).alias("dev"))


def att_replicates(df: DataFrame, sp: PanelSpec, kind: str = "gt", control: str = "notyettreated",
                   cluster: str | None = None, boot: int = 0, seed: int = 1) -> Replicates:
    """Influence sums of every estimand, squared and under ``boot`` draws of signs by cluster.

    The influence of a cluster on every estimand follows from its own row of sums, so nothing is joined. Draws
    repeat cluster rows, never panel rows: each task multiplies a sign matrix with its influence rows and sends on
    one vector.
    """
    cluster = cluster or sp.cluster
    p = stage(profile(df, sp, [F.col(cluster).alias("cl"), F.col(sp.cohort).alias("g0")]), "profile")
    by_cohort = p.groupBy(F.col("g0").alias(sp.cohort)).agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(len(sp.times))]).alias("s"))
    grid = [r.asDict() | {"n": r["n_treated"]}
            for r in att_from_profile(by_cohort, sp, control).orderBy("g", "t").collect()]
    wanted = _estimands(grid, kind)
    groups = sorted({c["g"] for c in grid})
    n_all = float(grid[0]["n_all"])

    influence = _influence(grid, wanted, groups, control)
    signs = coin_text(seed, boot, "cl") if boot else F.lit("")
    sums = _signed_sums(boot, len(wanted))
    if cluster == sp.unit:
        # one row per cluster already: influence and sums in the same task
        rows = p.select("g0", "n", "s", signs.alias("h"))
        totals = partial_sums(rows, lambda batches: sums(influence(batches)))
    else:
        # a cluster may hold several cohorts, so its rows are added up first
        rows = p.select("g0", "n", "s", F.col("cl").cast("string").alias("h")).mapInArrow(
            influence, "h string, e array<double>")
        flat = rows.select("h", F.posexplode("e").alias("i", "v")).groupBy("h", "i").agg(F.sum("v").alias("v"))
        per = flat.groupBy(F.col("h").alias("cl")).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("e"))
        totals = partial_sums(per.select(signs.alias("h"), F.col("e.v").alias("e")), sums)
    return Replicates(df.sparkSession, wanted, n_all, totals)


def att_inference(df: DataFrame, sp: PanelSpec, kind: str = "gt", control: str = "notyettreated",
                  cluster: str | None = None, boot: int = 0, seed: int = 1) -> DataFrame:
    """Estimates with influence-function standard errors and, with ``boot`` > 0, multiplier-bootstrap ones.

    ``cluster`` = the unit column gives the unclustered version.
    """
    r = att_replicates(df, sp, kind, control, cluster, boot, seed)
    k = len(r.wanted)
    term = (F.col("i") % F.lit(k)).alias("i")
    square = F.sum(F.when(F.col("i") < k, F.col("x")))
    spread = F.stddev_samp(F.when(F.col("i") >= k, F.col("x"))) / F.lit(r.n_all)
    errors = r.totals.groupBy(term).agg((F.sqrt(square) / F.lit(r.n_all)).alias("se"),
                                        *([spread.alias("se_boot")] if boot else []))
    return r.names().join(errors, "i", "left").drop("i")


#: Distance of the quartiles of the standard normal law.
NORMAL_QUARTILES = 1.3489795003921634


def simultaneous(draws: DataFrame, level: float = 0.95, alone: Column | None = None) -> DataFrame:
    """Per ``term`` of bootstrap rows (rep, term, dev): ``se_boot``, the distance of its quartiles on the scale of the normal
    law, and ``crit``, the level's quantile over replicates of the largest studentised deviation of any term.

    A band of crit times se_boot around the estimates covers all of them together with the level's probability. Terms
    without spread take no part in the maximum and have no band. Rows where ``alone`` holds are terms that get the
    critical value of their own deviations only, such as an overall average beside its parts. Quantiles are order
    statistics (the smallest value that reaches the share). Replicates stay rows: the maximum is an aggregate by
    replicate, and what is sorted has one row per replicate.
    """
    group = F.when(alone, F.col("term")) if alone is not None else F.lit(None).cast("string")
    rows = draws.withColumn("family", group)
    quartile = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY dev)")
    spread = rows.groupBy("family", "term").agg(((quartile(0.75) - quartile(0.25)) / F.lit(NORMAL_QUARTILES)).alias("se_boot"))
    spread = stage(spread, "spread")
    same = F.col("f").eqNullSafe(F.col("family")) & (F.col("t") == F.col("term"))
    known = spread.filter(F.col("se_boot") > 0).select(F.col("family").alias("f"), F.col("term").alias("t"), "se_boot")
    largest = rows.join(known, same).groupBy("family", "rep").agg(F.max(F.abs(F.col("dev") / F.col("se_boot"))).alias("m"))
    crit = largest.groupBy(F.col("family").alias("f")).agg(F.expr(f"percentile_disc({level}) WITHIN GROUP (ORDER BY m)").alias("crit"))
    return spread.join(crit, F.col("family").eqNullSafe(F.col("f")), "left").select(
        "term", F.when(F.col("se_boot") > 0, F.col("se_boot")).alias("se_boot"), "crit")


def att_bands(df: DataFrame, sp: PanelSpec, kind: str = "gt", control: str = "notyettreated", cluster: str | None = None,
              boot: int = 999, seed: int = 1, level: float = 0.95) -> DataFrame:
    """term, estimate, se_boot, crit, conf_low, conf_high: bands that cover all terms at once (see ``simultaneous``).

    The overall average of a dynamic, group or calendar table is no member of the family; its interval is its own.
    """
    r = att_replicates(df, sp, kind, control, cluster, boot, seed)
    names = r.names()
    draws = stage(r.draws().join(names.select("i", "term"), "i").select("rep", "term", "dev"), "draws")
    bands = simultaneous(draws, level, F.col("term") == "overall")
    half = F.col("crit") * F.col("se_boot")
    return names.join(bands, "term", "left").select(
        "term", "estimate", "se_boot", "crit", (F.col("estimate") - half).alias("conf_low"), (F.col("estimate") + half).alias("conf_high"))


def att_intervals(table: DataFrame, se: str = "se") -> DataFrame:
    """The table of ``att_inference`` in the shape of a tidy fit (term, estimate, std_error and a normal
    interval), so that it can be stacked and compared with one."""
    e, s = F.col("estimate"), F.col(se)
    return table.select("term", "estimate", s.alias("std_error"), (e - 1.96 * s).alias("conf_low"), (e + 1.96 * s).alias("conf_high"))


def _influence(grid: list[dict], wanted: list[dict], groups: list[int], control: str):
    """Per batch of profile rows, the influence of each row on every estimand; ``h`` is passed on."""
    n_all = float(grid[0]["n_all"])
    sizes = {c["g"]: float(c["n_treated"]) for c in grid}
    w = np.array([e["w"] for e in wanted]).T
    c_share = np.array([e["c"] for e in wanted]).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            g0 = b.column("g0").cast(pa.float64()).to_numpy(zero_copy_only=False)  # NULL becomes NaN
            n = b.column("n").to_numpy(zero_copy_only=False).astype(float)
            s = b.column("s").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            never = np.isnan(g0)
            psi = np.zeros((b.num_rows, len(grid)))
            for j, c in enumerate(grid):
                delta = s[:, c["ti"]] - s[:, c["bi"]]
                own = g0 == c["g"]
                ctl = never if control == "nevertreated" else never | ((g0 > c["cut"]) & ~own)
                psi[own, j] = (n_all / c["n_treated"] * (delta - n * c["mean_treated"]))[own]
                psi[ctl, j] = (-n_all / c["n_control"] * (delta - n * c["mean_control"]))[ctl]
            dev = np.column_stack([n * ((g0 == g) - sizes[g] / n_all) for g in groups])
            e = psi @ w + dev @ c_share
            offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * e.shape[1])
            yield pa.RecordBatch.from_pydict({
                "h": b.column("h"), "e": pa.ListArray.from_arrays(offsets, pa.array(e.ravel()))})
    return run


def _signed_sums(boot: int, k: int, chunk: int = 2048):
    """Per task: the sums of squares of the influence rows, then for every replicate their sum with that
    replicate's signs."""
    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for b in batches:
            e = b.column("e").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, k)
            text = np.frombuffer("".join(b.column("h").to_pylist()).encode(), np.uint8)
            text = text.reshape(b.num_rows, -1) if boot else None
            for lo in range(0, b.num_rows, chunk):
                part = e[lo:lo + chunk]
                rows = [(part * part).sum(axis=0)[None, :]]
                if boot:
                    rows.append(np.where(text[lo:lo + chunk, :boot] < ord("8"), 1.0, -1.0).T @ part)
                got = np.vstack(rows)
                total = got if total is None else total + got
        return None if total is None else total.ravel()
    return run


# --------------------------------------------------------------------------- saturated regressions


def etwfe_design(sp: PanelSpec, fe: str = "cluster", time_from: int | None = None) -> Design:
    """Regressors of the extended two-way model; cluster effects are absorbed and not listed."""
    times, flag_col = list(sp.times), sp.treat
    periods = [t for t in times if t >= time_from] if time_from is not None else times[1:]
    if fe == "crossed":
        cohort, time = Design().factor(sp.cohort, sp.cohorts), Design().factor(sp.time, times, ref=times[0])
        return Design().crossed(Design().main(flag_col), cohort, time)
    d = Design().cells(flag_col, sp.cohort, sp.time, post_cells(sp.cohorts, sp.times))
    if fe in ("cohort", "explicit"):
        d.factor(sp.cohort, sp.cohorts)
    return d.factor(sp.time, periods)


def etwfe(cells: DataFrame, sp: PanelSpec, fe: str = "cluster", time_from: int | None = None,
          vcov: str = "CR1") -> Fit:
    """One effect per treated (cohort, period) cell. ``fe`` is cluster, cohort, explicit (the cohort form
    with classical errors available) or crossed (all products, collinear ones dropped)."""
    return ols(cells, None, etwfe_design(sp, fe, time_from), cells=True,
               absorb=sp.cluster if fe == "cluster" else None, cluster=sp.cluster, vcov=vcov)


def pretrend_cells(cells: DataFrame, sp: PanelSpec, vcov: str = "CR1") -> Fit:
    """Saturated model of the untreated rows: cohort by period effects of the ever treated, with the first
    period as base."""
    base = sp.times[0]
    pre = cells.filter(F.col(sp.treat) == 0).withColumn("evtreat", F.col(sp.cohort).isNotNull().cast("int"))
    d = (Design().cells("evtreat", sp.cohort, sp.time, pre_cells(sp.cohorts, sp.times, base))
         .factor(sp.cohort, sp.cohorts).factor(sp.time, sp.times, ref=base))
    return ols(pre, None, d, cells=True, cluster=sp.cluster, vcov=vcov)


def pretrend_linear(df: DataFrame, sp: PanelSpec, log: bool = False, vcov: str = "CR1") -> Fit:
    """Linear trend of the untreated rows with a differential trend of the ever treated."""
    y = safe_log(sp.y) if log else F.col(sp.y)
    pre = df.filter(F.coalesce(F.col(sp.time) < F.col(sp.cohort), F.lit(True))).select(
        sp.cluster, sp.time, F.col(sp.cohort).isNotNull().cast("int").alias("ever_treated"), y.alias("_yy"))
    cells = stage(collapse(pre.filter(F.col("_yy").isNotNull()), [sp.cluster, sp.time, "ever_treated"], "_yy"), "pre")
    cells = cells.withColumn("time_since", F.col(sp.time) - F.lit(sp.times[0]))
    d = Design().crossed(Design().main("ever_treated"), Design().main("time_since"))
    return ols(cells, None, d, cells=True, cluster=sp.cluster, vcov=vcov)


def logged(df: DataFrame, sp: PanelSpec) -> tuple[DataFrame, PanelSpec]:
    """The panel with the logarithm of the outcome as outcome, without units whose outcome is not positive
    in some period."""
    logs = replace(sp, y=f"log_{sp.y}")
    return complete_units(df.withColumn(logs.y, safe_log(sp.y)), logs), logs
