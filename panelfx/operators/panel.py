"""Panel construction: skeletons, enrichment, treatment clocks, dummies, differences, reshaping."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import (DoseFn, block_of, digest, hash_rank, indicator, is_treated,
                                 lit_array, safe_log)
from ..spec import PanelSpec


def skeleton(units: DataFrame, **axes: Sequence) -> DataFrame:
    """Full product of the unit rows with one or more short axes, e.g. ``time=range(2011, 2021)``.

    The axes are given as values, so the product is made row by row without a join or a shuffle.
    """
    out = units
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(lit_array(values)))
    return out


def enrich(df: DataFrame, dim: DataFrame, on: Sequence[str] | None = None) -> DataFrame:
    """Left join with a dimension; without ``on``, on all names the two tables share.

    No broadcast is forced: the optimizer broadcasts the dimension when its size is under the session's
    threshold and shuffles otherwise.
    """
    keys = list(on) if on else [c for c in df.columns if c in set(dim.columns)]
    if not keys:
        raise ValueError("the two tables share no column names")
    return df.join(dim, keys, "left")


def fill_cells(df: DataFrame, y: str, value: float = 0.0) -> DataFrame:
    return df.withColumn(y, F.coalesce(F.col(y), F.lit(value)))


def balanced_panel(units: DataFrame, facts: DataFrame, unit: str, time: str, times: Sequence[int],
                   measures: Mapping[str, Callable[[Column], Column]], inputs: Mapping[str, Column],
                   fill: float | None = 0.0) -> DataFrame:
    """Every unit at every period, with ``measures[m](inputs[m])`` of the fact rows of that cell.

    The facts are reduced to one row per unit first (with partial aggregation before the shuffle), joined
    to the units on the unit key and only then spread over the periods. The join moves one row per unit
    rather than one per cell, and the result stays partitioned by unit for the windows that follow.
    A cell without facts is NULL for every measure, counts included, before ``fill``.
    """
    times = list(times)
    names = list(measures)
    cells = (facts.filter(F.col(time).isin(times)).groupBy(unit, time)
             .agg(*[measures[m](inputs[m]).alias(m) for m in names]))
    # at most one entry per period, so the list of one unit is short
    per_unit = cells.groupBy(unit).agg(F.map_from_entries(F.collect_list(
        F.struct(F.col(time), F.struct(*names)))).alias("_m"))
    rows = units.join(per_unit, unit, "left").withColumn(time, F.explode(lit_array(times)))
    out = rows.select(*units.columns, time, *[F.col("_m")[F.col(time)][m].alias(m) for m in names])
    if fill is not None:
        for m in names:
            out = out.withColumn(m, F.coalesce(F.col(m), F.lit(fill)))
    return out


def assign_cohort(df: DataFrame, mapping: Mapping[int, int | None] | DataFrame, cluster: str,
                  out: str = "cohort", never: int | None = None) -> DataFrame:
    """First treated period by cluster. ``never`` names the period that stands for "not treated"
    and becomes NULL. A mapping given as values becomes a map lookup, a DataFrame a left join."""
    if isinstance(mapping, DataFrame):
        df = df.join(mapping.select(cluster, F.col(mapping.columns[-1]).alias(out)), cluster, "left")
    else:
        live = {k: v for k, v in mapping.items() if v is not None}
        m = F.create_map(*[F.lit(x) for kv in live.items() for x in kv])
        df = df.withColumn(out, F.try_element_at(m, F.col(cluster)))
    if never is not None:
        df = df.withColumn(out, F.when(F.col(out) != F.lit(never), F.col(out)))
    return df


def relabel_never(df: DataFrame, cohort: str, never: int) -> DataFrame:
    return df.withColumn(cohort, F.when(F.col(cohort) != F.lit(never), F.col(cohort)))


def slots_column(slot: Column, sizes: Mapping[int | None, int]) -> Column:
    """Cohort of the slot-th cluster (counted from 1) when cohorts take slots in the order given."""
    out, upto = None, 0
    for cohort, n in sizes.items():
        upto += n
        value = F.lit(cohort).cast("int")
        out = F.when(slot <= F.lit(upto), value) if out is None else out.when(slot <= F.lit(upto), value)
    return out


def permute_cohorts(clusters: DataFrame, cluster: str, sizes: Mapping[int | None, int], seed: int,
                    rep: str | None = None, out: str = "cohort") -> DataFrame:
    """Draw clusters into cohorts of fixed sizes without replacement, in the order of a digest.
    With ``rep``, one draw for every value of that column."""
    by = [rep] if rep else []
    key = digest(seed, *by, cluster)
    ranked = hash_rank(clusters.withColumn("_h", key), by, "_h", "_slot")
    return ranked.withColumn(out, slots_column(F.col("_slot"), sizes)).drop("_h", "_slot")


def with_block_id(df: DataFrame, unit: str, size: int, out: str) -> DataFrame:
    return df.withColumn(out, block_of(unit, size))


def treat_flag(df: DataFrame, sp: PanelSpec, out: str = "treat") -> DataFrame:
    return df.withColumn(out, is_treated(sp.time, sp.cohort))


def event_time(df: DataFrame, sp: PanelSpec, out: str = "event") -> DataFrame:
    return df.withColumn(out, F.col(sp.time) - F.col(sp.cohort))


def ever_treated(df: DataFrame, sp: PanelSpec, out: str = "ever_treated") -> DataFrame:
    return df.withColumn(out, F.col(sp.cohort).isNotNull().cast("int"))


def its_clocks(df: DataFrame, sp: PanelSpec, start: int) -> DataFrame:
    """Clocks of a segmented model: periods since the start, since the intervention, and the
    latter only while treated."""
    t, g = F.col(sp.time), F.col(sp.cohort)
    return df.withColumns({
        "year0": t - F.lit(start),
        "yearc": t - g,
        "treat": is_treated(sp.time, sp.cohort),
        "since": is_treated(sp.time, sp.cohort) * F.coalesce(t - g, F.lit(0)),
    })


def cum_within(df: DataFrame, unit: str, time: str, column: str, out: str) -> DataFrame:
    """Running sum in time order within a unit."""
    w = Window.partitionBy(unit).orderBy(time).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.sum(column).over(w))


def effect_size(cohort: str, mu: Mapping[int, float]) -> Column:
    out = None
    for g, m in mu.items():
        cond = F.col(cohort) == F.lit(g)
        out = F.when(cond, F.lit(float(m))) if out is None else out.when(cond, F.lit(float(m)))
    return F.coalesce(out, F.lit(0.0))


def inject_effect(df: DataFrame, sp: PanelSpec, mu: Mapping[int, float], y_in: str) -> DataFrame:
    """Add a known effect to an outcome: ``mu`` of the cohort for every treated period so far.
    Makes ``treat``, ``tau``, ``tau_cum`` and the outcome ``sp.y``."""
    df = treat_flag(df, sp)
    df = df.withColumn("tau", F.when(F.col("treat") == 1, effect_size(sp.cohort, mu)).otherwise(F.lit(0.0)))
    df = cum_within(df, sp.unit, sp.time, "tau", "tau_cum")
    return df.withColumn(sp.y, F.col(y_in) + F.col("tau_cum"))


def perturb_trend(df: DataFrame, y: str, cond: Column, shift: Column, out: str | None = None) -> DataFrame:
    """Add ``shift`` to the outcome where ``cond`` holds."""
    return df.withColumn(out or y, F.col(y) + F.when(cond, shift).otherwise(F.lit(0.0)))


def dummies(df: DataFrame, column: str, values: Sequence, prefix: str | None = None) -> DataFrame:
    """One 0/1 column per value; the source column is kept."""
    prefix = f"{column}_" if prefix is None else prefix
    return df.withColumns({
        f"{prefix}{str(v).replace('-', 'm')}": indicator(column, v) for v in values})


def log_outcome(df: DataFrame, y: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or f"log_{y}", safe_log(y))


def dose_post(df: DataFrame, sp: PanelSpec, out: str = "dose_post") -> DataFrame:
    return df.withColumn(out, F.col(sp.dose) * F.col(sp.time))


def apply_dose_fn(df: DataFrame, dose: str, fn: DoseFn, out: str = "tau") -> DataFrame:
    return df.withColumn(out, fn(F.col(dose)))


def overlap_window(df: DataFrame, lo: int, hi: int, clock: str = "event") -> DataFrame:
    return df.filter(F.col(clock).between(lo, hi))


def common_support(df: DataFrame, sp: PanelSpec) -> DataFrame:
    """Largest window of event time that every cohort covers; one row (lo, hi)."""
    e = F.col(sp.time) - F.col(sp.cohort)
    return (df.filter(F.col(sp.cohort).isNotNull()).groupBy(sp.cohort)
            .agg(F.min(e).alias("_lo"), F.max(e).alias("_hi"))
            .agg(F.max("_lo").alias("lo"), F.min("_hi").alias("hi")))


def two_period_delta(df: DataFrame, unit: str, period: str, y: str, keep: Sequence[str] = ()) -> DataFrame:
    """Wide two-period table with the change of the outcome. Units seen in one period only drop out."""
    return (df.groupBy(unit, *keep).pivot(period, [0, 1]).agg(F.first(y))
            .withColumnsRenamed({"0": "y0", "1": "y1"})
            .filter(F.col("y0").isNotNull() & F.col("y1").isNotNull())
            .withColumn("delta_y", F.col("y1") - F.col("y0")))


def first_diff(df: DataFrame, unit: str, time: str, columns: Mapping[str, str],
               lagged: Mapping[str, str] | None = None) -> DataFrame:
    """Change against the period just before (``columns``: source to output name) and lagged levels.
    A row whose previous period is missing has no difference and is dropped."""
    w = Window.partitionBy(unit).orderBy(time)
    made = {o: F.col(c) - F.lag(c).over(w) for c, o in columns.items()}
    made |= {o: F.lag(c).over(w) for c, o in (lagged or {}).items()}
    made["_gap"] = F.col(time) - F.lag(time).over(w)
    return df.withColumns(made).filter(F.col("_gap") == 1).drop("_gap")


def to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "name",
            value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def sample_rows(df: DataFrame, n: int, seed: int, key: Sequence[str]) -> DataFrame:
    """The n rows with the smallest digest of their key. Each task keeps its own n smallest."""
    return (df.withColumn("_h", digest(seed, *key)).orderBy("_h", *key).limit(n).drop("_h"))


def sort_panel(df: DataFrame, unit: str, time: str) -> DataFrame:
    return df.orderBy(unit, time)
