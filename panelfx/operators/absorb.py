"""Removing fixed effects."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stage import drop_stage, stage
from .gram import gram


def _mean(c: str, weight: str | None) -> Column:
    return F.sum(F.col(c) * F.col(weight)) / F.sum(weight) if weight else F.avg(c)


def center_by_window(df: DataFrame, columns: Sequence[str], key: str, weight: str | None = None) -> DataFrame:
    """Subtract the mean within ``key``. For keys with at most one row per period, such as units or cells."""
    w = Window.partitionBy(key)
    means = {f"_m_{c}": (F.sum(F.col(c) * F.col(weight)).over(w) / F.sum(weight).over(w)) if weight
             else F.avg(c).over(w) for c in columns}
    out = df.withColumns(means).withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in columns})
    return out.drop(*means)


def center_by_map(df: DataFrame, columns: Sequence[str], key: str, weight: str | None = None,
                  complete: tuple[Column, Column] | None = None) -> DataFrame:
    """The same for a short key such as the period, whose groups are far too large for a window.

    The means become one map, read through a scalar subquery: the rows are neither shuffled nor joined,
    and both branches share the exchange below them. The map has one entry per distinct key.
    ``complete``: the values a row's unit has, and whether its weights agree; the query stops unless the
    first equals the number of keys and the second holds.
    """
    means = df.groupBy(F.col(key).alias("_k")).agg(*[_mean(c, weight).alias(c) for c in columns])
    table = means.filter(F.col("_k").isNotNull()).agg(F.map_from_entries(F.collect_list(
        F.struct(F.col("_k"), F.struct(*columns)))).alias("m"))
    mean = F.try_element_at(F.col("_table"), F.col(key))
    if complete is not None:
        stop = F.raise_error(F.lit("the panel is not balanced; use absorb_unbalanced or ols with absorb"))
        mean = F.when((complete[0] == F.size("_table")) & complete[1], mean).otherwise(stop.cast("struct<" + ",".join(
            f"{c}:double" for c in columns) + ">"))
    out = df.withColumn("_table", table.scalar()).withColumn("_mean", mean).drop("_table")
    return out.withColumns({c: F.col(c) - F.col("_mean")[c] for c in columns}).drop("_mean")


def absorb_balanced(df: DataFrame, columns: Sequence[str], unit: str, time: str,
                    weight: str | None = None) -> DataFrame:
    """Two-way residuals of a balanced panel: x - mean by unit - mean by period + mean.

    Centering by the two keys in turn gives exactly this when every unit has every period and, with
    weights, when the weight of a unit is the same in all periods. A panel where a unit has fewer values
    than there are periods, or weights that vary, stops the query. ``time`` is the short dimension.
    """
    w = Window.partitionBy(unit)
    seen = F.least(*[F.count(c).over(w) for c in columns], F.count(F.lit(1)).over(w))
    even = (F.max(weight).over(w) - F.min(weight).over(w) <= F.abs(F.max(weight).over(w)) * 1e-9) if weight else F.lit(True)
    inner = center_by_window(df.withColumns({"_seen": seen, "_even": even}), columns, unit, weight)
    return center_by_map(inner, columns, time, weight, complete=(F.col("_seen"), F.col("_even"))).drop("_seen", "_even")


def time_effects(df: DataFrame, columns: Sequence[str], unit: str, time: str, times: Sequence[int],
                 weight: str | None = None) -> np.ndarray:
    """Period effects of a two-way model on an unbalanced panel, one row per period (first period 0).

    Unit effects drop out by centering within the unit; what is left are normal equations whose size is
    the number of periods, so no iteration over the data is needed.
    """
    levels = list(times)[1:]
    names = [f"_d{i}" for i in range(len(levels))]
    needed = [*columns, *([weight] if weight else [])]
    known = df.dropna(subset=needed).filter(F.col(time).isin([*times]))
    wide = known.select(unit, *needed,
                     *[F.when(F.col(time) == F.lit(t), 1.0).otherwise(0.0).alias(n)
                       for t, n in zip(levels, names)])
    centered = center_by_window(wide, [*columns, *names], unit, weight)
    m = gram(centered, [*names, *columns], weight)
    k = len(names)
    beta = np.linalg.lstsq(m[:k, :k], m[:k, k:], rcond=None)[0]
    return np.vstack([np.zeros(len(columns)), beta])


def lookup(column: str, keys: Sequence[int], values: Sequence[float]) -> Column:
    """Value by key from a literal map; the keys are the periods of the panel."""
    m = F.create_map(*[F.lit(x) for k, v in zip(keys, values) for x in (k, float(v))])
    return F.try_element_at(m, F.col(column))


def absorb_unbalanced(df: DataFrame, columns: Sequence[str], unit: str, time: str,
                      times: Sequence[int]) -> DataFrame:
    """Two-way residuals when cells are missing; ``time`` is the short dimension. Rows with a NULL in one of
    ``columns`` or a period not in ``times`` are left out."""
    df = df.dropna(subset=list(columns)).filter(F.col(time).isin([*times]))
    lam = time_effects(df, columns, unit, time, times)
    out = df.withColumns({c: F.col(c) - lookup(time, times, lam[:, i]) for i, c in enumerate(columns)})
    return center_by_window(out, columns, unit)


def absorb_iterative(df: DataFrame, columns: Sequence[str], keys: Sequence[str], tol: float = 1e-10,
                     max_iter: int = 500, check_every: int = 4) -> DataFrame:
    """Residuals for any number of long fixed effects, by updating the effects of each key in turn.

    The rows are written once and never rewritten. An update is one aggregate over the rows joined with
    the current effects of the other keys; the new effects are written out, so every plan is short, the
    size of each effect table is known when the join is planned, and a lost executor costs a re-read.
    The stop rule is the largest change of an effect relative to the spread of its column.
    """
    rows = stage(df, "rows")
    scale = rows.agg(*[F.stddev_pop(c) for c in columns]).first()
    limit = [tol * (s or 1.0) for s in scale]
    effects: dict[str, DataFrame] = {}

    def net_of(keys_used: Sequence[str]) -> DataFrame:
        out = rows
        for key in keys_used:
            i = keys.index(key)
            out = out.join(effects[key], F.col(key).eqNullSafe(F.col(f"_k{i}")), "left")
            out = out.withColumns({c: F.col(c) - F.col(f"_e{i}_{c}") for c in columns}).drop(
                f"_k{i}", *[f"_e{i}_{c}" for c in columns])
        return out

    for it in range(1, max_iter + 1):
        before = effects.get(keys[-1])
        for i, key in enumerate(keys):
            others = [k for k in keys if k != key and k in effects]
            old = effects.get(key)
            effects[key] = stage(net_of(others).groupBy(F.col(key).alias(f"_k{i}")).agg(
                *[F.avg(c).alias(f"_e{i}_{c}") for c in columns]), "effects")
            if old is not None and old is not before:
                drop_stage(old)
        if it % check_every == 0:
            i = len(keys) - 1
            was = before.withColumnsRenamed({f"_e{i}_{c}": f"_was_{c}" for c in columns}).withColumnRenamed(
                f"_k{i}", "_was")
            moved = effects[keys[-1]].join(was, F.col(f"_k{i}").eqNullSafe(F.col("_was"))).agg(
                *[F.max(F.abs(F.col(f"_e{i}_{c}") - F.col(f"_was_{c}"))) for c in columns]).first()
            if all(v <= lim for v, lim in zip(moved, limit)):
                return net_of(keys)
        if before is not None:
            drop_stage(before)
    raise RuntimeError(f"fixed effects did not converge in {max_iter} rounds")


# --------------------------------------------------------------------------- two long dimensions


def key_links(df: DataFrame, columns: Sequence[str], a: str, b: str, weight: str | None = None) -> DataFrame:
    """One row per pair of levels that occurs: ``_a``, ``_b``, the weight ``_w`` and the weighted sums of the columns."""
    w = F.col(weight) if weight else F.lit(1.0)
    return stage(df.groupBy(F.col(a).alias("_a"), F.col(b).alias("_b")).agg(
        F.sum(w).alias("_w"), *[F.sum(w * F.col(c)).alias(f"_s_{c}") for c in columns]), "links")


def _joined(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Join on a key whose NULL is a level of its own."""
    return left.join(right.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def effect_components(links: DataFrame, max_rounds: int = 1000) -> tuple[int, int]:
    """Number of connected components of the graph that links the levels of both keys, and the rank of the two effects
    together: levels of both minus components. Effects are comparable inside a component only.

    Labels start as the levels of one key and spread as minima over the pairs until none changes.
    """
    labels = stage(links.select("_b", F.struct("_b").alias("l")).distinct(), "labels")
    for _ in range(max_rounds):
        over = _joined(links.select("_a", "_b"), labels, "_b").groupBy("_a").agg(F.min("l").alias("l"))
        spread = _joined(links.select("_a", "_b"), over, "_a").groupBy("_b").agg(F.min("l").alias("_new"))
        both = stage(_joined(labels, spread, "_b"), "labels")
        changed = both.filter(F.col("l") != F.col("_new")).limit(1).count()
        drop_stage(labels)
        labels = both.select("_b", F.col("_new").alias("l"))
        if not changed:
            n = labels.select("l").distinct().count()
            levels = labels.count() + links.select("_a").distinct().count()
            return n, levels - n
    raise RuntimeError(f"labels still change after {max_rounds} rounds")


def two_way_effects(links: DataFrame, columns: Sequence[str], tol: float = 1e-11, max_rounds: int = 200) -> tuple[DataFrame, DataFrame, int]:
    """Effects of both keys (``_a`` and ``_b`` with one column each), and how many rounds they took.

    The effects of the first key are eliminated, which leaves a system in those of the second. It is solved by conjugate
    gradients, preconditioned with the weights of the levels: all columns go along, each with steps of its own. A round is
    two aggregates over the pairs of levels, joined with one table of a key's size; what a round has replaced is removed.
    A column is done when its gradient is ``tol`` of its own size. Where the graph of the levels is not connected the
    effects are those that conjugate gradients reach from zero; the residuals are unique all the same.
    """
    s = {c: F.col(f"_s_{c}") for c in columns}
    size = lambda key: links.groupBy(key).agg(F.sum("_w").alias("_n"), *[F.sum(v).alias(f"_s_{c}") for c, v in s.items()])
    first = stage(size("_a"), "first")
    mean = first.select("_a", *[(v / F.col("_n")).alias(f"_m_{c}") for c, v in s.items()])
    explained = _joined(links.select("_a", "_b", "_w"), mean, "_a").groupBy("_b").agg(
        *[F.sum(F.col("_w") * F.col(f"_m_{c}")).alias(f"_e_{c}") for c in columns])
    start = _joined(size("_b"), explained, "_b").select("_b", "_n", *[
        x for c in columns for x in (F.lit(0.0).alias(f"_x_{c}"), (F.col(f"_s_{c}") - F.col(f"_e_{c}")).alias(f"_r_{c}"),
                                     ((F.col(f"_s_{c}") - F.col(f"_e_{c}")) / F.col("_n")).alias(f"_p_{c}"))])
    state = stage(start, "state")
    row = state.agg(*[F.sum(F.col(f"_r_{c}") * F.col(f"_r_{c}") / F.col("_n")).alias(c) for c in columns]).first()
    scale = links.agg(*[F.sum(v * v / F.col("_w")).alias(c) for c, v in s.items()]).first()
    rz = {c: row[c] or 0.0 for c in columns}
    limit = {c: tol * tol * (scale[c] or 0.0) for c in columns}
    rounds = 0
    while any(rz[c] > limit[c] for c in columns):
        if rounds == max_rounds:
            raise RuntimeError(f"fixed effects did not converge in {max_rounds} rounds")
        rounds += 1
        toward = _joined(links.select("_a", "_b", "_w"), state.select("_b", *[f"_p_{c}" for c in columns]), "_b")
        mean = stage(toward.groupBy("_a").agg(*[(F.sum(F.col("_w") * F.col(f"_p_{c}")) / F.sum("_w")).alias(f"_m_{c}") for c in columns]), "means")
        back = _joined(links.select("_a", "_b", "_w"), mean, "_a").groupBy("_b").agg(
            *[F.sum(F.col("_w") * F.col(f"_m_{c}")).alias(f"_q_{c}") for c in columns])
        full = _joined(state, back, "_b").withColumns({f"_q_{c}": F.col("_n") * F.col(f"_p_{c}") - F.col(f"_q_{c}") for c in columns})
        full = stage(full, "state")
        bend = full.agg(*[F.sum(F.col(f"_p_{c}") * F.col(f"_q_{c}")).alias(c) for c in columns]).first()
        step = {c: rz[c] / bend[c] if rz[c] > limit[c] and bend[c] > 0 else 0.0 for c in columns}
        left = {c: F.col(f"_r_{c}") - F.lit(step[c]) * F.col(f"_q_{c}") for c in columns}
        now = full.agg(*[F.sum(r * r / F.col("_n")).alias(c) for c, r in left.items()]).first()
        # a column that has no direction left has come as far as it can
        turn = {c: now[c] / rz[c] if step[c] else 0.0 for c in columns}
        rz = {c: now[c] if step[c] else 0.0 for c in columns}
        drop_stage(state)
        drop_stage(mean)
        state = full.select("_b", "_n", *[x for c in columns for x in (
            (F.col(f"_x_{c}") + F.lit(step[c]) * F.col(f"_p_{c}")).alias(f"_x_{c}"), left[c].alias(f"_r_{c}"),
            (left[c] / F.col("_n") + F.lit(turn[c]) * F.col(f"_p_{c}")).alias(f"_p_{c}"))])
    second = stage(state.select("_b", *[F.col(f"_x_{c}").alias(c) for c in columns]), "second")
    taken = _joined(links.select("_a", "_b", "_w"), second, "_b").groupBy("_a").agg(*[F.sum(F.col("_w") * F.col(c)).alias(f"_t_{c}") for c in columns])
    own = _joined(first, taken, "_a").select("_a", *[((F.col(f"_s_{c}") - F.col(f"_t_{c}")) / F.col("_n")).alias(c) for c in columns])
    return stage(own, "first"), second, rounds


def absorb_gradient(df: DataFrame, columns: Sequence[str], a: str, b: str, weight: str | None = None, tol: float = 1e-11,
                    max_rounds: int = 200) -> DataFrame:
    """Residuals of two long fixed effects, neither of which fits the driver or a window (see ``two_way_effects``).

    Rows with a NULL in one of the columns or in the weight are left out; a NULL key is a level. Rows of a pair of levels
    are added up first, so the rounds read pairs and not rows.
    """
    rows = stage(df.dropna(subset=[*columns, *([weight] if weight else [])]), "rows")
    own, other, _ = two_way_effects(key_links(rows, columns, a, b, weight), columns, tol, max_rounds)
    out = rows
    for key, name, table in ((a, "_a", own), (b, "_b", other)):
        table = table.select(F.col(name).alias("_level"), *[F.col(c).alias(f"_fx_{c}") for c in columns])
        out = out.join(table, F.col(key).eqNullSafe(F.col("_level")))
        out = out.withColumns({c: F.col(c) - F.col(f"_fx_{c}") for c in columns}).drop("_level", *[f"_fx_{c}" for c in columns])
    return out


def absorb_exact(df: DataFrame, columns: Sequence[str], unit: str, time: str, times: Sequence[int]) -> DataFrame:
    """Two-way residuals of the rows without a NULL in ``columns``. One aggregate tells whether every unit has
    the same periods; if not, the period effects come from normal equations."""
    known = df.dropna(subset=list(columns)).filter(F.col(time).isin([*times]))
    sizes = known.groupBy(unit).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n"), F.max("n")).first()
    periods = known.select(time).distinct().count()
    if sizes[0] == sizes[1] == periods:
        return absorb_balanced(known, columns, unit, time)
    return absorb_unbalanced(known, columns, unit, time, times)


def absorb(df: DataFrame, columns: Sequence[str], unit: str, time: str, times: Sequence[int] | None = None,
           method: str = "balanced", **options) -> DataFrame:
    if method == "balanced":
        return absorb_balanced(df, columns, unit, time, **options)
    if method == "unbalanced":
        return absorb_unbalanced(df, columns, unit, time, times)
    if method == "gradient":
        return absorb_gradient(df, columns, unit, time, **options)
    return absorb_iterative(df, columns, [unit, time], **options)
