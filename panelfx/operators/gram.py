"""Cross-product matrices as distributed sums."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Up to this many columns the products are plain SQL sums; beyond it the generated method outgrows what the
# JVM compiles, and each task makes its partial matrix with one matrix product per Arrow batch instead.
SQL_COLUMNS = 8


def _upper(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def _full(values: Sequence[float], k: int) -> np.ndarray:
    m = np.zeros((k, k))
    for (i, j), v in zip(_upper(k), values):
        m[i, j] = m[j, i] = v or 0.0
    return m


def product_sums(columns: Sequence[str], weight: str | Column | None = None) -> list[Column]:
    w = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight)
    return [F.sum(w * F.col(columns[i]) * F.col(columns[j])) for i, j in _upper(len(columns))]


def gram(df: DataFrame, columns: Sequence[str], weight: str | None = None) -> np.ndarray:
    """Sum over rows of w * v v' for the vector v of the given columns (all double, no NULL)."""
    k = len(columns)
    if k <= SQL_COLUMNS:
        row = df.agg(*[c.alias(f"m{i}") for i, c in enumerate(product_sums(columns, weight))]).first()
        return _full(list(row), k)
    return sum_partials(df.select(*columns, *([weight] if weight else [])), _partial_gram(list(columns), weight),
                        ).reshape(k, k)


def _partial_gram(columns: list[str], weight: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for b in batches:
            x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in columns])
            wx = x * b.column(weight).to_numpy(zero_copy_only=False)[:, None] if weight else x
            part = x.T @ wx
            total = part if total is None else total + part
        return None if total is None else total.ravel()
    return run


def partial_sums(df: DataFrame, fn) -> DataFrame:
    """Run ``fn(batches) -> vector`` in every task and add the vectors up by position: rows (i, x).

    One vector leaves each task and the sum by position is an ordinary aggregate.
    """
    def partial(batches):
        v = fn(batches)
        if v is not None:
            yield pa.RecordBatch.from_pydict({"v": pa.array([v.tolist()], pa.list_(pa.float64()))})

    return (df.mapInArrow(partial, "v array<double>").select(F.posexplode("v").alias("i", "x"))
            .groupBy("i").agg(F.sum("x").alias("x")))


def sum_partials(df: DataFrame, fn) -> np.ndarray:
    """The same vector on the driver, for results of the size of a model."""
    rows = partial_sums(df, fn).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r["i"]] = r["x"]
    return out


def grouped_gram(df: DataFrame, by: str, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """One k x k matrix per group, as a flat array column ``g`` (row major, upper triangle).

    Sums are merged before the shuffle, so a group that owns most rows is no hot spot.
    """
    return df.groupBy(by).agg(F.array(*product_sums(columns, weight)).alias("g"))


def unpack(values: Sequence[float], k: int) -> np.ndarray:
    return _full(values, k)


def independent(m: np.ndarray, tol: float = 1e-9) -> list[int]:
    """Indices of columns that are not linear combinations of earlier ones, by sweeping the Gram matrix."""
    a = m.astype(float).copy()
    kept = []
    for j in range(len(a)):
        if m[j, j] > 0 and a[j, j] > tol * m[j, j]:
            col = a[:, j].copy()
            a -= np.outer(col, col) / col[j]
            kept.append(j)
    return kept
