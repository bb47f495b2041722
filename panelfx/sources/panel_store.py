"""Reading and writing prepared panels and cell tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CELL_SCHEMA = "cohort_year int, year0 int, treat int, y double"


def read_cells(spark: SparkSession, path: str, schema: str = CELL_SCHEMA) -> DataFrame:
    """Cohort-by-period means from a CSV file with a header, with declared types."""
    return spark.read.schema(schema).option("mode", "FAILFAST").csv(path, header=True)


def write_cells(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_panel(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """Write a prepared panel as parquet. Partition by a low-cardinality role such as the period:
    rows are first gathered by that role, so that each task does not open a file per value, and
    split further by a hash of the other columns so that one period is not one task."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = df.hint("rebalance", *partition_by).write.mode("overwrite").partitionBy(*partition_by)
    writer.parquet(path)
    return path


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write an expensive result to ``path`` and go on from the files."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def outcome_cells(df: DataFrame, unit: str, time: str, aggs: dict[str, Column]) -> DataFrame:
    """Raw fact rows to one row per (unit, time). Partial sums are made before the shuffle, so a unit
    that owns a large share of the rows sends at most one row per task and period."""
    return df.groupBy(unit, time).agg(*[c.alias(n) for n, c in aggs.items()])


def between_dates(ts: str, lo: str, hi: str) -> Column:
    """Half-open date range on the raw column, which the parquet reader can use to skip row groups."""
    kind = "timestamp_ntz"
    return (F.col(ts) >= F.lit(lo).cast(kind)) & (F.col(ts) < F.lit(hi).cast(kind))
