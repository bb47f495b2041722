"""Panels the registered queries run on, built from the given tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.panel import balanced_panel, inject_effect
from ..spec import PanelSpec

# All periods that occur in the given tables; a row of any other period stops the query.
YEARS = tuple(range(1995, 2002))
QUARTERS = tuple(range(28))
STAGGERED = PanelSpec(unit="unit", time="year", y="y", cluster="cluster", cohort="cohort", treat="treat",
                      times=YEARS, cohorts=(1997, 1999))
STAGGERED_MU = {1997: 2.0, 1999: 1.0}
ALWAYS_ON = PanelSpec(unit="unit", time="t", y="y", cluster="cluster", dose="dose", times=QUARTERS)
ITS = PanelSpec(unit="unit", time="t", y="y", cluster="cluster", cohort="cohort", treat="treat",
                times=QUARTERS, cohorts=(9, 14))
TWO_PERIOD = PanelSpec(unit="unit", time="period", y="y", dose="dose", times=(0, 1))

# Money is scaled to values near 1. Primes rather than powers of ten: amounts in cents divided by a power
# of ten often lie exactly between two rounded values, where engines that sum in another order differ.
FIRST_DAY = "2024-01-01"
ORDER_UNIT = 97531.0
LINE_UNIT = 997.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _listed(period: Column, periods: Sequence[int]) -> Column:
    stop = F.raise_error(F.concat(F.lit("no such period in the panel: "), period.cast("string")))
    return F.when(period.isNull() | period.between(periods[0], periods[-1]), period).otherwise(stop.cast("int"))


def yearly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "orders")
            .select(F.col("o_custkey").alias("unit"), _listed(F.year("o_orderdate"), YEARS).alias("year"),
                    (F.col("o_totalprice") / F.lit(ORDER_UNIT)).alias("amount")))


def staggered_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by year with the cohort of their nation and the untreated outcome ``y0``."""
    units = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("unit"), F.col("c_nationkey").alias("cluster"),
        F.when(F.col("c_nationkey") % 3 == 0, F.lit(1997))
        .when(F.col("c_nationkey") % 3 == 1, F.lit(1999)).alias("cohort"))
    return balanced_panel(units, yearly_orders(spark, sf_dir), "unit", "year", STAGGERED.times,
                          {"y0": F.sum}, {"y0": F.col("amount")})


def staggered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a known effect added: 2 a year for cohort 1997, 1 a year for cohort 1999."""
    return inject_effect(staggered_base(spark, sf_dir), STAGGERED, STAGGERED_MU, "y0")


def two_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with orders up to 1997 (period 0) and from 1998 on (period 1); the dose is the balance."""
    dose = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("unit"), F.col("c_nationkey").alias("cluster"),
        (F.greatest("c_acctbal", F.lit(0.0)) / F.lit(1000.0)).alias("dose"))
    y = (yearly_orders(spark, sf_dir)
         .groupBy("unit", (F.col("year") >= 1998).cast("int").alias("period")).agg(F.sum("amount").alias("y")))
    return y.join(dose, "unit")


def always_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by quarter: mean quantity as dose, mean discount as control, mean price as outcome."""
    units = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("unit"), F.col("s_nationkey").alias("cluster"))
    lines = (table(spark, sf_dir, "lineitem")
             .select(F.col("l_suppkey").alias("unit"),
                     _listed((F.year("l_shipdate") - YEARS[0]) * 4 + F.quarter("l_shipdate") - 1, QUARTERS).alias("t"),
                     F.col("l_quantity").alias("q"), (F.col("l_discount") * F.lit(100.0)).alias("c"),
                     (F.col("l_extendedprice") / F.lit(LINE_UNIT)).alias("p")))
    return balanced_panel(units, lines, "unit", "t", ALWAYS_ON.times,
                          {"dose": F.avg, "control": F.avg, "y": F.avg},
                          {"dose": F.col("q"), "control": F.col("c"), "y": F.col("p")}, fill=None)


def its_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by quarter, all treated at quarter 9 or 14, with a level shift and a slope added."""
    df = always_on(spark, sf_dir).withColumn(
        "cohort", F.when(F.col("cluster") % 2 == 0, F.lit(9)).otherwise(F.lit(14)))
    since = F.greatest(F.col("t") - F.col("cohort"), F.lit(0))
    treat = (F.col("t") >= F.col("cohort")).cast("int")
    big = F.col("cohort") == 14
    return df.select(
        "unit", "cluster", "t", "cohort", treat.alias("treat"), F.col("t").alias("year0"),
        (F.col("t") - F.col("cohort")).alias("yearc"), since.alias("since"),
        big.cast("int").alias("cohort_14"),
        F.when(treat == 1, F.when(big, F.lit(4.0)).otherwise(F.lit(1.0))).otherwise(F.lit(0.0)).alias("tau"),
        (F.col("y") + treat * F.when(big, F.lit(3.0)).otherwise(F.lit(2.0))
         + since * F.when(big, F.lit(1.0)).otherwise(F.lit(0.25))).alias("y"))


def daily_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by day, numbered from 1; days without events are absent (an unbalanced panel)."""
    return (table(spark, sf_dir, "events")
            .groupBy(F.col("user_id").alias("unit"), (F.datediff("ts", F.lit(FIRST_DAY)) + 1).alias("t"))
            .agg(F.sum("value").alias("y"), F.count(F.lit(1)).cast("double").alias("x")))
