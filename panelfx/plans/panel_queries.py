"""Queries for storage, panel construction and description."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import describe as ds
from ..operators import panel as pn
from ..sources import panel_store as st
from . import fixtures as fx
from .registry import query
from .sqltext import FX1, FX2, FX3, FX3D, FX4, FX5
from .stage import checkpoint_root, stage

SP = fx.STAGGERED


def _path(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_root(spark)}/panelfx/{label}-{uuid.uuid4().hex}"


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("unit"), F.col("c_nationkey").alias("cluster"))


# --------------------------------------------------------------------------- storage

@query("s1_read_cells", f"""WITH {FX1}
--result
SELECT cohort AS cohort_year, CAST(year - 1995 AS INTEGER) AS year0, treat, avg(y) AS y FROM fx1 WHERE cohort IS NOT NULL GROUP BY ALL""", "y")
def s1(spark, sf):
    cells = (fx.staggered(spark, sf).filter(F.col("cohort").isNotNull())
             .groupBy(F.col("cohort").alias("cohort_year"), (F.col("year") - 1995).alias("year0"), "treat")
             .agg(F.avg("y").alias("y")))
    path = _path(spark, "cells-csv")
    st.write_cells(cells, path)
    return st.read_cells(spark, path)


@query("s2_write_panel", f"""WITH {FX1}
--result
SELECT year, count(*) AS n, sum(y) AS y FROM fx1 GROUP BY year""", "y")
def s2(spark, sf):
    path = st.write_panel(fx.staggered(spark, sf), _path(spark, "panel"), partition_by=["year"])
    return st.read_panel(spark, path).groupBy("year").agg(F.count("*").alias("n"), F.sum("y").alias("y"))


@query("s3_read_panel", f"""WITH {FX1}
--result
SELECT unit, y FROM fx1 WHERE year = 1999 AND cohort = 1997""", "y")
def s3(spark, sf):
    path = st.write_panel(fx.staggered(spark, sf), _path(spark, "panel"), partition_by=["year"])
    return st.read_panel(spark, path).filter("year = 1999 AND cohort = 1997").select("unit", "y")


@query("s4_outcome_cells", f"""WITH {FX1}
--result
SELECT unit, year, y0 AS y FROM fx1_out""", "y")
def s4(spark, sf):
    return st.outcome_cells(fx.yearly_orders(spark, sf), "unit", "year", {"y": F.sum("amount")})


@query("s5_materialize", f"""WITH {FX1}
--result
SELECT cluster, avg(y) AS y, count(*) AS n FROM fx1 GROUP BY cluster""", "y")
def s5(spark, sf):
    saved = st.materialize(fx.staggered(spark, sf), _path(spark, "saved"))
    return saved.groupBy("cluster").agg(F.avg("y").alias("y"), F.count("*").alias("n"))


# --------------------------------------------------------------------------- construction

@query("p1_skeleton", """
--result
SELECT c_custkey AS unit, CAST(year AS INTEGER) AS year, CAST(wave AS INTEGER) AS wave
FROM customer CROSS JOIN (SELECT unnest(range(1995, 2002)) AS year) CROSS JOIN (SELECT unnest(range(1, 3)) AS wave)""")
def p1(spark, sf):
    return pn.skeleton(_customers(spark, sf).select("unit"), year=SP.times, wave=[1, 2])


@query("p2_enrich", """
--result
SELECT c_custkey AS unit, c_nationkey AS cluster, n_name, n_regionkey, r_name
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def p2(spark, sf):
    nation = fx.table(spark, sf, "nation").withColumnRenamed("n_nationkey", "cluster")
    region = fx.table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    out = pn.enrich(pn.enrich(_customers(spark, sf), nation), region, on=["n_regionkey"])
    return out.select("unit", "cluster", "n_name", "n_regionkey", "r_name")


@query("p3_fill_cells", f"""WITH {FX1}
--result
SELECT unit, year, y0 AS y FROM fx1_base""", "y")
def p3(spark, sf):
    cells = st.outcome_cells(fx.yearly_orders(spark, sf), "unit", "year", {"y": F.sum("amount")})
    grid = pn.skeleton(_customers(spark, sf).select("unit"), year=SP.times)
    return pn.fill_cells(pn.enrich(grid, cells), "y")


@query("p4_assign_cohort", """
--result
SELECT c_custkey AS unit, c_nationkey AS cluster,
  CAST(CASE c_nationkey % 3 WHEN 0 THEN 1997 WHEN 1 THEN 1999 END AS INTEGER) AS cohort,
  CAST(CASE WHEN c_nationkey < 10 THEN 1996 WHEN c_nationkey < 20 THEN 1998 END AS INTEGER) AS cohort_values
FROM customer""")
def p4(spark, sf):
    mapping = fx.table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("cluster"), (1997 + 2 * (F.col("n_nationkey") % 3)).cast("int").alias("first"))
    out = pn.assign_cohort(_customers(spark, sf), mapping, "cluster", never=2001)
    values = {c: 1996 for c in range(10)} | {c: 1998 for c in range(10, 20)}
    return pn.assign_cohort(out, values, "cluster", out="cohort_values").select(
        "unit", "cluster", "cohort", "cohort_values")


@query("p5_permute_cohorts", """
WITH reps AS (SELECT unnest(range(1, 21)) AS rep),
ranked AS (SELECT CAST(rep AS INTEGER) AS rep, s_suppkey AS cluster,
    row_number() OVER (PARTITION BY rep ORDER BY md5(concat_ws('|', '7', rep, s_suppkey))) AS slot,
    count(*) OVER (PARTITION BY rep) AS n FROM supplier CROSS JOIN reps)
--result
SELECT rep, cluster, CAST(CASE WHEN slot <= n // 3 THEN 1997 WHEN slot <= 2 * (n // 3) THEN 1999 END AS INTEGER) AS cohort FROM ranked""")
def p5(spark, sf):
    ids = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("cluster"))
    n = ids.count()
    sizes = {1997: n // 3, 1999: n // 3, None: n - 2 * (n // 3)}
    reps = ids.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(20))))
    return pn.permute_cohorts(reps, "cluster", sizes, 7, rep="rep").select("rep", "cluster", "cohort")


@query("p6_block_id", """
--result
SELECT c_custkey AS unit, CAST(floor((c_custkey - 1) / CAST(50 AS DOUBLE)) + 1 AS BIGINT) AS country FROM customer""")
def p6(spark, sf):
    return pn.with_block_id(_customers(spark, sf).select("unit"), "unit", 50, "country")


@query("p7_relabel_never", """
--result
SELECT c_custkey AS unit, CAST(CASE WHEN c_nationkey % 3 = 2 THEN NULL ELSE 1997 + 2 * (c_nationkey % 3) END AS INTEGER) AS cohort FROM customer""")
def p7(spark, sf):
    df = _customers(spark, sf).select("unit", (1997 + 2 * (F.col("cluster") % 3)).cast("int").alias("cohort"))
    return pn.relabel_never(df, "cohort", 2001)


@query("p8_treat_flag", f"""WITH {FX1}
--result
SELECT unit, year, treat FROM fx1""")
def p8(spark, sf):
    return pn.treat_flag(fx.staggered_base(spark, sf), SP).select("unit", "year", "treat")


@query("p9_event_time", f"""WITH {FX1}
--result
SELECT unit, year, CAST(year - cohort AS INTEGER) AS event FROM fx1""")
def p9(spark, sf):
    return pn.event_time(fx.staggered_base(spark, sf), SP).select("unit", "year", "event")


@query("p10_its_clocks", f"""WITH {FX4}
--result
SELECT unit, t, CAST(year0 AS INTEGER) AS year0, CAST(yearc AS INTEGER) AS yearc, CAST(treat AS INTEGER) AS treat, CAST(since AS INTEGER) AS since FROM fx4""")
def p10(spark, sf):
    df = fx.its_panel(spark, sf).select("unit", "t", "cohort")
    return pn.its_clocks(df, fx.ITS, 0).select("unit", "t", "year0", "yearc", "treat", "since")


@query("p11_ever_treated", f"""WITH {FX1}
--result
SELECT unit, year, CASE WHEN cohort IS NOT NULL THEN 1 ELSE 0 END AS ever_treated FROM fx1""")
def p11(spark, sf):
    return pn.ever_treated(fx.staggered_base(spark, sf), SP).select("unit", "year", "ever_treated")


@query("p12_cum_within", f"""WITH {FX1}
--result
SELECT unit, year, sum(y0) OVER (PARTITION BY unit ORDER BY year) AS y_cum FROM fx1""", "y_cum")
def p12(spark, sf):
    return pn.cum_within(fx.staggered_base(spark, sf), "unit", "year", "y0", "y_cum").select("unit", "year", "y_cum")


@query("p13_inject_effect", f"""WITH {FX1}
--result
SELECT unit, cluster, cohort, year, treat, y0, tau, tau_cum, y FROM fx1""", "y0 tau tau_cum y")
def p13(spark, sf):
    return fx.staggered(spark, sf)


@query("p14_perturb_trend", f"""WITH {FX4}
--result
SELECT unit, t, y, y + CASE WHEN cohort = 14 AND t < 7 THEN CAST(0.5 AS DOUBLE) * (t - 7) ELSE CAST(0 AS DOUBLE) END AS y_new FROM fx4""", "y y_new")
def p14(spark, sf):
    cond = (F.col("cohort") == 14) & (F.col("t") < 7)
    return pn.perturb_trend(fx.its_panel(spark, sf), "y", cond, F.lit(0.5) * (F.col("t") - 7), "y_new").select(
        "unit", "t", "y", "y_new")


@query("p15_dummies", f"""WITH {FX1}
--result
SELECT unit, year, cohort, CASE WHEN cohort = 1997 THEN 1 ELSE 0 END AS cohort_1997, CASE WHEN cohort = 1999 THEN 1 ELSE 0 END AS cohort_1999,
 {", ".join(f"CASE WHEN year = {t} THEN 1 ELSE 0 END AS y{t}" for t in range(1995, 2002))} FROM fx1""")
def p15(spark, sf):
    df = pn.dummies(fx.staggered_base(spark, sf), "cohort", SP.cohorts)
    return pn.dummies(df, "year", SP.times, "y").drop("y0", "cluster")


@query("p16_log_outcome", f"""WITH {FX1}
--result
SELECT unit, year, CASE WHEN y > 0 THEN ln(y) END AS log_y FROM fx1""", "log_y")
def p16(spark, sf):
    return pn.log_outcome(fx.staggered(spark, sf), "y").select("unit", "year", "log_y")


@query("p17_dose_post", f"""WITH {FX2}
--result
SELECT unit, period, dose * period AS dose_post FROM fx2""", "dose_post")
def p17(spark, sf):
    return pn.dose_post(fx.two_period(spark, sf), fx.TWO_PERIOD).select("unit", "period", "dose_post")


@query("p18_dose_fn", f"""WITH {FX2}
--result
SELECT unit, dose, CAST(0.5 AS DOUBLE) * dose AS linear, 6 * (sqrt(dose / 5) - 1) AS concave, 20 * exp(-dose / 4) AS declining FROM fx2w""",
       "dose linear concave declining")
def p18(spark, sf):
    df = pn.two_period_delta(fx.two_period(spark, sf), "unit", "period", "y", ["dose"])
    for name, fn in DOSE_FNS.items():
        df = pn.apply_dose_fn(df, "dose", fn, name)
    return df.select("unit", "dose", *DOSE_FNS)


DOSE_FNS = {
    "linear": lambda d: F.lit(0.5) * d,
    "concave": lambda d: F.lit(6.0) * (F.sqrt(d / F.lit(5.0)) - F.lit(1.0)),
    "declining": lambda d: F.lit(20.0) * F.exp(-d / F.lit(4.0)),
}


@query("p19_subsets", f"""WITH {FX1}, e AS (SELECT *, year - cohort AS event FROM fx1)
--result
SELECT 'overlap' AS subset, count(*) AS n, sum(y) AS y FROM e WHERE event BETWEEN -2 AND 1
UNION ALL SELECT 'one cohort', count(*), sum(y) FROM e WHERE cohort = 1997
UNION ALL SELECT 'untreated', count(*), sum(y) FROM e WHERE treat = 0
UNION ALL SELECT 'untreated near', count(*), sum(y) FROM e WHERE treat = 0 AND event > -3
UNION ALL SELECT 'treated late', count(*), sum(y) FROM e WHERE treat = 1 AND year >= 1998""", "y")
def p19(spark, sf):
    df = pn.event_time(fx.staggered(spark, sf), SP)
    subsets = {
        "overlap": F.col("event").between(-2, 1), "one cohort": F.col("cohort") == 1997,
        "untreated": F.col("treat") == 0, "untreated near": (F.col("treat") == 0) & (F.col("event") > -3),
        "treated late": (F.col("treat") == 1) & (F.col("year") >= 1998)}
    # the subsets overlap: one pass with a conditional sum for each
    wide = df.agg(F.array(*[F.struct(F.lit(k).alias("subset"), F.count_if(c).alias("n"), F.sum(F.when(c, F.col("y"))).alias("y"))
                            for k, c in subsets.items()]).alias("a"))
    return wide.select(F.inline("a"))


@query("p19_overlap_window", f"""WITH {FX4}
--result
SELECT unit, t, CAST(yearc AS INTEGER) AS yearc, y FROM fx4 WHERE yearc BETWEEN -9 AND 5""", "y")
def p19w(spark, sf):
    return pn.overlap_window(fx.its_panel(spark, sf), -9, 5, "yearc").select("unit", "t", "yearc", "y")


@query("p20_common_support", f"""WITH {FX4}, s AS (SELECT cohort, min(yearc) AS lo, max(yearc) AS hi FROM fx4 GROUP BY cohort)
--result
SELECT CAST(max(lo) AS INTEGER) AS lo, CAST(min(hi) AS INTEGER) AS hi FROM s""")
def p20(spark, sf):
    return pn.common_support(fx.its_panel(spark, sf), fx.ITS)


@query("p21_select", f"""WITH {FX1}
--result
SELECT y, cluster, year, treat, cohort FROM fx1""", "y")
def p21(spark, sf):
    return fx.staggered(spark, sf).select("y", "cluster", "year", "treat", "cohort")


@query("p22_two_period_delta", f"""WITH {FX2}
--result
SELECT unit, dose, y0, y1, delta_y FROM fx2w""", "dose y0 y1 delta_y")
def p22(spark, sf):
    return pn.two_period_delta(fx.two_period(spark, sf), "unit", "period", "y", ["dose"])


@query("p23_first_diff", f"""WITH {FX5}, l AS (
  SELECT *, lag(t) OVER w AS tp, y - lag(y) OVER w AS d_y, lag(y) OVER w AS y_lag FROM fx5 WINDOW w AS (PARTITION BY unit ORDER BY t))
--result
SELECT unit, t, d_y, y_lag FROM l WHERE t - tp = 1""", "d_y y_lag")
def p23(spark, sf):
    return pn.first_diff(fx.daily_users(spark, sf), "unit", "t", {"y": "d_y"}, {"y": "y_lag"}).select(
        "unit", "t", "d_y", "y_lag")


@query("p24_to_long", f"""WITH {FX2}
--result
SELECT unit, 'y0' AS name, y0 AS value FROM fx2w UNION ALL SELECT unit, 'y1', y1 FROM fx2w UNION ALL SELECT unit, 'delta_y', delta_y FROM fx2w""", "value")
def p24(spark, sf):
    wide = pn.two_period_delta(fx.two_period(spark, sf), "unit", "period", "y")
    return pn.to_long(wide, ["unit"], ["y0", "y1", "delta_y"])


@query("p25_sample_rows", f"""WITH {FX3}
--result
SELECT unit, t, dose, y FROM fx3 ORDER BY md5(concat_ws('|', '11', unit, t)), unit, t LIMIT 10""", "dose y")
def p25(spark, sf):
    return pn.sample_rows(fx.always_on(spark, sf), 10, 11, ["unit", "t"]).select("unit", "t", "dose", "y")


@query("p26_sort", f"""WITH {FX3}
--result
SELECT unit, t, y FROM fx3 ORDER BY unit, t""", "y")
def p26(spark, sf):
    return pn.sort_panel(fx.always_on(spark, sf).select("unit", "t", "y"), "unit", "t")


# --------------------------------------------------------------------------- description

@query("a1_cohort_means", f"""WITH {FX1}
--result
SELECT cohort, year, avg(y) AS mean_y, count(*) AS n FROM fx1 GROUP BY cohort, year""", "mean_y")
def a1(spark, sf):
    return ds.cohort_means(fx.staggered(spark, sf), SP)


@query("a2_event_means", f"""WITH {FX4}
--result
SELECT CAST(cohort AS INTEGER) AS cohort, CAST(yearc AS INTEGER) AS yearc, avg(y) AS mean_y, count(*) AS n FROM fx4 WHERE yearc BETWEEN -9 AND 5 GROUP BY 1, 2""", "mean_y")
def a2(spark, sf):
    return ds.cohort_means(pn.overlap_window(fx.its_panel(spark, sf), -9, 5, "yearc"), fx.ITS, "yearc")


@query("a3_grand_means", f"""WITH {FX1}
--result
SELECT cohort, year, avg(y) AS mean_y, count(*) AS n, CAST(grouping(cohort) AS INTEGER) AS is_total
FROM fx1 GROUP BY GROUPING SETS ((cohort, year), (year))""", "mean_y")
def a3(spark, sf):
    return ds.grand_means(fx.staggered(spark, sf), SP)


@query("a3_event_grand_means", f"""WITH {FX4}
--result
SELECT CAST(cohort AS INTEGER) AS cohort, CAST(yearc AS INTEGER) AS yearc, avg(y) AS mean_y, count(*) AS n, CAST(grouping(cohort) AS INTEGER) AS is_total
FROM fx4 WHERE yearc BETWEEN -9 AND 5 GROUP BY GROUPING SETS ((cohort, yearc), (yearc))""", "mean_y")
def a3e(spark, sf):
    return ds.grand_means(pn.overlap_window(fx.its_panel(spark, sf), -9, 5, "yearc"), fx.ITS, "yearc")


@query("a4_treat_means", f"""WITH {FX1}
--result
SELECT year, treat, avg(y) AS mean_y, count(*) AS n FROM fx1 GROUP BY 1, 2""", "mean_y")
def a4(spark, sf):
    return ds.treat_means(fx.staggered(spark, sf), "y", "treat", "year")


@query("a4_treat_means_overall", f"""WITH {FX1}
--result
SELECT treat, avg(y) AS mean_y, count(*) AS n FROM fx1 GROUP BY 1""", "mean_y")
def a4o(spark, sf):
    return ds.treat_means(fx.staggered(spark, sf), "y", "treat")


@query("a5_true_effect_means", f"""WITH {FX4}
--result
SELECT CAST(cohort AS INTEGER) AS cohort, avg(tau) AS mean_effect, count(*) AS n FROM fx4 WHERE treat = 1 GROUP BY 1""", "mean_effect")
def a5(spark, sf):
    return ds.true_effect_means(fx.its_panel(spark, sf), "cohort", "treat", "tau")


@query("a6_histogram", f"""WITH {FX2}, s AS (SELECT min(dose) AS lo, max(dose) AS hi FROM fx2w),
b AS (SELECT CASE WHEN dose >= s.hi THEN 59 ELSE CAST(floor((dose - s.lo) / ((s.hi - s.lo) / CAST(60 AS DOUBLE))) AS INTEGER) END AS bin FROM fx2w, s),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
--result
SELECT CAST(i.bin AS INTEGER) AS bin, s.lo + i.bin * ((s.hi - s.lo) / CAST(60 AS DOUBLE)) AS lo,
  s.lo + (i.bin + 1) * ((s.hi - s.lo) / CAST(60 AS DOUBLE)) AS hi, coalesce(c.n, 0) AS n
FROM (SELECT unnest(range(60)) AS bin) i CROSS JOIN s LEFT JOIN c ON c.bin = i.bin""", "lo hi")
def a6(spark, sf):
    wide = pn.two_period_delta(fx.two_period(spark, sf), "unit", "period", "y", ["dose"])
    return ds.histogram(wide, "dose", 60)


@query("a7_summary_stats", """
--result
SELECT avg(l_extendedprice) AS mean, median(l_extendedprice) AS median, min(l_extendedprice) AS min, max(l_extendedprice) AS max,
  corr(l_extendedprice, l_quantity) AS corr FROM lineitem""", "mean median min max corr")
def a7(spark, sf):
    return ds.summary_stats(fx.table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity")


@query("a8_group_quantile", f"""WITH {FX3D}
--result
SELECT t, CAST(0.2 AS DOUBLE) AS q, quantile_cont(abs(d_dose), 0.2) AS value FROM fx3d GROUP BY t""", "q value")
def a8(spark, sf):
    d = stage(pn.first_diff(fx.always_on(spark, sf), "unit", "t", {"dose": "d_dose"}), "diffs")
    return ds.group_quantile(d, ["t"], F.abs("d_dose"), 0.2)


@query("a8_raw_quantiles", """
--result
SELECT l_returnflag, CAST(q AS DOUBLE) AS q, value FROM (
  SELECT l_returnflag, unnest([0.1, 0.25, 0.5, 0.9]) AS q, unnest(quantile_cont(l_extendedprice, [0.1, 0.25, 0.5, 0.9])) AS value
  FROM lineitem GROUP BY l_returnflag)""", "q value")
def a8b(spark, sf):
    return ds.group_quantiles(fx.table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.1, 0.25, 0.5, 0.9])


@query("a9_dose_grid", f"""WITH {FX2}, s AS (SELECT min(dose) AS lo, max(dose) AS hi FROM fx2w),
g AS (SELECT lo + i * ((hi - lo) / CAST(199 AS DOUBLE)) AS d FROM s, (SELECT unnest(range(200)) AS i))
--result
SELECT d, 'linear' AS curve, CAST(0.5 AS DOUBLE) * d AS tau FROM g
UNION ALL SELECT d, 'concave', 6 * (sqrt(d / 5) - 1) FROM g UNION ALL SELECT d, 'declining', 20 * exp(-d / 4) FROM g""", "d tau")
def a9(spark, sf):
    wide = pn.two_period_delta(fx.two_period(spark, sf), "unit", "period", "y", ["dose"])
    return ds.dose_grid_over(wide, "dose", 200, DOSE_FNS)


@query("a10_collapse", f"""WITH {FX1}
--result
SELECT cluster, cohort, year, treat, count(*) AS n, sum(y) AS y_sum, sum(y * y) AS y_sumsq FROM fx1 GROUP BY 1, 2, 3, 4""", "y_sum y_sumsq")
def a10(spark, sf):
    return ds.collapse(fx.staggered(spark, sf), ["cluster", "cohort", "year", "treat"], "y")


@query("spec_profile", f"""WITH {FX1}
--result
SELECT count(DISTINCT unit) AS n_units, count(DISTINCT year) AS n_times, count(*) AS n_rows, CAST(0 AS BIGINT) AS duplicate_keys,
  CAST(0 AS BIGINT) AS cohort_varies, CAST(0 AS BIGINT) AS cluster_varies, true AS balanced FROM fx1""")
def profile(spark, sf):
    return SP.profile(fx.staggered(spark, sf))
