import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelfx import PanelSpec, spec
from panelfx.functions.columns import digest, hash_rank
from panelfx.operators import panel as pn
from panelfx.plans import stage as stg
from panelfx.plans import fixtures as fx


def test_balanced_panel_against_pandas(spark):
    units = spark.range(1, 21).withColumnRenamed("id", "u")
    facts = spark.range(400).select((F.col("id") % 19).alias("u"), (F.col("id") % 7).cast("int").alias("t"),
                                    F.sin("id").alias("v"))
    args = (units, facts, "u", "t", range(5), {"s": F.sum, "m": F.avg}, {"s": F.col("v"), "m": F.col("v")})
    got = pn.balanced_panel(*args).orderBy("u", "t").toPandas()
    cells = facts.toPandas().groupby(["u", "t"]).v.agg(["sum", "mean"])
    want = cells.reindex([(u, t) for u in range(1, 21) for t in range(5)]).fillna(0)
    np.testing.assert_allclose(got[["s", "m"]], want)
    assert len(got) == 100 and (got[got.u == 20].s == 0).all()  # unit without facts is kept


def test_first_difference_respects_gaps(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 2, 3.0), (1, 4, 9.0), (2, 1, 5.0), (2, 2, 5.0)], "u int, t int, y double")
    got = sorted(tuple(r) for r in pn.first_diff(df, "u", "t", {"y": "dy"}, {"y": "ly"}).select("u", "t", "dy", "ly").collect())
    assert got == [(1, 2, 2.0, 1.0), (2, 2, 0.0, 5.0)]


@pytest.mark.parametrize("prefix", [1, 2, 3])
def test_hash_rank_is_the_global_order(spark, prefix):
    df = spark.range(300).withColumn("rep", F.col("id") % 3).withColumn("h", digest(9, "rep", "id"))
    got = hash_rank(df, ["rep"], "h", "r", prefix).toPandas()
    want = got.sort_values(["rep", "h"]).groupby("rep").cumcount() + 1
    assert (got.r == want.sort_index()).all()
    alone = hash_rank(df, [], "h", "r", prefix).toPandas()
    assert (alone.r == alone.h.rank().astype(int)).all()


def test_permuted_cohorts_keep_their_sizes(spark):
    ids = spark.range(25).withColumnRenamed("id", "c").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(30))))
    got = pn.permute_cohorts(ids, "c", {1997: 9, 1999: 8, None: 8}, 1, rep="rep")
    sizes = got.groupBy("rep", "g" if "g" in got.columns else "cohort").count().toPandas()
    assert set(sizes.groupby("rep")["count"].apply(lambda s: tuple(sorted(s)))) == {(8, 8, 9)}
    assert got.groupBy("rep").agg(F.count_distinct("c").alias("n")).filter("n <> 25").count() == 0


def test_permutation_does_not_depend_on_partitioning(spark):
    ids = spark.range(40).withColumnRenamed("id", "c")
    a = pn.permute_cohorts(ids.repartition(1), "c", {1: 10, 2: 30}, 4).orderBy("c").collect()
    b = pn.permute_cohorts(ids.repartition(7), "c", {1: 10, 2: 30}, 4).orderBy("c").collect()
    assert a == b


def test_dummies_keep_the_source_and_treat_null_as_zero(spark):
    df = spark.createDataFrame([(1, None), (2, 1997)], "u int, g int")
    got = pn.dummies(df, "g", [1997]).orderBy("u").collect()
    assert [(r.g, r.g_1997) for r in got] == [(None, 0), (1997, 1)]


def test_profile_finds_faults(spark):
    good = [(u, t, 1.0, u % 2, 3 if u % 2 else None) for u in range(4) for t in range(3)]
    schema = "u int, t int, y double, c int, g int"
    sp = PanelSpec(unit="u", time="t", y="y", cluster="c", cohort="g")
    full = sp.check(spark.createDataFrame(good, schema))
    assert full.times == (0, 1, 2) and full.cohorts == (3,)
    for bad, word in [(good + [good[0]], "repeated"), (good[:-1], "different numbers"),
                      (good[:-1] + [(3, 2, 1.0, 1, None)], "g varies"), (good[:-1] + [(3, 2, 1.0, 0, 3)], "c varies")]:
        with pytest.raises(ValueError, match=word):
            sp.check(spark.createDataFrame(bad, schema))


def test_profile_holds_few_keys_in_a_task(spark, monkeypatch):
    """Tasks grow in number with the rows, and no task groups keys before the rows are dealt by unit."""
    monkeypatch.setattr(spec, "TASK_ROWS", 100)
    rows = [(u if u else None, t, 1.0, 0, 3) for u in range(125) for t in range(8)]
    df = spark.createDataFrame(rows + rows[:3], "u int, t int, y double, c int, g int").coalesce(1)
    got = PanelSpec(unit="u", time="t", y="y", cluster="c", cohort="g").profile(df)
    dealt = got._jdf.queryExecution().executedPlan().toString().split("hashpartitioning(u")
    assert len(dealt) == 2 and ", 11), REPARTITION_BY_NUM" in dealt[1] and "Aggregate" not in dealt[1]
    assert got.first().asDict() == {"n_units": 125, "n_times": 8, "n_rows": 1003, "duplicate_keys": 3, "cohort_varies": 0,
                                    "cluster_varies": 0, "balanced": True}


def test_stage_writes_once_and_reads_back(spark):
    out = stg.stage(spark.range(5).withColumn("x", F.rand()), "x")
    assert out.collect() == out.collect() and out.count() == 5
    root = stg.checkpoint_root(spark).split("://")[-1].removeprefix("file:")
    assert out.inputFiles()[0].split("://")[-1].lstrip("/").startswith(root.lstrip("/"))
    stg.drop_stage(out)
    assert not os.path.exists(out.inputFiles()[0].removeprefix("file://"))


def test_the_named_folder_is_used():
    class Conf:
        def get(self, name, default=None):
            return "hdfs://shared/ck/" if name == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf()

    assert stg.checkpoint_root(Session()) == "hdfs://shared/ck"


def test_without_a_named_folder_the_warehouse_is_used():
    class Conf:
        def get(self, name, default=None):
            return "hdfs://shared/wh/" if name == "spark.sql.warehouse.dir" else default

    class Context:
        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    assert stg.checkpoint_root(Session()) == "hdfs://shared/wh/_stages"


def test_only_needed_columns_are_read(spark, sf_dir):
    plan = fx.yearly_orders(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "o_orderpriority" not in plan and "o_orderkey" not in plan
