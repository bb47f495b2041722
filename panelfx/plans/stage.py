"""Writing an intermediate table once, so that later passes read it instead of recomputing it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; without that setting, a folder of
    the session's warehouse, which all executors share too."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as parquet under the checkpoint folder and read it back.

    The reader starts from files: the lineage is cut, a lost executor costs a re-read and not a
    recomputation, and the optimizer sees the true size of the table when it picks joins.
    """
    path = f"{checkpoint_root(df.sparkSession)}/panelfx/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stage(df: DataFrame) -> None:
    """Remove a staged table that nothing reads any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0].rsplit("/", 1)[0]) if df.inputFiles() else None
    if path is not None:
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
