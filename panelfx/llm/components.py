"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.stage import checkpoint_root


def reliable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that losing an executor loses none of it."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(checkpoint_root(df.sparkSession))
    return df.checkpoint()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first())


def components(pairs: DataFrame) -> DataFrame:
    """node, root for every node of ``pairs`` (long columns a, b): root is the smallest node it is connected with.

    Large-star and small-star rounds (each node hands its larger, then its smaller neighbours to its smallest one)
    until nothing changes. A round is two partial minima and two joins against them, so a node of any degree is
    dealt out; nothing is gathered. Nulls and loops are ignored.
    """
    a, b = F.col("a"), F.col("b")
    edges = reliable(pairs.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    state = _state(edges)
    while True:
        both = edges.select("a", "b").unionByName(edges.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(b > a).join(least, "a").select(b.alias("a"), F.col("m").alias("b"))
        large = large.where(a > b).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(b.alias("a"), F.col("m").alias("b")).where(a > b)
        edges = reliable(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = _state(edges)
        if now == state:
            break
        state = now
    roots = edges.select(b.alias("node"), b.alias("root")).distinct()
    return roots.unionByName(edges.select(a.alias("node"), b.alias("root")))

