"""Small column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DoseFn = Callable[[Column], Column]


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_array(values: Iterable) -> Column:
    return F.array(*[F.lit(v) for v in values])


def flag(cond: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is unknown."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def is_treated(time, cohort) -> Column:
    """Absorbing treatment: from the first treated period on. NULL cohort is never treated."""
    return flag(col(time) >= col(cohort))


def indicator(c, value) -> Column:
    return flag(col(c) == F.lit(value))


def safe_log(c) -> Column:
    return F.when(col(c) > 0, F.ln(col(c)))


def block_of(c, size: int) -> Column:
    """Consecutive blocks of ``size`` ids, numbered from 1."""
    return F.floor((col(c) - 1) / F.lit(size)) + F.lit(1)


def digest(seed, *parts) -> Column:
    """Text digest that any engine with md5 can repeat; does not depend on partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(p).cast("string") for p in parts]))


COINS_PER_DIGEST = 32


def coin_text(seed, reps: int, key: str) -> Column:
    """Hex text with one digit per replicate; a digit below 8 is heads. One digest serves 32 replicates:
    replicate r (from 1) uses digit (r - 1) mod 32 of the digest of block (r - 1) div 32."""
    blocks = (reps + COINS_PER_DIGEST - 1) // COINS_PER_DIGEST
    return F.concat(*[digest(seed, F.lit(b), key) for b in range(blocks)])


def hash_rank(df: DataFrame, by: Sequence[str], order: str, out: str, prefix: int | None = None,
              per_range: int = 100_000) -> DataFrame:
    """Rank from 1 in the order of a hex digest column, within ``by`` (may be empty).

    Digests are spread evenly, so the first hex digits cut the order into 16**prefix ranges of equal size;
    without ``prefix`` it is chosen so that a range of the whole table has about ``per_range`` rows. Rows are ranked inside a range and shifted by the count of the ranges before it; no task sorts a
    whole group.
    """
    if prefix is None:
        n, prefix = df.count(), 1
        while n > per_range * 16 ** prefix:
            prefix += 1
    b = df.withColumn("_rng", F.substring(order, 1, prefix))
    sizes = b.groupBy(*by, "_rng").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)
    if by:
        offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    else:
        # at most 16**prefix rows
        offsets = (sizes.withColumn("_all", F.lit(1))
                   .withColumn("_off", F.coalesce(
                       F.sum("_n").over(Window.partitionBy("_all").orderBy("_rng")
                                        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
                   .drop("_all"))
    inside = F.row_number().over(Window.partitionBy(*by, "_rng").orderBy(order))
    return (b.withColumn("_rn", inside)
            .join(offsets.drop("_n"), [*by, "_rng"])
            .withColumn(out, F.col("_rn") + F.col("_off"))
            .drop("_rn", "_off", "_rng"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column and turn -0.0 into 0.0."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = (F.round(c.cast("double"), digits) + F.lit(0.0)).alias(f.name)
        out.append(c)
    return df.select(*out)
