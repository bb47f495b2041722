"""Tables that put estimates side by side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; missing columns become NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def add_base_row(df: DataFrame, **values) -> DataFrame:
    """Append the row of an omitted base category."""
    spark = df.sparkSession
    types = {f.name: f.dataType for f in df.schema.fields}
    row = spark.range(1).select(*[F.lit(v).cast(types[k]).alias(k) for k, v in values.items()])
    return df.unionByName(row, allowMissingColumns=True)


def compare_models(models: Sequence[tuple[str, DataFrame]], statistics: Sequence[str] = ("estimate", "std_error"),
                   term: str = "term") -> DataFrame:
    """One row per term; for each model one column per statistic."""
    long = stack([df.select(term, *statistics).withColumn("model", F.lit(name)) for name, df in models])
    return long.groupBy(term).pivot("model", [n for n, _ in models]).agg(
        *[F.first(s).alias(s) for s in statistics])


def attach_truth(df: DataFrame, key: str, truth: Column) -> DataFrame:
    """Add the true effect and whether the row is before or after the intervention."""
    return df.withColumns({
        "truth": truth,
        "phase": F.when(F.col(key) < 0, F.lit("Pre")).otherwise(F.lit("Post"))})


def scenario_summary(rows: Sequence[tuple[str, str, DataFrame]], digits: int = 2) -> DataFrame:
    """Stack one-row results (columns estimate, alternative, truth; any may be missing) under a scenario
    and a setting name, rounded."""
    parts = []
    for scenario, setting, df in rows:
        cols = [F.round(F.col(c), digits).alias(c) if c in df.columns else F.lit(None).cast("double").alias(c)
                for c in ("estimate", "alternative", "truth")]
        parts.append(df.select(F.lit(scenario).alias("scenario"), F.lit(setting).alias("setting"), *cols))
    return stack(parts)


def att_label(g: str, t: str) -> Column:
    return F.concat(F.lit("ATT("), F.col(g).cast("string"), F.lit(","), F.col(t).cast("string"), F.lit(")"))


def strip_prefix(column: str, prefix: str, new: str) -> Column:
    return F.regexp_replace(F.col(column), f"^{prefix}", new)


def fixed_number(c: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f", c)


def rename_terms(df: DataFrame, names: Mapping[str, str], term: str = "term") -> DataFrame:
    """Display names for terms; others are kept."""
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return df.withColumn(term, F.coalesce(F.try_element_at(m, F.col(term)), F.col(term)))
