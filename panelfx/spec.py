"""Column roles of a panel, and the checks every estimator relies on."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that one task of ``profile`` groups, about: its hash tables hold every key of the task.
TASK_ROWS = 1 << 18


def _levels(df: DataFrame, column: str, most: int) -> tuple[int, ...]:
    rows = df.select(column).filter(F.col(column).isNotNull()).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{column} has more than {most} values; raise max_levels if it does hold periods")
    return tuple(sorted(r[0] for r in rows))


@dataclass(frozen=True)
class PanelSpec:
    """Names the columns of a long panel, one row per (unit, time).

    ``cohort`` holds the first treated period and is NULL for units that are never treated.
    ``times`` and ``cohorts`` are the distinct levels. They may be given; if not, ``with_levels``
    finds them. Cohorts are periods, so both lists are bounded by the length of the time axis.
    """

    unit: str
    time: str
    y: str
    cluster: str | None = None
    cohort: str | None = None
    treat: str = "treat"
    dose: str | None = None
    weight: str | None = None
    times: tuple[int, ...] | None = None
    cohorts: tuple[int, ...] | None = None

    def with_levels(self, df: DataFrame, max_levels: int = 10_000) -> "PanelSpec":
        """Fill in ``times`` and ``cohorts`` from the data where they are not given. They are collected, so a
        column with more than ``max_levels`` values is taken for one that does not hold periods."""
        out = self
        if self.times is None:
            out = replace(out, times=_levels(df, self.time, max_levels))
        if self.cohorts is None and self.cohort is not None:
            out = replace(out, cohorts=_levels(df, self.cohort, max_levels))
        return out

    def profile(self, df: DataFrame) -> DataFrame:
        """One row of facts about the panel: sizes, duplicate keys, roles that vary in a unit, balance.

        Keys of a panel hardly repeat, so adding up before the shuffle would only hold all keys of a task. Rows are
        counted and dealt by unit first, to as many tasks as keep the keys of each few.
        """
        columns = dict.fromkeys(c for c in (self.unit, self.time, self.cohort, self.cluster) if c)
        rows = df.select(*columns).repartition(1 + df.count() // TASK_ROWS, self.unit)
        per_key = rows.groupBy(self.unit, self.time).agg(
            F.count(F.lit(1)).alias("n"),
            *self._constants(first=True),
        )
        per_unit = per_key.groupBy(self.unit).agg(
            F.sum("n").alias("n_rows"),
            F.count(F.lit(1)).alias("n_times"),
            F.sum((F.col("n") > 1).cast("int")).alias("dup"),
            *self._constants(first=False),
        )
        varies = {
            role: F.sum(
                (~F.col(f"{role}_lo").eqNullSafe(F.col(f"{role}_hi"))
                 | ((F.col(f"{role}_set") > 0) & (F.col(f"{role}_set") < F.col("n_rows")))).cast("int")
            )
            for role in ("cohort", "cluster") if getattr(self, role)
        }
        return per_unit.agg(
            F.count(F.lit(1)).alias("n_units"),
            F.max("n_times").cast("long").alias("n_times"),
            F.sum("n_rows").alias("n_rows"),
            F.sum("dup").alias("duplicate_keys"),
            *[v.alias(f"{role}_varies") for role, v in varies.items()],
            (F.min("n_times") == F.max("n_times")).alias("balanced"),
        )

    def _constants(self, first: bool) -> list:
        out = []
        for role in ("cohort", "cluster"):
            name = getattr(self, role)
            if not name:
                continue
            if first:
                out += [F.min(name).alias(f"{role}_lo"), F.max(name).alias(f"{role}_hi"),
                        F.count(name).alias(f"{role}_set")]
            else:
                out += [F.min(f"{role}_lo").alias(f"{role}_lo"), F.max(f"{role}_hi").alias(f"{role}_hi"),
                        F.sum(f"{role}_set").alias(f"{role}_set")]
        return out

    def check(self, df: DataFrame, balanced: bool = True) -> "PanelSpec":
        """Raise ValueError when the panel breaks a rule the estimators rely on."""
        row = self.profile(df).first().asDict()
        problems = []
        if row["duplicate_keys"]:
            problems.append(f"{row['duplicate_keys']} repeated ({self.unit}, {self.time}) keys")
        for role in ("cohort", "cluster"):
            if row.get(f"{role}_varies"):
                problems.append(f"{getattr(self, role)} varies within {row[f'{role}_varies']} units")
        if balanced and not row["balanced"]:
            problems.append("units have different numbers of periods")
        if problems:
            raise ValueError("; ".join(problems))
        return self.with_levels(df)
