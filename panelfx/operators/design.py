"""Regressors of a model as a list of named columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import indicator


@dataclass
class Design:
    """Built up call by call; each call appends terms and returns the design.

    A factor with levels becomes one 0/1 column per level other than the reference; NULL is a level of
    its own only if it is listed. Products are made between the named parts.
    """

    terms: list[tuple[str, Column]] = field(default_factory=list)
    nullable: set[str] = field(default_factory=set)

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.terms]

    def main(self, *columns: str) -> "Design":
        for c in columns:
            self.terms.append((c, F.col(c).cast("double")))
            self.nullable.add(c)
        return self

    def expr(self, name: str, column: Column) -> "Design":
        self.terms.append((name, column.cast("double")))
        self.nullable.add(name)
        return self

    def factor(self, column: str, levels: Sequence, ref=None) -> "Design":
        for v in levels:
            if v != ref:
                self.terms.append((f"{column}::{v}", indicator(column, v).cast("double")))
        return self

    def interact(self, left: "Design", right: "Design") -> "Design":
        """Products of every term of one part with every term of the other."""
        for ln, lc in left.terms:
            for rn, rc in right.terms:
                self.terms.append((f"{ln}:{rn}", lc * rc))
                if ln in left.nullable or rn in right.nullable:
                    self.nullable.add(f"{ln}:{rn}")
        return self

    def crossed(self, *parts: "Design") -> "Design":
        """All parts and their products, lower orders first, so that of a collinear set the lower-order
        terms are the ones that stay."""
        for order in range(1, len(parts) + 1):
            for chosen in combinations(parts, order):
                term = chosen[0]
                for p in chosen[1:]:
                    term = Design().interact(term, p)
                self.terms += term.terms
                self.nullable |= {n for n, _ in term.terms} & term.nullable
        return self

    def cells(self, flag: str, cohort: str, time: str, live: Sequence[tuple[int, int]]) -> "Design":
        """``flag`` times one dummy per (cohort, period) cell listed in ``live``."""
        for g, t in live:
            on = indicator(cohort, g) * indicator(time, t) * F.col(flag)
            self.terms.append((f"{flag}:{cohort}::{g}:{time}::{t}", on.cast("double")))
        return self

    def complete(self) -> Column:
        """True on rows where no regressor is NULL; 0/1 terms never are."""
        out = F.lit(True)
        for n, c in self.terms:
            if n in self.nullable:
                out = out & c.isNotNull()
        return out

    def attach(self, df: DataFrame, keep: Sequence[Column] = ()) -> tuple[DataFrame, list[str]]:
        """Select the kept columns and the regressors under positional names, NULL as 0.

        Incomplete rows are left to the caller's weight and not filtered here: a filter over many
        computed columns makes the optimizer's constraint sets grow without need.
        """
        cols = [(F.coalesce(c, F.lit(0.0)) if n in self.nullable else c).alias(f"x{i}")
                for i, (n, c) in enumerate(self.terms)]
        return df.select(*keep, *cols), [f"x{i}" for i in range(len(cols))]


def post_cells(cohorts: Sequence[int], times: Sequence[int]) -> list[tuple[int, int]]:
    """The treated (cohort, period) cells."""
    return [(g, t) for g in cohorts for t in times if t >= g]


def pre_cells(cohorts: Sequence[int], times: Sequence[int], base: int) -> list[tuple[int, int]]:
    """The untreated (cohort, period) cells other than the base period."""
    return [(g, t) for g in cohorts for t in times if t < g and t != base]
