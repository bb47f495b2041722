"""Registry of runnable queries and of the SQL that gives the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import rounded

DIGITS = 6


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None, doubles: str = ""):
    """Register a query. ``doubles`` lists the result's floating-point columns, rounded on both sides."""
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        full = None
        if sql is not None:
            swap = ", ".join(f'round("{c}", {DIGITS}) + 0.0 AS "{c}"' for c in doubles.split())
            body = sql.strip()
            # keep the WITH list at the top and round in an outer select over the last one
            head, _, last = body.rpartition("\n--result\n")
            full = f"{head}\nSELECT * {'REPLACE (' + swap + ')' if swap else ''} FROM ({last.strip()}) AS result"
        REGISTRY[name] = Entry(lambda spark, sf: rounded(fn(spark, sf), DIGITS), full)
        return fn
    return wrap
