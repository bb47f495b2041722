"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def keyed(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """Only the columns an operator needs, so that extra columns of any name cannot clash."""
    return df.select(F.col(key), *(F.col(c) for c in columns))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def per_row(df: DataFrame, make: Callable[[], Callable[[dict], tuple]], schema: str, step: int = 64) -> DataFrame:
    """Map every row to one row with Python. ``make`` runs once in each task and returns the row function.

    Rows go out in blocks of ``step``, so that memory follows the longest texts of a block and not the partition.
    """
    names = [f.split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = make()
        types = None
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                rows = [row(r) for r in batch.slice(at, step).to_pylist()]
                types = types or arrow_types(schema)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=names)

    return df.mapInArrow(run, schema)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
          "boolean": pa.bool_(), "binary": pa.binary(), "float": pa.float32(),
          "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
          "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string())}


def arrow_types(schema: str) -> list[pa.DataType]:
    return [_ARROW[f.split()[1]] for f in schema.split(",")]


def held_out(doc_id: str, folds: int, fold: int):
    """True where crc32 of the id written as text leaves ``fold`` modulo ``folds``."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))
