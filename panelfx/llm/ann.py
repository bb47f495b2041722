"""Nearest neighbours by shifted space-filling curves, with a certified rest.

Vectors are projected on principal axes of a bounded sample, a few axes for each curve, scaled to their distribution,
shifted, and put on a Hilbert curve. Spark partitions every ordering by ranges of the key; a query is compared with the
rows next to it in each ordering, and the finds of all curves are merged and ranked by their cosine.

The first ordering is also cut into blocks with a centre and the largest angle to it. A block whose bound shows that it
holds nothing nearer than what the windows found is left out for that query; the others are compared. So the result is
exact whatever the data: with clusters few blocks remain, with directions spread evenly in many dimensions nearly all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .components import reliable

CURVES, AXES, BITS = 4, 6, 8
#: Rows the axes and scales are fitted on.
SAMPLE = 4096
WINDOW = 256
BLOCK, CHUNK, PACK = 1024, 512, 1024
_SLACK = 1e-9


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer points (one a row, ``bits`` bits a coordinate).

    Works down the bits, undoing the reflection or exchange of axes that each level applies, and then reads the Gray
    code of the interleaved bits.
    """
    x = x.astype(np.int64).copy()
    n = x.shape[1]
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(n):
            high = (x[:, i] & bit) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] = np.where(high, x[:, 0] ^ low, x[:, 0] ^ swap)
            x[:, i] ^= swap
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[:, -1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn[:, None]
    key = np.zeros(len(x), np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[:, i] >> level & 1)
    return key


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def _cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row, summed in the same order whatever else is compared, so that equal vectors tie."""
    return (q * x).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1)))


def valid(vector: Column) -> Column:
    """Not null, without null, NaN or infinite components, and not all zero."""
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return F.coalesce(vector.isNotNull() & F.forall(vector, fine) & F.exists(vector, lambda v: v != 0), F.lit(False))


class Curves:
    """Axes, scales and shifts, from a sample of unit vectors."""

    def __init__(self, sample: np.ndarray, curves: int, axes: int, bits: int, seed: int = 11) -> None:
        self.bits = bits
        _, _, basis = np.linalg.svd(sample - sample.mean(0), full_matrices=True)
        rng = np.random.default_rng(seed)
        self.parts = []
        for c in range(curves):
            own = basis[[(c * axes + k) % len(basis) for k in range(min(axes, len(basis)))]]
            steps = np.quantile(sample @ own.T, np.linspace(0, 1, (1 << bits - 1) + 1)[1:-1], axis=0)
            self.parts.append((own, steps, rng.integers(0, 1 << bits - 1, len(own)) if c else np.zeros(len(own), int)))

    def key(self, x: np.ndarray, curve: int) -> np.ndarray:
        own, steps, shift = self.parts[curve]
        y = x @ own.T
        return hilbert(np.stack([np.searchsorted(steps[:, k], y[:, k]) for k in range(len(own))], 1) + shift, self.bits)


def _keyed(vectors: DataFrame, curves: Curves, which: list[int], dim: int) -> DataFrame:
    """curve, key, id, v: every row once a curve, in order of the key within ranges."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(_matrix(batch.column("v"), dim))
            for c in which:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(curves.key(x, c)),
                                                  batch.column("id"), batch.column("v")], names=["curve", "key", "id", "v"])

    kind = vectors.schema["v"].dataType.simpleString()
    ranged = vectors.mapInArrow(run, f"curve int, key long, id long, v {kind}").repartitionByRange("curve", "key")
    return ranged.sortWithinPartitions("curve", "key", "id")


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` best ids, each by its best row."""
    order = np.lexsort((ids, -scores))
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)[:k]]


def _windows(ordered: DataFrame, every: int, k: int, window: int, dim: int) -> DataFrame:
    """query_id, vec_id, score: the nearest of the ``window`` rows on each side of every query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, done = np.zeros(0, np.int64), np.zeros((0, dim)), 0

        def out(stop: int) -> pa.RecordBatch:
            rows: list[tuple] = []
            for i in np.nonzero(ids[done:stop] % every == 0)[0] + done:
                a, b = max(0, i - window), i + window + 1
                other = ids[a:b] != ids[i]
                cand, near = ids[a:b][other], _cosine(x[i:i + 1], x[a:b][other])
                rows += [(int(ids[i]), int(cand[j]), float(near[j])) for j in _best(cand, near, 2 * k)]
            cols = zip(*rows) if rows else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))],
                                              names=["query_id", "vec_id", "score"])

        for batch in batches:
            ids = np.concatenate([ids, batch.column("id").to_numpy()])
            x = np.concatenate([x, _matrix(batch.column("v"), dim)])
            stop = max(done, len(ids) - window)
            yield out(stop)
            cut = max(0, stop - window)
            ids, x, done = ids[cut:], x[cut:], stop - cut
        yield out(len(ids))

    return ordered.mapInArrow(run, "query_id long, vec_id long, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each query, ties to the smaller id; tasks cut to ``k`` before the shuffle."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(ordered: DataFrame, dim: int) -> DataFrame:
    """block, ids, v (packed), centre (packed), angle (largest to the centre), least (smallest id)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        ids, x = np.zeros(0, np.int64), np.zeros((0, dim))

        def out(n: int) -> pa.RecordBatch:
            unit = _unit(x[:n])
            mean = unit.mean(0)
            size = np.sqrt(mean @ mean)
            centre = mean / size if size > 1e-12 else unit[0]
            angle = float(np.arccos(np.clip(unit @ centre, -1, 1)).max())
            return pa.RecordBatch.from_arrays(
                [pa.array([at]), pa.array([ids[:n].tobytes()]), pa.array([np.ascontiguousarray(x[:n]).tobytes()]),
                 pa.array([centre.tobytes()]), pa.array([angle]), pa.array([int(ids[:n].min())])],
                names=["block", "ids", "v", "centre", "angle", "least"])

        for batch in batches:
            ids = np.concatenate([ids, batch.column("id").to_numpy()])
            x = np.concatenate([x, _matrix(batch.column("v"), dim)])
            while len(ids) >= BLOCK:
                yield out(BLOCK)
                ids, x, at = ids[BLOCK:], x[BLOCK:], at + 1
        if len(ids):
            yield out(len(ids))

    return ordered.mapInArrow(run, "block long, ids binary, v binary, centre binary, angle double, least long")


def _chunks(queries: DataFrame, size: int, dim: int) -> DataFrame:
    """ids, v, bar (score to beat), last (id to beat at that score) of up to ``size`` queries, packed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                packed = [part.column("id").to_numpy(), _matrix(part.column("v"), dim), part.column("bar").to_numpy(), part.column("last").to_numpy()]
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(c).tobytes()]) for c in packed], names=["ids", "v", "bar", "last"])

    return queries.mapInArrow(run, "ids binary, v binary, bar binary, last binary")


def _needed(pairs: DataFrame, dim: int) -> DataFrame:
    """block and the packed queries for which its bound does not rule it out, from a chunk met with packs of summaries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                ids, last = (np.frombuffer(row[c], np.int64) for c in ("ids", "last"))
                v, bar = np.frombuffer(row["v"]).reshape(-1, dim), np.frombuffer(row["bar"])
                centre = np.frombuffer(b"".join(row["centres"])).reshape(-1, dim)
                between = np.arccos(np.clip(_unit(v) @ centre.T, -1, 1)) - np.array(row["angles"])
                bound = np.cos(np.maximum(between, 0)) + _SLACK
                for j, block in enumerate(row["blocks"]):
                    use = bound[:, j] >= bar
                    if use.any():
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([block]), *(pa.array([np.ascontiguousarray(c[use]).tobytes()]) for c in (ids, v, bar, last))],
                            names=["block", "q_ids", "q_v", "bar", "last"])

    return pairs.mapInArrow(run, "block long, q_ids binary, q_v binary, bar binary, last binary")


def _compared(met: DataFrame, k: int, dim: int) -> DataFrame:
    """query_id, vec_id, score of rows of a block that beat what the windows found."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                q_ids, last, ids = (np.frombuffer(row[c], np.int64) for c in ("q_ids", "last", "ids"))
                q, x = (np.frombuffer(row[c]).reshape(-1, dim) for c in ("q_v", "v"))
                bar = np.frombuffer(row["bar"])
                near = _unit(q) @ _unit(x).T >= (bar - _SLACK)[:, None]
                i, j = np.nonzero(near & (q_ids[:, None] != ids[None, :]))
                score = _cosine(q[i], x[j])
                better = (score > bar[i]) | (score == bar[i]) & (ids[j] < last[i])
                i, j, score = i[better], j[better], score[better]
                # the best row of each id, then the nearest k ids of the block for each query
                order = np.lexsort((-score, ids[j], i))
                i, j, score = i[order], j[order], score[order]
                new = np.ones(len(i), bool)
                new[1:] = (i[1:] != i[:-1]) | (ids[j[1:]] != ids[j[:-1]])
                i, j, score = i[new], j[new], score[new]
                order = np.lexsort((ids[j], -score, i))
                i, j, score = i[order], j[order], score[order]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < k
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[i[keep]]), pa.array(ids[j[keep]]), pa.array(score[keep])],
                                                 names=["query_id", "vec_id", "score"])

    return met.mapInArrow(run, "query_id long, vec_id long, score double")


def _search(vectors: DataFrame, every: int, k: int, dim: int, window: int, certify: bool) -> DataFrame:
    order = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v")
    sample = np.array([r["v"] for r in order.collect()], float)
    curves = Curves(_unit(sample), CURVES, AXES, BITS)
    found = _top(_windows(_keyed(vectors, curves, list(range(CURVES)), dim), every, k, window, dim), k)
    if not certify:
        return found
    found = reliable(found)
    blocks = reliable(_blocks(_keyed(vectors, curves, [0], dim), dim))
    bars = found.groupBy("query_id").agg(F.count("*").alias("n"), F.max("rank").alias("r"), F.max_by("score", "rank").alias("bar"),
                                         F.max_by("vec_id", "rank").alias("last"))
    full = F.col("n") >= k
    queries = vectors.where(F.col("id") % every == 0).dropDuplicates(["id", "v"]).join(bars, F.col("id") == F.col("query_id"), "left")
    queries = queries.select("id", "v", F.when(full, F.col("bar")).otherwise(-2.0).alias("bar"),
                             F.when(full, F.col("last")).otherwise(F.lit(0).cast("long")).alias("last"))
    packs = max(1, -(-blocks.count() // PACK))
    summary = blocks.groupBy(F.pmod(F.xxhash64("block"), F.lit(packs)).alias("pack")).agg(
        F.collect_list("block").alias("blocks"), F.collect_list("centre").alias("centres"), F.collect_list("angle").alias("angles"))
    chunks = _chunks(queries, CHUNK, dim).withColumn("pack", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(packs - 1).cast("long"))))
    needed = _needed(chunks.join(summary, "pack").drop("pack"), dim)
    more = _compared(needed.join(blocks.select("block", "ids", "v"), "block").drop("block"), k, dim)
    return _top(found.select("query_id", "vec_id", "score").unionByName(more), k)


def nearest(df: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", vector: str = "embedding",
            window: int = WINDOW, certify: bool = True) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of largest cosine for every row whose id ``every`` divides.

    Ties go to the smaller id; a query's own id is no candidate. Vectors that are null, empty, zero or hold null or
    non-finite components take no part, nor do rows without an id; vectors of different lengths are not compared. Rows
    with equal ids are one candidate with its best score. Without ``certify`` only the windows are searched.
    """
    src = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"))
    src = src.where(F.col("id").isNotNull() & valid(F.col("v")))
    lengths = sorted(r[0] for r in src.select(F.size("v")).distinct().collect())
    parts = [_search(src.where(F.size("v") == n), every, k, n, window, certify) for n in lengths]
    if not parts:
        return src.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).where("false")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
