"""Benchmark items inside documents: size-partitioned MinHash containment search, verified by exact containment.

Items are partitioned by their number of distinct shingles. In a partition every item is represented by its smallest
shingle hashes, as many as are needed so that a document holding the stated share of an item cannot miss all of them:
for at most n shingles and containment t that is n - ceil(t n) + 1. A document is searched with all its shingles,
however long it is, so a short item in a long text is found as surely as in a short one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..plans.stage import stage
from .common import keyed
from .components import reliable

WIDTH = 5
CONTAINMENT = 0.8
#: Bits of the filter that goes to every task; its size is fixed, whatever the number of items.
FILTER_BITS = 22
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_PIECE = 1 << 20

_WORD = np.zeros(256, bool)
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _STEP
    return h ^ (h >> np.uint64(29))


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, _PIECE)
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            both = []
            for factor in (_BASE, inverse):
                p = np.full(size, factor, np.uint64)
                p[0] = 1
                both.append(np.multiply.accumulate(p))
            self.up, self.down = both
        return self.up, self.down


def word_hashes(raw: np.ndarray, powers: _Powers, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word of lower-cased UTF-8 bytes; words also end at ``cuts``."""
    inside = _WORD[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = cuts[cuts < len(raw)]
    begins[cuts] = inside[cuts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:]
    start, end = np.nonzero(begins)[0], np.nonzero(ends)[0] + 1
    up, down = powers.upto(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:len(raw)], out=total[1:])
    return start, end, _mix((total[end] - total[start]) * down[start])


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    if len(words) < width:
        return words[:0]
    h = words[:len(words) - width + 1].copy()
    for k in range(1, width):
        h = h * _BASE + words[k:len(words) - width + 1 + k]
    return _mix(h)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def items_table(items: DataFrame, item_id: str, text: str, width: int) -> DataFrame:
    """item_id, width, shingle, hash: distinct shingles; a shorter item is one shingle of all its words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for batch in batches:
            rows: list[tuple] = []
            for key, low in zip(batch.column("item_id").to_pylist(), pc.utf8_lower(batch.column("text")).to_pylist()):
                data = (low or "").encode()
                raw = np.frombuffer(data, np.uint8)
                if not len(raw):
                    continue
                start, end, h = word_hashes(raw, powers, np.zeros(1, np.int64))
                w = min(width, len(h))
                words = [data[i:j] for i, j in zip(start.tolist(), end.tolist())]
                if w:
                    hashes = _signed(shingle_hashes(h, w)).tolist()
                    rows += [(key, w, b" ".join(words[i:i + w]).decode(), x) for i, x in enumerate(hashes)]
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.string(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["item_id", "width", "shingle", "hash"])

    src = keyed(items, item_id, text).toDF("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    return src.mapInArrow(run, "item_id long, width int, shingle string, hash long").distinct()


def signatures(shingles: DataFrame, containment: float) -> DataFrame:
    """The smallest hashes of each item, as many as its size partition (powers of two) needs."""
    n = F.col("n_item")
    most = F.pow(F.lit(2.0), F.floor(F.log2(n)) + 1) - 1
    need = most - F.ceil(F.lit(containment) * most - 1e-9) + 1
    sizes = shingles.groupBy("item_id").agg(F.count("*").alias("n_item"), F.sort_array(F.collect_list("hash")).alias("all"))
    return sizes.withColumn("need", need.cast("int")).select(
        "item_id", "n_item", F.explode(F.slice("all", F.lit(1), F.col("need"))).alias("hash"))


def _hits(docs: DataFrame, widths: list[int], first: np.ndarray, every: np.ndarray, alone: bool = True) -> DataFrame:
    """doc_id, shingle, hash, signed: shingles in the filter of all items, of texts with one in that of the signatures.

    With ``alone`` false texts need none of their own, since another row of their id has one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        mask = np.uint64((1 << FILTER_BITS) - 1)
        bits = np.zeros((2, 1 << FILTER_BITS), bool)
        bits[0][first] = True
        bits[1][every] = True
        for batch in batches:
            low = pc.utf8_lower(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            length = np.array(pc.binary_length(low))
            for a, b in _pieces(length):
                data = "".join(low.slice(a, b - a).to_pylist()).encode()
                raw = np.frombuffer(data, np.uint8)
                if not len(raw):
                    continue
                cuts = np.concatenate([[0], np.cumsum(length[a:b])])
                start, end, h = word_hashes(raw, powers, cuts[:-1])
                doc = np.searchsorted(cuts, start, "right") - 1
                rows: list[tuple] = []
                for w in widths:
                    s = shingle_hashes(h, w)
                    if not len(s):
                        continue
                    same = doc[:len(s)] == doc[w - 1:]
                    place = (s & mask).astype(np.int64)
                    near = same & bits[0][place]
                    if alone and not near.any():
                        continue
                    has = np.full(b - a, not alone)
                    has[doc[:len(s)][near]] = True
                    at = np.nonzero(same & bits[1][place] & has[doc[:len(s)]])[0]
                    for i, x in zip(at.tolist(), _signed(s[at]).tolist()):
                        text = b" ".join(data[start[k]:end[k]] for k in range(i, i + w)).decode()
                        rows.append((ids[a + doc[i]], text, x, bool(near[i])))
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*set(rows)), (pa.int64(), pa.string(), pa.int64(), pa.bool_()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "shingle", "hash", "signed"])

    return docs.mapInArrow(run, "doc_id long, shingle string, hash long, signed boolean")


def _pieces(length: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about a megabyte together; a longer text is a run of its own."""
    a = total = 0
    for i, n in enumerate(length.tolist()):
        if i > a and total + n > _PIECE:
            yield a, i
            a, total = i, 0
        total += n
    if len(length) > a:
        yield a, len(length)


def _positions(hashes: DataFrame) -> np.ndarray:
    """Places of the filter that are set: at most 2^22 numbers, whatever the number of items."""
    place = F.col("hash").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)).cast("int")
    rows = hashes.select(place.alias("p")).distinct().toArrow().column("p")
    return np.sort(rows.to_numpy())


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 item_id: str = "item_id", item_text: str = "text", width: int = WIDTH,
                 containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment: every item of which a document holds the share ``containment``.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, lower-cased; shingles are sets. An
    item of fewer words than ``width`` is one shingle of that many words. Null and empty texts match nothing, rows
    with a null id take no part, rows with equal ids count as one text holding all their shingles: where one of them
    holds a signature hash, the others are read again for the rest of the item.
    """
    # files, since the optimizer knows their size; it sizes a checkpoint by what it was made from, and a text is many shingles
    shingles = stage(items_table(items, item_id, item_text, width), "shingles")
    signed = stage(signatures(shingles, containment), "signed")
    widths = sorted(r["width"] for r in shingles.select("width").distinct().collect())
    src = keyed(docs, doc_id, text).toDF("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    first, every = _positions(signed), _positions(shingles)
    own = stage(_hits(src, widths, first, every), "hits")
    several = src.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1")
    met = reliable(own.where("signed").select("doc_id").distinct().join(several, "doc_id", "left_semi"))
    hits = own
    if not met.isEmpty():
        hits = own.unionByName(stage(_hits(src.join(met, "doc_id", "left_semi"), widths, first, every, alone=False), "hits"))
    candidates = hits.where("signed").select("doc_id", "hash").distinct().join(signed, "hash")
    candidates = candidates.select("doc_id", "item_id", "n_item").distinct()
    shared = hits.select("doc_id", "shingle").distinct().join(shingles.select("item_id", "shingle"), "shingle")
    found = shared.join(candidates, ["doc_id", "item_id"]).groupBy("doc_id", "item_id", "n_item")
    found = found.agg(F.count("*").alias("n_shared"))
    return found.withColumn("containment", F.col("n_shared") / F.col("n_item")).where(
        F.col("containment") >= containment - 1e-12)
