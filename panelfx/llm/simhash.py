"""Near copies by 64-bit SimHash, with candidates from pigeonring chains.

A fingerprint is cut into five segments on a ring. If two fingerprints differ in at most four bits, some segment starts
a chain whose first l segments differ in at most 4 l / 5 bits together, for every l. So the first segment is equal, the
first two differ in at most one bit, the first three in two, the first four in three. Candidates share the first
segment and all but one bit of the second; the longer chain and then the full distance are checked on the pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import keyed, per_row
from .components import components, reliable

BITS = 64
SEED = 42
_BLOCK = 1 << 15


def _majority(hashes: Callable[[int, int], np.ndarray], n: int) -> int:
    """Bits set in over half of n hashes, which come in blocks."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, _BLOCK):
        block = hashes(at, min(n, at + _BLOCK))
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash of a text: XXH64 of word shingles, repeats included. Zero for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < width:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start, end = (end - size)[:len(words) - width + 1], end[width - 1:]
    digest = xxhash.xxh64_intdigest

    def hashes(a: int, b: int) -> np.ndarray:
        spans = zip(start[a:b].tolist(), end[a:b].tolist())
        return np.fromiter((digest(joined[i:j], SEED) for i, j in spans), np.uint64, b - a)

    return _majority(hashes, len(start))


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long). A null text counts as empty."""
    src = keyed(df, doc_id, text).toDF("doc_id", "text")

    def make():
        def row(r: dict) -> tuple:
            f = fingerprint(r["text"], width)
            return r["doc_id"], f - (1 << 64) if f >> 63 else f
        return row

    return per_row(src, make, "doc_id long, fp long")


def _segments(segments: int) -> list[tuple[int, int]]:
    """Offset and width of each segment."""
    cuts = [BITS * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _part(fp: Column, offset: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, offset).bitwiseAND(F.lit((1 << width) - 1))


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """Pairs a, b of distinct fingerprints (column fp) at ``distance`` or fewer differing bits, each pair at least once.

    With ``distance`` + 1 segments a chain's first segment has no difference and its first two at most one. Either side
    can bridge that bit; only the fingerprint that has a zero there does, so each candidate is met once per chain.

    Both sides hold many rows a fingerprint, which the optimizer sizes as one. So their join is a merge at any size; a
    side that is broadcast by that estimate can be a hundred times the session's threshold.
    """
    parts = _segments(distance + 1)
    m = len(parts)
    fp = F.col("fp")
    keys, probes = [], []
    for i, (o1, w1) in enumerate(parts):
        o2, w2 = parts[(i + 1) % m]
        head = F.shiftleft(F.lit(i).cast("long") * F.lit(1 << w1) + _part(fp, o1, w1), w2)
        second = _part(fp, o2, w2)
        keys.append(F.struct(F.lit(i).alias("i"), (head + second).alias("key")))
        flips = [F.when(second.bitwiseAND(F.lit(1 << b)) == 0, head + second + F.lit(1 << b)) for b in range(w2)]
        probes.append(F.array_compact(F.array(head + second, *flips)))
    index = fps.select(fp.alias("a"), F.explode(F.array(*keys)).alias("k")).select("a", "k.i", "k.key")
    probe = fps.select(fp.alias("b"), F.explode(F.concat(*probes)).alias("key"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    near = (F.bit_count(x) <= distance) & (F.col("a") != F.col("b"))
    chain = F.lit(True)
    for i in range(m):
        ring = [parts[(i + j) % m] for j in range(m)]
        ok, total = F.lit(True), F.lit(0)
        for n, (o, w) in enumerate(ring[:-1], 1):
            total = total + F.bit_count(_part(x, o, w))
            if n > 2:
                ok = ok & (total <= n * distance // m)
        chain = chain & ((F.col("i") != i) | ok)
    return index.hint("merge").join(probe.hint("merge"), "key").where(chain & near).select("a", "b")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4,
                    distance: int = 4) -> DataFrame:
    """doc_id, fp, component_id: the smallest id that links of ``distance`` bits or fewer lead to.

    Equal fingerprints are merged before anything is paired, so exact copies cost one counted row per task. Texts
    without words have fingerprint zero and are linked like any other. Rows with equal ids keep their own fingerprint;
    rows with a null id take no part. Empty input gives an empty result.
    """
    docs = reliable(fingerprints(df.where(F.col(doc_id).isNotNull()), doc_id, text, width))
    node = docs.groupBy("fp").agg(F.min("doc_id").alias("first"))
    pairs = links(node.select("fp"), distance)
    for end in ("a", "b"):
        pairs = pairs.join(node.select(F.col("fp").alias(end), F.col("first").alias("first_" + end)), end)
    roots = components(pairs.select(F.col("first_a").alias("a"), F.col("first_b").alias("b")))
    named = node.join(roots, F.col("first") == F.col("node"), "left")
    named = named.select("fp", F.coalesce("root", "first").alias("component_id"))
    return docs.join(named, "fp").select("doc_id", "fp", "component_id")
