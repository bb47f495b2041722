"""Texts whose sets of word shingles have a Jaccard similarity of 0.8 or more, by T-occurrence search.

Sets of n and m shingles are that similar if they share T = ceil(0.8 (n + m) / 1.8). A search takes one set as query: every
shingle has an inverted list of the documents that hold it, and wanted are documents on at least T of the query's lists.
DivideSkip sets the L longest lists aside, merges the short ones with a heap that skips what cannot reach T - L, and looks
the candidates up in the long ones by binary search.

The lists are not held in one place. Spark first finds documents that can have a partner. With shingles ordered by hash, a
set's first n - ceil(0.8 n) + 1 + n/16 shingles share 1 + ceil(0.8 n)/16 with those of any partner; and at least ceil(0.8 n)
of all its shingles occur in other documents that remain. Of those that are left, the longest lists are set aside for
every document alike, by ordering shingles from rare to frequent and keeping as many of the rarest. What meets on these
short lists is searched in cells of bounded size, in two rounds: every document against the smallest one it meets, which
joins groups of copies at one comparison a member, and then documents that meet others outside their component against
all of these.
"""

from __future__ import annotations

import gc
import heapq
from bisect import bisect_left
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.stage import drop_stage, stage
from .common import keyed
from .components import components, reliable

WIDTH = 5
PERCENT = 80
SEED = 42
#: Shingles that a cell holds on each side, a document more or less.
CELL = 1 << 18
#: Prefixes are longer than the shortest possible ones by this part of the set, so that partners share more than one shingle.
_LONGER = 16
#: Weight of a list's length when the number of long lists is chosen.
_MU = 0.01
#: Shingles of a bucket in which they are counted, and how many a task holds before it deals them to the buckets.
_BUCKET, _HELD = 1 << 15, 1 << 20
#: Most bits of the filter that tells whose texts to read again; beyond 16 bits an id it lets more pass, never fewer.
_FILTER_BITS = 26


# --------------------------------------------------------------------------- search


def merge_skip(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
    """Numbers that stand on at least ``least`` of the rising lists, and on how many."""
    heap = [(own[0], i) for i, own in enumerate(lists) if own]
    heapq.heapify(heap)
    at = [0] * len(lists)
    while len(heap) >= least:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= least:
            yield top, len(popped)
            for i in popped:
                at[i] += 1
        else:
            # fewer than ``least`` lists hold anything below what is then on top: all of them may skip to it
            while heap and len(popped) < least - 1:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                return
            top = heap[0][0]
            for i in popped:
                at[i] = bisect_left(lists[i], top, at[i])
        for i in popped:
            if at[i] < len(lists[i]):
                heapq.heappush(heap, (lists[i][at[i]], i))


class Index:
    """Inverted lists over the sets of a cell. Documents are numbers 0, 1, ...; ``sizes`` are those of the whole sets."""

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT) -> None:
        self.sizes = [len(s) for s in sets]
        self._percent = percent
        hashes = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(hashes, kind="stable")
        self._docs = doc[order]
        self._hashes, self._from = np.unique(hashes[order], return_index=True)
        self._to = np.append(self._from[1:], len(hashes))

    def needed(self, n: int, m: int) -> int:
        return -(-self._percent * (n + m) // (100 + self._percent))

    def search(self, query: np.ndarray) -> list[int]:
        """The documents whose sets are similar to the query's."""
        n = len(query)
        least = max(1, self.needed(n, -(-self._percent * n // 100)))
        if not len(self._hashes):
            return []
        at = np.minimum(np.searchsorted(self._hashes, query), len(self._hashes) - 1)
        at = at[self._hashes[at] == query]
        if len(at) < least:
            return []
        start, stop = self._from[at], self._to[at]
        order = np.argsort(stop - start, kind="stable")
        longest = int(stop[order[-1]] - start[order[-1]])
        n_long = min(least - 1, int(least / (_MU * log2(max(longest, 2)) + 1)))
        cut = len(at) - n_long
        short = [self._docs[a:b].tolist() for a, b in zip(start[order[:cut]].tolist(), stop[order[:cut]].tolist())]
        # the most frequent first: they are the likeliest to hold a candidate
        long = [(self._docs, a, b) for a, b in zip(start[order[cut:]][::-1].tolist(), stop[order[cut:]][::-1].tolist())]
        found = []
        for doc, count in merge_skip(short, least - n_long):
            m = self.sizes[doc]
            need = self.needed(n, m)
            if 100 * min(n, m) < self._percent * max(n, m):
                continue
            for left, (docs, a, b) in zip(range(len(long), 0, -1), long):
                if count >= need or count + left < need:
                    break
                k = bisect_left(docs, doc, a, b)
                count += k < b and docs[k] == doc
            if count >= need:
                found.append(doc)
        return found


def _searched(index: DataFrame, queries: DataFrame, percent: int) -> DataFrame:
    """Links a, b of nodes with different roots, found inside cells. Both sides: cell, node, root, set."""
    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        sets = [s.values.to_numpy() for s in left.column("set")] if right.num_rows else []
        own = Index(sets, percent)
        nodes, roots = left.column("node").to_pylist(), left.column("root").to_pylist()
        a, b = [], []
        for node, root, s in zip(right.column("q_node").to_pylist(), right.column("q_root").to_pylist(), right.column("q_set") if sets else []):
            for doc in own.search(s.values.to_numpy()):
                if roots[doc] != root:
                    a.append(node)
                    b.append(nodes[doc])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    # names of their own: both sides read the same table of sets
    asked = queries.select("cell", *(F.col(c).alias("q_" + c) for c in ("node", "root", "set"))).toDF("q_cell", "q_node", "q_root", "q_set")
    return index.groupBy("cell").cogroup(asked.groupBy("q_cell")).applyInArrow(one, "a long, b long")


# --------------------------------------------------------------------------- sets


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Distinct XXH64 of the word shingles in rising unsigned order; a shorter text is one shingle, an empty one has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    n = max(1, len(words) - width + 1)
    spans = zip((end - size)[:n].tolist(), end[min(width, len(words)) - 1:].tolist())
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[i:j], SEED) for i, j in spans), np.uint64, n)).view(np.int64)


def _name(s: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(s.tobytes(), SEED)


def prefix(n: int, percent: int = PERCENT) -> int:
    """Shingles of a set that are compared first."""
    return n - -(-percent * n // 100) + 1 + n // _LONGER if n else 0


def _least(n: Column, percent: int) -> Column:
    """How many shingles the prefix of a set of n shares with that of any partner."""
    smallest = F.floor((n * percent + 99) / 100)
    return F.floor(smallest / _LONGER) + 1


def _read(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Of every row its id, the number of shingles, a digest of the set, and the prefix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingles(t, width) for t in part.column("text").to_pylist()]
                first = [s[:prefix(len(s), percent)] for s in sets]
                ends = np.append(0, np.cumsum([len(p) for p in first]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(_name, sets), pa.binary()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(first)))],
                    names=["row", "doc_id", "n", "same", "prefix"])

    return rows.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, n long, same binary, prefix array<long>")


def _dealt(postings: DataFrame, n_buckets: int) -> DataFrame:
    """Rows (row, list of hashes) as blobs by bucket: the low half of each hash and its row. The bucket is the high half's.

    A hash that comes again before a task deals out goes along once, marked as shared; its other rows go to any bucket as
    counts. So a hash of any frequency reaches its bucket as often as tasks deal out, and no more.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            lists = batch.column(1)
            held.append((np.repeat(batch.column(0).to_numpy(), lists.value_lengths().to_numpy()), lists.flatten().to_numpy().view(np.uint64)))
            size += len(held[-1][1])
            if size >= _HELD:
                yield from out(held)
                held, size = [], 0
        yield from out(held)

    def out(held: list) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        node, h = (np.concatenate(c) for c in zip(*held))
        own, first, again, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        shared = times[again] > 1
        rest = np.ones(len(h), bool)
        rest[first] = False
        counted, count = np.unique(node[rest], return_counts=True)
        first.sort()
        node, h, shared = node[first], h[first], shared[first]
        bucket = ((h >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        low = h.astype(np.uint32)[order]
        node, shared, bucket = node[order], shared[order], bucket[order]
        at = np.flatnonzero(np.diff(bucket, prepend=-1))
        rows = [(b, low[i:j].tobytes(), np.diff(node[i:j], prepend=0).tobytes(), np.packbits(shared[i:j]).tobytes(), b"", b"")
                for b, i, j in zip(bucket[at].tolist(), at.tolist(), [*at[1:].tolist(), len(bucket)])]
        step = -(-len(counted) // n_buckets) or 1
        rows += [(b, b"", b"", b"", counted[i:i + step].tobytes(), count[i:i + step].tobytes()) for b, i in enumerate(range(0, len(counted), step))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 5))] if rows else
                                         [pa.array([], t) for t in (pa.int32(), *[pa.binary()] * 5)], names=["bucket", "low", "node", "shared", "counted", "count"])

    return postings.mapInArrow(run, "bucket int, low binary, node binary, shared binary, counted binary, count binary")


def _shared_counts(postings: DataFrame, total: int) -> DataFrame:
    """node, c: how many of its hashes other rows have too, of rows (row, list of distinct hashes) with ``total`` hashes in all.

    Hashes of a bucket are told apart by 32 bits, so a count can be too high by about one in 30,000, never too low.
    """
    n_buckets = 1 + total // _BUCKET
    n_ranges = 1 + n_buckets // 16

    def joined(group: pa.Table, name: str, kind) -> np.ndarray:
        return np.frombuffer(b"".join(group.column(name).to_pylist()), kind)

    def one(group: pa.Table) -> pa.Table:
        low = joined(group, "low", np.uint32)
        node = [np.cumsum(np.frombuffer(x, np.int64)) for x in group.column("node").to_pylist()]
        known = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(n)) for x, n in zip(group.column("shared").to_pylist(), node)]
        node, known = np.concatenate(node).astype(np.int64), np.concatenate(known).astype(bool)
        _, again, times = np.unique(low, return_inverse=True, return_counts=True)
        own, c = np.unique(node[(times[again] > 1) | known], return_counts=True)
        own, c = np.concatenate([own, joined(group, "counted", np.int64)]), np.concatenate([c, joined(group, "count", np.int64)])
        # counts of a document meet where its number sends them, packed like the hashes
        range_of = ((own.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) * np.uint64(n_ranges) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(range_of, kind="stable")
        own, c, range_of = own[order], c[order], range_of[order]
        at = np.flatnonzero(np.diff(range_of, prepend=-1))
        ends = [*at[1:].tolist(), len(range_of)]
        return pa.table({"range": pa.array(range_of[at], pa.int32()), "node": pa.array([own[i:j].tobytes() for i, j in zip(at.tolist(), ends)], pa.binary()),
                         "c": pa.array([c[i:j].tobytes() for i, j in zip(at.tolist(), ends)], pa.binary())})

    def two(group: pa.Table) -> pa.Table:
        own, again = np.unique(joined(group, "node", np.int64), return_inverse=True)
        c = np.bincount(again, weights=joined(group, "c", np.int64), minlength=len(own)).astype(np.int64)
        return pa.table({"node": pa.array(own, pa.int64()), "c": pa.array(c, pa.int64())})

    parts = _dealt(postings, n_buckets).groupBy("bucket").applyInArrow(one, "range int, node binary, c binary")
    return parts.groupBy("range").applyInArrow(two, "node long, c long")


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    """Two bits of the filter for every id."""
    h = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    g = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return np.concatenate([h >> np.uint64(64 - bits), g >> np.uint64(64 - bits)]).astype(np.int64)


def _filter(ids: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Bits of all ids (one long column): at most 2^26, whatever their number. Tasks send the parts that they have set."""
    bits = min(_FILTER_BITS, max(16, int(16 * n).bit_length()))
    width = min(1 << 16, (1 << bits) // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.zeros(1 << bits, bool)
        for batch in batches:
            field[_places(batch.column(0).to_numpy(), bits)] = True
        parts = np.packbits(field).reshape(-1, width)
        some = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([parts[i].tobytes() for i in some], pa.binary())], names=["part", "bits"])

    def both(group: pa.Table) -> pa.Table:
        out = np.zeros(width, np.uint8)
        for x in group.column("bits"):
            out |= np.frombuffer(x.as_py(), np.uint8)
        return pa.table({"part": group.column("part").slice(0, 1).cast(pa.int32()), "bits": pa.array([out.tobytes()], pa.binary())})

    field = np.zeros(((1 << bits) // 8 // width, width), np.uint8)
    for r in ids.mapInArrow(run, "part int, bits binary").groupBy("part").applyInArrow(both, "part int, bits binary").collect():
        field[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return field.ravel(), bits


def _whole(src: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node, n, set of the wanted nodes (node, n, doc_id, same), from their texts. The other texts are not shuffled."""
    packed, bits = _filter(wanted.select("doc_id"), wanted.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.unpackbits(packed).astype(bool)
        for batch in batches:
            hit = field[_places(batch.column("doc_id").to_numpy(), bits)].reshape(2, -1).all(0)
            some = batch.filter(pa.array(hit))
            for at in range(0, some.num_rows, 128):
                sets = [shingles(t, width) for t in some.column("text").slice(at, 128).to_pylist()]
                ends = np.append(0, np.cumsum([len(s) for s in sets]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(map(_name, sets), pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))],
                    names=["same", "set"])

    sets = src.select("doc_id", "text").mapInArrow(run, "same binary, set array<long>").join(wanted.select("same", "node", "n"), "same")
    return sets.dropDuplicates(["same"]).select("node", "n", "set")


# --------------------------------------------------------------------------- cells


def _cut(weights: DataFrame, key: str) -> DataFrame:
    """``weights`` (key, w, v: shingles of both sides) with its cells: ``many`` and ``more``, 1 where the key shares a cell, and that cell."""
    split = lambda c: F.ceil(F.col(c) / CELL).cast("int")
    light = weights.where((F.col("w") <= CELL) & (F.col("v") <= CELL)).agg(F.coalesce(F.sum("w") + F.sum("v"), F.lit(0)).alias("s")).first()["s"]
    shared = F.concat(F.lit("s"), F.pmod(F.xxhash64(key), F.lit(1 + light // (2 * CELL))).cast("string"))
    own = F.concat(F.lit("k"), F.col(key).cast("string"))
    alone = (F.col("w") > CELL) | (F.col("v") > CELL)
    return weights.select(key, F.when(alone, own).otherwise(shared).alias("base"),
                          F.when(alone, split("w")).otherwise(1).alias("many"), F.when(alone, split("v")).otherwise(1).alias("more"))


def _side(members: DataFrame, cells: DataFrame, key: str, sets: DataFrame, query: bool) -> DataFrame:
    """cell, node, root, set: members (key, node, root) dealt to the cells of their key, and to all of the other side's parts."""
    mine, others = ("more", "many") if query else ("many", "more")
    part = F.pmod(F.xxhash64("node"), F.col(mine)).cast("string")
    other = F.explode(F.sequence(F.lit(0), F.col(others) - 1))
    dealt = members.join(cells, key).select("node", "root", "base", part.alias("part"), other.alias("other"))
    ends = ("other", "part") if query else ("part", "other")
    dealt = dealt.select("node", "root", F.concat_ws("-", "base", *(F.col(e).cast("string") for e in ends)).alias("cell")).distinct()
    return dealt.join(sets.select("node", "set"), "node").select("cell", "node", "root", "set")


def _sizes(members: DataFrame, key: str, sets: DataFrame, name: str) -> DataFrame:
    return members.select(key, "node").distinct().join(sets.select("node", "n"), "node").groupBy(key).agg(F.sum("n").alias(name))


def _tidy(df: DataFrame) -> DataFrame:
    """``df``, a written table, after Spark has been told to remove shuffle files that nothing refers to any more.

    It does so when the driver's JVM collects garbage, and a driver that only plans seldom has cause to.
    """
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df


def _round(index: DataFrame, queries: DataFrame, key: str, sets: DataFrame, percent: int) -> DataFrame:
    """Links between queries and index members (both: key, node, root) of equal key."""
    weights = _sizes(index, key, sets, "w").join(_sizes(queries, key, sets, "v"), key)
    weights = stage(weights, "weights")
    cells = stage(_cut(weights, key), "cells")
    links = stage(_searched(_side(index, cells, key, sets, False), _side(queries, cells, key, sets, True), percent), "links")
    for old in (weights, cells):
        drop_stage(old)
    return _tidy(links)


# --------------------------------------------------------------------------- join


def _total(df: DataFrame, column: str) -> int:
    return df.agg(F.coalesce(F.sum(F.size(column).cast("long")), F.lit(0)).alias("s")).first()["s"]


def _short(sets: DataFrame, percent: int) -> DataFrame:
    """hash, node, n: the short lists that each document keeps, of documents that can have a partner.

    These have ceil(0.8 n) shingles or more that others have too, counted again among those that remain. Shingles are
    ordered by how many of them have one; lists of a single document would come first, and need not be stored.
    """
    smallest = F.floor((F.col("n") * percent + 99) / 100)
    for again in range(2):
        counts = _shared_counts(sets.select("node", "set"), _total(sets, "set"))
        enough = counts.join(sets.select("node", "n"), "node").where(F.col("c") >= smallest).select("node")
        before, sets = sets, _tidy(stage(sets.join(reliable(enough), "node", "left_semi"), "whole"))
        if again:
            drop_stage(before)
    full = sets.select("node", "n", F.explode("set").alias("hash"))
    often = stage(full.groupBy("hash").agg(F.count("*").alias("often")).where("often > 1"), "often")
    lists = full.join(often, "hash").groupBy("node").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("often", "hash"))).alias("lists"))
    first = F.size("lists") - smallest + 1 + F.floor(F.col("n") / _LONGER)
    lists = lists.where(F.size("lists") >= smallest).select("node", "n", F.explode(F.slice("lists", F.lit(1), first.cast("int"))).alias("l"))
    met = _met(lists.select(F.col("l.hash").alias("hash"), "node", "n"), percent)
    for old in (sets, often):
        drop_stage(old)
    return met


def _met(held: DataFrame, percent: int) -> DataFrame:
    """Of postings (hash, node, n) those that two nodes share, of nodes that share as many as a partner asks for."""
    held = stage(held, "held")
    again = held.groupBy("hash").agg(F.count("*").alias("c")).where("c > 1").select("hash")
    both = reliable(held.join(reliable(again), "hash", "left_semi"))
    some = both.groupBy("node").agg(F.count("*").alias("c"), F.max("n").alias("n")).where(F.col("c") >= _least(F.col("n"), percent))
    met = stage(both.join(reliable(some.select("node")), "node", "left_semi"), "met")
    drop_stage(held)
    return _tidy(met)


def _roots(links: DataFrame) -> DataFrame:
    return _tidy(reliable(components(links)))


def near_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links lead to) of every row.

    Words end at ASCII white space, ASCII letters are lower-cased, a shingle is ``width`` words; a text with fewer words is
    one shingle, and one without words (null too) has none and is linked with nothing. Two sets are linked if 100 times
    their intersection is ``percent`` times their union or more. Shingles are compared as 64-bit hashes, equal sets as
    128-bit hashes. Rows with equal ids are texts of their own; those with a null id take no part. Equal sets are merged
    before anything is searched. An empty table gives an empty result.
    """
    src = keyed(df, doc_id, text).toDF("doc_id", "text").where("doc_id IS NOT NULL")
    read = stage(_read(src.withColumn("row", F.monotonically_increasing_id()), width, percent), "sets")
    classes = stage(read.where("n > 0").groupBy("same").agg(F.min("row").alias("node"), F.min("doc_id").alias("first")), "classes")
    copies = reliable(read.join(classes, "same").where("row <> node").select("row"))
    own = read.join(copies, "row", "left_anti")
    counts = _shared_counts(own.where("n > 0").select("row", "prefix"), _total(read, "prefix"))
    some = counts.join(read.select(F.col("row").alias("node"), "n", "doc_id", "same"), "node").where(F.col("c") >= _least(F.col("n"), percent))
    sets = _tidy(stage(_whole(src, reliable(some.select("node", "n", "doc_id", "same")), width), "whole"))
    met = _short(sets, percent)

    # every document against the smallest ones it meets
    stars = reliable(met.groupBy("hash").agg(F.min("node").alias("star")))
    toward = met.join(stars, "hash").where("node <> star").groupBy("node", "star").agg(F.count("*").alias("c"), F.max("n").alias("n"))
    toward = reliable(toward.where(F.col("c") >= _least(F.col("n"), percent)).select("star", "node", F.col("node").alias("root")))
    centre = toward.select("star").distinct().select("star", F.col("star").alias("node"), F.col("star").alias("root"))
    links = _round(centre, toward, "star", sets, percent)

    # documents that meet others outside their component against all that these meet
    root = _roots(links)
    named = stage(met.join(root, "node", "left").select("hash", "node", "n", F.coalesce("root", "node").alias("root")), "named")
    mixed = named.groupBy("hash").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("hash")
    every, named = named, _met(named.join(reliable(mixed), "hash", "left_semi"), percent)
    drop_stage(every)
    star = reliable(named.groupBy("hash").agg(F.min("node").alias("star")))
    field = _roots(named.join(star, "hash").select(F.col("node").alias("a"), F.col("star").alias("b")).distinct())
    members = stage(named.select("node", "root").distinct().join(field.withColumnRenamed("root", "field"), "node"), "members")
    main = members.groupBy("field", "root").agg(F.count("*").alias("c")).groupBy("field").agg(F.max_by("root", F.struct("c", "root")).alias("main"))
    queries = reliable(members.join(main, "field").where("root <> main").select("field", "node", "root"))
    links = links.unionByName(_round(members.select("field", "node", "root"), queries, "field", sets, percent))

    root = _roots(links)
    classes = classes.join(root, "node", "left").select("same", "first", F.coalesce("root", "node").alias("root"))
    smallest = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = reliable(classes.join(smallest, "root").select("same", "component_id"))
    alone = read.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return read.where("n > 0").join(classes, "same").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)
