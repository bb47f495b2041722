"""A hierarchical Pitman-Yor language model over word pairs, kept in distributed tables.

Tokens are words and an end for every text. The word before a token is its context; every context seen has a restaurant
of its own, with a dish for every word seen after it, and all these restaurants share one parent, the restaurant of
single words over a uniform base of the V training words and one unknown word. So every context gives a distribution
over the outcomes of add-one smoothing, and what the model holds grows with the corpus: a row for every distinct pair.

Seatings are sampled by Gibbs, a dish at a time: given the parent's probability and the other tables of its restaurant,
the number of tables of a dish is drawn from its exact conditional (generalised Stirling numbers) up to ``EXACT``
customers, and from a normal distribution at the saddle point of these numbers beyond.
Pairs seen once have one table for certain, and only the others are sampled. Tables are customers of the parent.
Probabilities are averaged over samples through the mean tables of dishes, contexts and words.

Pairs are counted and seated in cells. A cell is a row whose columns hold sorted arrays: the places of its pairs seen once,
and places, customers and tables of the others. Cells are as many as the tokens ask for. A pair of a word with a rank and
one without, seen once, lies in the cell of the latter, where that word's totals are sent; the few others that hold a word
without a rank are rows of their own and meet totals in joins.

A probability is the context's share of its parent, times the parent's probability, times a factor of the pair that is
one for pairs never seen. So the score of a text is a sum over its words and pairs; pairs that tasks do not hold meet their cell.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat
from math import gcd

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.stage import drop_stage, stage

#: Words whose numbers, and pairs whose terms, every task holds: the most frequent ones, words of at most LONGEST bytes.
#: All others take the joins, with equal results.
FREQUENT, LONGEST = 1 << 17, 32
STRENGTH = 1.0
BURN_IN, SAMPLES = 1, 2
#: Customers of a dish up to which its tables are drawn from tabulated probabilities.
EXACT = 512
#: Bytes of texts whose words are counted together.
_HELD = 1 << 25
#: Bytes, and texts at most, that are read at once, and whose requests go to the cells together.
_BLOCK, _TEXTS = 1 << 22, 1 << 16
#: Tokens of the training texts for which there is one cell.
CELL = 1 << 21
#: Numbers of words that have no rank: this bit and 62 bits of XXH64.
_RARE = 1 << 62
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def _parts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows in tables of up to ``size`` bytes of texts, or with one text that goes beyond, and at most ``_TEXTS`` rows."""
    held, held_bytes, held_rows = [], 0, 0
    for batch in batches:
        ends = np.append(0, np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)))
        at = 0
        while at < batch.num_rows:
            fits = int(np.searchsorted(ends, ends[at] + size - held_bytes, "right")) - 1
            stop = min(max(fits, at + 1), at + _TEXTS - held_rows, batch.num_rows)
            held.append(batch.slice(at, stop - at))
            held_bytes, held_rows, at = held_bytes + int(ends[stop] - ends[at]), held_rows + stop - at, stop
            if held_bytes >= size or held_rows == _TEXTS or at < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, held_bytes, held_rows = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _tokens(texts: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The words of texts without nulls in lower case, each text closed by an empty word, and the number of tokens of each."""
    texts = pa.concat_arrays(texts.chunks).cast(pa.large_binary())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data or b"", np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    solid = ~_BLANK[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begin = ends[:-1][ends[:-1] < len(data)]
    first[begin] = solid[begin]
    before = np.searchsorted(np.nonzero(first)[0], ends)  # words that begin before a text does
    letters = _LOWER[data[solid]]
    at = np.append(np.nonzero(first[solid])[0], len(letters)).astype(np.int32)
    at = np.append(np.insert(at[:-1], before[1:], at[before[1:]]), at[-1])
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(letters)]), np.diff(before) + 1


def _stirling(most: int, discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: row n, column t, in how many weighted ways n customers fill t tables."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[0, 0] = 0.0
    t = np.arange(most + 1)
    for n in range(most):
        with np.errstate(invalid="ignore", divide="ignore"):
            stay = s[n] + np.log(np.maximum(n - discount * t, 0))
        s[n + 1, 1:] = np.logaddexp(s[n, :-1], stay[1:])
    return s


class Seating:
    """Draws numbers of tables for one discount."""

    def __init__(self, discount: float, rng: np.random.Generator) -> None:
        self.discount, self.rng = discount, rng
        self.sizes = (8, 64, EXACT)
        self.log = _stirling(EXACT, discount)

    def draw(self, customers: np.ndarray, others: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Tables of dishes, given the tables of other dishes in the restaurant and the parent's probability of the dish."""
        out = np.minimum(customers, 1).astype(np.int64)
        low = 1
        for high in self.sizes:
            for rows in _blocks(np.nonzero((customers > low) & (customers <= high))[0], (1 << 20) // high):
                out[rows] = self._tabled(customers[rows], others[rows], p[rows], high)
            low = high
        for rows in _blocks(np.nonzero(customers > EXACT)[0], 2048):
            out[rows] = self._many(customers[rows], others[rows], p[rows])
        return out

    def _tabled(self, customers: np.ndarray, others: np.ndarray, p: np.ndarray, most: int) -> np.ndarray:
        opened = np.log(STRENGTH + self.discount * (others[:, None] + np.arange(most))) + np.log(p)[:, None]
        weight = self.log[customers, 1:most + 1] + np.cumsum(opened, 1)
        weight = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), 1)
        return 1 + (weight < self.rng.random((len(p), 1)) * weight[:, -1:]).sum(1)

    def _many(self, customers: np.ndarray, others: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Beyond the tabulated numbers: few tables hardly depend on the customers, many have a normal distribution
        around the saddle point of the numbers' generating function."""
        d = self.discount

        def slope(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Tables whose saddle point is 1 - exp(-x), and the slope of their log weight there."""
            grown = -np.expm1(-d * x) / d
            t = customers * grown / (-np.expm1(-x) * np.exp((1 - d) * x))
            return t, np.log(grown) + np.log((STRENGTH + d * (others + t)) * p / t)

        # the slope rises with x, while the tables fall
        low, high = np.full(len(p), 1e-9), np.full(len(p), 700.0)
        for _ in range(60):
            x = (low + high) / 2
            up = slope(x)[1] < 0
            low, high = np.where(up, x, low), np.where(up, high, x)
        (t0, g0), (t1, g1) = slope(x * 0.999), slope(x * 1.001)
        t = slope(x)[0]
        spread = np.sqrt(np.maximum((t0 - t1) / np.maximum(g1 - g0, 1e-300), 0))
        out = np.clip(np.rint(t + 0.5 + spread * self.rng.standard_normal(len(t))), 1, customers).astype(np.int64)
        few = np.nonzero(t < 12)[0]
        out[few] = self._tabled(np.full(len(few), EXACT), others[few], p[few], EXACT)
        return out


def _blocks(rows: np.ndarray, size: int) -> Iterator[np.ndarray]:
    return (rows[at:at + size] for at in range(0, len(rows), size))


def word_counts(docs: DataFrame, text: Column) -> DataFrame:
    """word, c: how often each word occurs; the empty word counts the texts. Tasks add up, in blocks of bounded size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, _HELD):
            # a block's texts are cut into words by parts, which bounds what is held beside the words
            tokens = pa.chunked_array([_tokens(p.column("text"))[0] for p in _parts(iter(part.to_batches()), _BLOCK)])
            found = pc.value_counts(tokens)
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "c"])
        pa.default_memory_pool().release_unused()

    src = docs.select(text.cast("binary").alias("text"))
    return src.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _discount(ones: int, twos: int) -> float:
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


def _floor(sizes: DataFrame, most: int, of: Column | None = None) -> int | None:
    """The least ``c`` so that at most ``most`` rows reach it, a row standing for ``of`` rows; sizes are added up by
    sixteenths of a doubling."""
    step, of = F.floor(F.log2("c") * 16), F.lit(1) if of is None else of
    steps = sizes.groupBy(step.alias("s")).agg(F.sum(of).alias("n"), F.min("c").alias("c")).collect()
    floor, total = None, 0
    for r in sorted(steps, key=lambda r: -r["s"]):
        total += r["n"]
        if total > most:
            break
        floor = r["c"]
    return floor


def _lexicon(words: DataFrame, frequent: int) -> dict[bytes, int]:
    """Counts of the most frequent words by rank, the end of texts first. These words have their rank as number."""
    short = words.where((F.octet_length("word") <= LONGEST) & (F.col("word") != F.lit(b"")))
    floor = _floor(short, frequent)
    rows = [] if floor is None else [(bytes(r["word"]), r["c"]) for r in short.where(F.col("c") >= floor).collect()]
    end = [(b"", r["c"]) for r in words.where(F.col("word") == F.lit(b"")).collect()]
    return dict([*end, *sorted(rows, key=lambda x: (-x[1], x[0]))])


def _rare_numbers(words: list[bytes]) -> np.ndarray:
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(42)), np.uint64, len(words))
    return (hashes & np.uint64(_RARE - 1) | np.uint64(_RARE)).view(np.int64)


class Reader:
    """Turns texts into numbers of words."""

    def __init__(self, lexicon: dict[bytes, int]) -> None:
        self.words = pa.array(list(lexicon), pa.binary())

    def read(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Contexts and words of texts that are each closed by the empty word; places of the words without a rank, and these."""
        number = pc.fill_null(pc.index_in(tokens, self.words), -1).to_numpy().astype(np.int64)
        rare = np.nonzero(number < 0)[0]
        _, ends, letters = tokens.buffers()
        ends, letters = np.frombuffer(ends, np.int32), letters.to_pybytes()
        words = [letters[a:b] for a, b in zip(ends[rare].tolist(), ends[rare + 1].tolist())]
        number[rare] = _rare_numbers(words)
        # the last of the tokens ends a text, and a text begins after such an end
        return np.append(number[-1:], number[:-1]), number, rare, words


def rare_number(word: str) -> Column:
    """The number of a word without a rank."""
    return F.xxhash64(word).bitwiseAND(F.lit(_RARE - 1)).bitwiseOR(F.lit(_RARE))


def pair_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64 mixed bits of a pair; pairs are told apart by them when texts are scored."""
    x = u.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + w.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return (x ^ x >> np.uint64(31)).view(np.int64)


@dataclass(frozen=True)
class Grid:
    """Deals pairs of words with a rank to cells. A pair's place in its cell fits 32 bits."""
    ranked: int
    cells: int

    @classmethod
    def of(cls, ranked: int, tokens: int) -> "Grid":
        ranked = max(ranked, 1)
        cells = max(tokens // CELL, ranked * ranked >> 32) + 1
        while gcd(cells, ranked) > 1:  # so that the pairs of one context, or of one word, lie in all cells
            cells += 1
        return cls(ranked, cells)

    def deal(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Cell and place in one number, the cell in the upper half."""
        place, cell = np.divmod(u * self.ranked + w, self.cells)
        return cell << 32 | place

    def pairs(self, cell: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.divmod(cell + place.astype(np.int64) * self.cells, self.ranked)


def _pack(x: np.ndarray) -> bytes:
    """The steps of a column of integers, their lowest bytes first, then the next: small steps leave zeros to the codec."""
    step = np.diff(x, prepend=x.dtype.type(0))
    return step.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _array(packed: bytes | None, kind: type) -> np.ndarray:
    """What was packed."""
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(packed or b"", np.uint8).reshape(size, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


def _joined(packed: list[bytes | None], kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(_array(x, kind) for x in packed if x)])


def _split(cell: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
    """The parts of a column for every cell of a sorted column of cells."""
    return np.split(x, _runs(cell)[1:]) if len(cell) else []


def _pieces(cell: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """Every such cell, with its part of the arrays, packed."""
    return ((int(c[0]), *map(_pack, x)) for c, *x in zip(_split(cell, cell), *(_split(cell, a) for a in arrays)))


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new key begins in sorted columns."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = reduce(np.logical_or, (k[1:] != k[:-1] for k in keys))
    return np.nonzero(new)[0]


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [f.split()[0] for f in schema.split(", ")]
    columns = zip(*rows) if rows else ([] for _ in names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), _TYPES[f.split()[1]]) for c, f in zip(columns, schema.split(", "))], names=names)


_TYPES = {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _home(u: np.ndarray, w: np.ndarray, grid: Grid) -> np.ndarray:
    """The cell of pairs that hold a word without a rank: that of the word, the context's if both have none."""
    return np.where(u >= _RARE, u, w) % grid.cells


def _counted(docs: DataFrame, text: Column, lexicon: dict[bytes, int], grid: Grid) -> DataFrame:
    """cell, once, q, n, h, o, u, w, un: places of pairs seen once; places and numbers of pairs seen more often; pairs seen
    once of a word h without a rank and another that has one (o: twice the rank, and one more if h is the context);
    words and numbers of the other pairs. Tasks add up in bounded arrays, then every cell adds up its parts."""
    sent = "cell long, q binary, n binary, u binary, w binary, un binary"
    made = "cell long, once binary, q binary, n binary, h binary, o binary, u binary, w binary, un binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lexicon)
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            u, w = (np.concatenate(x) for x in zip(*held))
            rare = (u >= _RARE) | (w >= _RARE)
            key = np.sort(grid.deal(u[~rare], w[~rare]))
            first = _runs(key)
            n, key = np.diff(np.append(first, len(key))), key[first]
            rows = [(c, q, k, None, None, None) for c, q, k in _pieces(key >> 32, key.astype(np.uint32), n.astype(np.int64))]
            u, w = u[rare], w[rare]
            order = np.lexsort((w, u, _home(u, w, grid)))
            u, w = u[order], w[order]
            first = _runs(u, w)
            n, u, w = np.diff(np.append(first, len(u))), u[first], w[first]
            rows += [(c, None, None, *x) for c, *x in _pieces(_home(u, w, grid), u, w, n.astype(np.int64))]
            return _table(rows, sent)

        for part in _parts(batches, _BLOCK):
            u, w, *_ = reader.read(_tokens(part.column("text"))[0])
            held.append((u, w))
            size += len(u)
            if size > 1 << 20:
                yield out()
                held, size = [], 0
        if held:
            yield out()
        held = []
        pa.default_memory_pool().release_unused()

    def add(key: tuple, part: pa.Table) -> pa.Table:
        q, n, u, w, un = (_joined(part.column(c).to_pylist(), np.uint32 if c == "q" else np.int64) for c in ("q", "n", "u", "w", "un"))
        order = np.argsort(q, kind="stable")
        q, n = q[order], n[order]
        first = _runs(q)
        q, n = q[first], np.add.reduceat(n, first) if len(n) else n
        order = np.lexsort((w, u))
        u, w, un = u[order], w[order], un[order]
        first = _runs(u, w)
        u, w, un = u[first], w[first], np.add.reduceat(un, first) if len(un) else un
        near = (un == 1) & ((u < _RARE) | (w < _RARE))
        h, o = np.maximum(u, w)[near], 2 * np.minimum(u, w)[near] + (u >= _RARE)[near]
        order, far = np.lexsort((o, h)), ~near
        row = (key[0].as_py(), *map(_pack, (q[n == 1], q[n > 1], n[n > 1], h[order], o[order], u[far], w[far], un[far])))
        return pa.Table.from_batches([_table([row], made)])

    src = docs.select(text.cast("binary").alias("text"))
    return src.mapInArrow(run, sent).groupBy("cell").applyInArrow(add, made)


def _near(h: bytes | None, o: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and words of the pairs of columns h and o."""
    h, o = _array(h, np.int64), _array(o, np.int64)
    return np.where(o & 1, h, o >> 1), np.where(o & 1, o >> 1, h)


def _rare_pairs(cells: DataFrame) -> DataFrame:
    """u, w, n of the pairs that are rows of their own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("u", "w", "un"))):
                yield pa.RecordBatch.from_arrays([pa.array(_array(x, np.int64)) for x in row], names=["u", "w", "n"])

    return cells.select("u", "w", "un").where(F.octet_length("u") > 0).mapInArrow(run, "u long, w long, n long")


def _tally(cells: DataFrame, rare: DataFrame) -> DataFrame:
    """c, k: how many pairs were seen how often."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for once, h, n in zip(*(batch.column(c).to_pylist() for c in ("once", "h", "n"))):
                c, k = np.unique(_array(n, np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(1, c)), pa.array(np.append(len(once) // 4 + len(h) // 8, k))], names=["c", "k"])

    one = F.lit(1).cast("long")
    both = cells.select("once", "h", "n").mapInArrow(run, "c long, k long").unionByName(rare.select(F.col("n").alias("c"), one.alias("k")))
    return both.groupBy("c").agg(F.sum("k").alias("k")).where("k > 0")


def _unpacked(cell: int, once: bytes | None, h: bytes | None, o: bytes | None, q: bytes | None, n: bytes | None, s: bytes | None,
              grid: Grid, least: int = 1) -> tuple[np.ndarray, ...]:
    """u, w, n, t of the pairs of a cell that were seen ``least`` times or more."""
    n, q = _array(n, np.int64), _array(q, np.uint32)
    more = n >= least
    alone = _array(once if least <= 1 else None, np.uint32)
    near = _near(h, o) if least <= 1 else (n[:0], n[:0])
    u, w = (np.append(*x) for x in zip(grid.pairs(cell, np.append(alone, q[more])), near))
    n = np.concatenate([np.ones(len(alone), np.int64), n[more], np.ones(len(near[0]), np.int64)])
    t = n.astype(float)
    t[n > 1] = _array(s, np.int64)[more] / SAMPLES
    return u, w, n, t


_CELL = ("cell", "once", "h", "o", "q", "n", "s")


def _cell_pairs(cells: DataFrame, grid: Grid) -> DataFrame:
    """u, w, n, t of the pairs of cells."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in _CELL)):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _unpacked(*row, grid)], names=["u", "w", "n", "t"])

    return cells.mapInArrow(run, "u long, w long, n long, t double")


def _let_go(df: DataFrame) -> None:
    """Ask Spark to remove the shuffle files of plans that nothing refers to any more."""
    df.sparkSession.sparkContext._jvm.System.gc()


def _sides(pairs: DataFrame, tables: Column) -> DataFrame:
    """id, t, m: tables of every word's restaurant as a context, and its customers in the restaurant of single words."""
    zero = F.lit(0.0)
    return pairs.select(F.col("u").alias("id"), tables.alias("t"), zero.alias("m")).unionByName(
        pairs.select(F.col("w").alias("id"), zero.alias("t"), tables.alias("m")))


def _cell_sides(cells: DataFrame, grid: Grid, per: int = 1) -> DataFrame:
    """The same of cells (cell, q, t, h, o), added up by task: one table for a pair without ``t``, else ``t / per`` less one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, m = np.zeros(grid.ranked), np.zeros(grid.ranked)
        for batch in batches:
            for cell, q, tables, h, o in zip(*(batch.column(c).to_pylist() for c in ("cell", "q", "t", "h", "o"))):
                u, w = grid.pairs(cell, _array(q, np.uint32))
                x = np.ones(len(u)) if tables is None else _array(tables, np.int64) / per - 1
                t += np.bincount(u, x, grid.ranked)
                m += np.bincount(w, x, grid.ranked)
                h, o = _array(h, np.int64), _array(o, np.int64)
                t += np.bincount(o[o & 1 == 0] >> 1, minlength=grid.ranked)
                m += np.bincount(o[o & 1 == 1] >> 1, minlength=grid.ranked)
                first = _runs(h)  # sorted, and no word has two cells
                after = np.append(0, np.cumsum(o & 1))
                context = after[np.append(first[1:], len(h))] - after[first] if len(h) else first
                alone = np.diff(np.append(first, len(h))) - context
                yield pa.RecordBatch.from_arrays([pa.array(h[first]), pa.array(context.astype(float)), pa.array(alone.astype(float))], names=["id", "t", "m"])
        some = np.nonzero((t != 0) | (m != 0))[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(t[some]), pa.array(m[some])], names=["id", "t", "m"])

    return cells.select("cell", "q", "t", "h", "o").mapInArrow(run, "id long, t double, m double")


def _added(*sides: DataFrame, **more: Column) -> DataFrame:
    totals = (F.sum("t").alias("t"), F.sum("m").alias("m"), *(c.alias(name) for name, c in more.items()))
    return reduce(DataFrame.unionByName, sides).groupBy("id").agg(*totals)


@dataclass(frozen=True)
class Parent:
    """The restaurant of single words. ``tables[i]`` are the mean tables of a word with ``count[i]`` customers."""
    count: np.ndarray
    tables: np.ndarray
    customers: float
    opened: float
    distinct: int
    discount: float

    def probability(self, m: np.ndarray) -> np.ndarray:
        """Of a word with ``m`` customers, 0 for the unknown one."""
        t = np.interp(m, self.count, self.tables, left=0.0) if len(self.count) else np.zeros(len(m))
        base = (STRENGTH + self.discount * self.opened) / (self.distinct + 1)
        return (m - self.discount * np.where(m > 0, t, 0) + base) / (STRENGTH + self.customers)


def _parent(sizes: list[tuple[float, int]], distinct: int, seed: int) -> Parent:
    """Sample the restaurant of single words. Its base is uniform, so words with equal customers are seated alike: a
    number of customers is seated several times and stands for all its words. Beyond ``EXACT``, mean tables are those
    of a grid of sixteenths of a doubling and lie between them elsewhere. ``sizes`` has the words of each number."""
    rng, draws = np.random.default_rng(seed), 4
    m, words = (np.array(x, float) for x in zip(*sizes)) if sizes else (np.zeros(0), np.zeros(0))
    most, small = m.max(initial=0), m[m <= EXACT]
    grid = EXACT * 2 ** (np.arange(16 * np.log2(most / EXACT) + 2) / 16) if most > EXACT else m[:0]
    at = np.unique(np.ceil(np.concatenate([np.floor(small), small, grid]))).astype(np.int64)
    ones, twos = (int(words[np.round(m) == k].sum()) for k in (1, 2))
    discount = _discount(ones, twos)
    mean, seats = np.minimum(at, 1).astype(float), Seating(discount, rng)
    for _ in range(BURN_IN + SAMPLES if len(at) else 0):
        opened = float((np.interp(m, at, mean) * words).sum())
        others = np.maximum(opened - mean, 0)
        drawn = seats.draw(np.repeat(at, draws), np.repeat(others, draws), np.full(len(at) * draws, 1 / (distinct + 1)))
        mean = drawn.reshape(-1, draws).mean(1)
    opened = float((np.interp(m, at, mean) * words).sum()) if len(at) else 0.0
    return Parent(at, mean, float((m * words).sum()), opened, distinct, discount)


@dataclass(frozen=True)
class Totals:
    """Tables and parent's customers by word: arrays for the words with a rank, rows id, t, m for the others. Those of
    ``still`` are in no pair seen more than once, so sampling does not change them; ``moved`` has the rest."""
    t: np.ndarray
    m: np.ndarray
    moved: DataFrame
    still: DataFrame
    parent: Parent

    @property
    def rare(self) -> DataFrame:
        return self.moved.unionByName(self.still)


def _sizes(sides: DataFrame) -> Counter:
    """How many words have how many customers."""
    return Counter({r["m"]: r["n"] for r in sides.where("m > 0").groupBy("m").agg(F.count("*").alias("n")).collect()})


def _totals(sides: DataFrame, still: DataFrame, still_sizes: Counter, ranked: int, distinct: int, seed: int) -> Totals:
    """Totals of ``sides``, which has all words but those of ``still``."""
    t, m = np.zeros(ranked), np.zeros(ranked)
    # at most one row a ranked word
    for r in sides.where(F.col("id") < _RARE).collect():
        t[r["id"]], m[r["id"]] = r["t"], r["m"]
    sizes = _sizes(sides) + still_sizes
    return Totals(t, m, sides.where(F.col("id") >= _RARE), still, _parent(sorted(sizes.items()), distinct, seed))


def _attached(pairs: DataFrame, moved: DataFrame, rare: DataFrame) -> DataFrame:
    """``pairs`` with the context's tables tu and the word's customers mw, NULL where a word has a rank: of ``moved`` for a
    pair of one word without a rank, which is a row only if seen more than once, and of ``rare`` for a pair of two."""
    null, u, w = F.lit(None).cast("double"), F.col("u") >= _RARE, F.col("w") >= _RARE
    t, m = (rare.select(F.col("id").alias(at), F.col(value).alias(name)) for at, value, name in (("u", "t", "tu"), ("w", "m", "mw")))
    # a pair of one word without a rank meets that word only, which has the greater number
    both = moved.select("id", F.col("t").alias("tu"), F.col("m").alias("mw"))
    one = pairs.where(u != w).withColumn("id", F.greatest("u", "w")).join(both, "id", "left").drop("id")
    one = one.withColumns({"tu": F.when(u, F.col("tu")), "mw": F.when(w, F.col("mw"))})
    two = pairs.where(u & w).join(t, "u", "left").join(m, "w", "left").select(one.columns)
    return pairs.where(~(u | w)).withColumns({"tu": null, "mw": null}).unionByName(one).unionByName(two)


def _filled(batch: pa.RecordBatch, totals: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    u, w, n = (batch.column(c).to_numpy() for c in ("u", "w", "n"))
    out = []
    for word, name, ranked in ((u, "tu", totals[0]), (w, "mw", totals[1])):
        value = batch.column(name).to_numpy(zero_copy_only=False).astype(float)
        has = word < _RARE
        value[has] = ranked[word[has]]
        out.append(value)
    return u, w, n, *out


def _sampled(state: DataFrame, totals: Totals, discount: float, keep: bool, seed: int) -> DataFrame:
    """One Gibbs step for every pair of ``state`` (u, w, n, t, s); s adds up the tables of kept samples."""
    ranked, parent = (totals.t, totals.m), totals.parent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seats = None
        for batch in batches:
            u, w, n, tu, mw = _filled(batch, ranked)
            if not len(u):
                continue
            # draws follow the pairs, so that a lost task draws the same again
            seats = seats or Seating(discount, np.random.default_rng([seed, int(pair_key(u[:1], w[:1])[0]) & _RARE - 1]))
            t, s = batch.column("t").to_numpy(), batch.column("s").to_numpy()
            drawn = seats.draw(n, np.maximum(tu - t, 0), parent.probability(mw))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (u, w, n, drawn, s + drawn if keep else s)],
                                             names=["u", "w", "n", "t", "s"])

    # pairs seen more than once, so of words that move
    return _attached(state, totals.moved, totals.moved).mapInArrow(run, "u long, w long, n long, t long, s long")


def _cells_sampled(state: DataFrame, totals: Totals, grid: Grid, discount: float, keep: bool, seed: int) -> DataFrame:
    """The same step for every cell of ``state`` (cell, q, n, t, s)."""
    t_all, m_all, parent = totals.t, totals.m, totals.parent
    schema = "cell long, q binary, n binary, t binary, s binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, q, *rest in zip(*(batch.column(c).to_pylist() for c in ("cell", "q", "n", "t", "s"))):
                n, t, s = (_array(x, np.int64) for x in rest)
                u, w = grid.pairs(cell, _array(q, np.uint32))
                t, s = t if len(t) else np.ones(len(n), np.int64), s if len(s) else np.zeros(len(n), np.int64)
                # draws follow the cell, so that a lost task draws the same again
                drawn = Seating(discount, np.random.default_rng([seed, cell])).draw(n, np.maximum(t_all[u] - t, 0), parent.probability(m_all[w]))
                yield _table([(cell, q, rest[0], _pack(drawn), _pack(s + drawn if keep else s))], schema)

    return state.mapInArrow(run, schema)


@dataclass(frozen=True)
class Model:
    """Counts of all training words, all pairs with their customers and mean tables, and the totals of words. Pairs lie
    in ``cells`` (cell, once, h, o, q, n, s), those that are rows of their own in ``rare`` (u, w, n, t)."""
    words: DataFrame
    cells: DataFrame
    rare: DataFrame
    grid: Grid
    tally: DataFrame
    tokens: int
    distinct: int
    lexicon: dict[bytes, int]
    totals: Totals
    discount: float
    frequent: int

    @property
    def pairs(self) -> DataFrame:
        """u, w, n, t of all pairs."""
        return _cell_pairs(self.cells, self.grid).unionByName(self.rare)

    def weight(self, tables: np.ndarray, customers: np.ndarray) -> np.ndarray:
        """The share of its parent in a context."""
        return _share(tables, customers, self.discount)


def fit(docs: DataFrame, text: str = "text", frequent: int = FREQUENT, seed: int = 7) -> Model:
    """Learn from every whole text; nulls count as empty. An empty table gives a model that knows no word."""
    content = F.coalesce(F.col(text), F.lit(""))
    counts = stage(word_counts(docs, content).where("c > 0"), "lm_words")
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    lexicon = _lexicon(counts, frequent)
    grid = Grid.of(len(lexicon), total["n"] or 0)
    cells = stage(_counted(docs, content, lexicon, grid), "lm_cells")
    _let_go(cells)
    pairs = stage(_rare_pairs(cells), "lm_pairs")
    tally = stage(_tally(cells, pairs), "lm_tally")
    seen = {r["c"]: r["k"] for r in tally.where("c <= 2").collect()}
    discount, v = _discount(seen.get(1, 0), seen.get(2, 0)), total["v"]
    void = F.lit(None).cast("binary")
    # words without a rank move only in pairs that are rows and seen more than once
    sides = [_cell_sides(cells.select("cell", F.col("once").alias("q"), void.alias("t"), "h", "o"), grid),
             _cell_sides(cells.select("cell", "q", *(void.alias(c) for c in "tho")), grid), _sides(pairs.where("n = 1"), F.lit(1.0))]
    sides = [s.withColumn("moves", F.col("id") < _RARE) for s in sides] + [_sides(pairs.where("n > 1"), F.lit(1.0)).withColumn("moves", F.lit(True))]
    begun = stage(_added(*sides, moves=F.max("moves")), "lm_sides")
    first, still = stage(begun.where("moves").drop("moves"), "lm_moved"), begun.where("NOT moves").drop("moves")
    still_sizes = _sizes(still)
    one = F.lit(1).cast("long")
    state = pairs.where("n > 1").select("u", "w", "n", one.alias("t"), (one - 1).alias("s"))
    packed = cells.where(F.octet_length("q") > 0).select("cell", "q", "n", void.alias("t"), void.alias("s"))
    totals, old = _totals(first, still, still_sizes, len(lexicon), v, seed), None
    for turn in range(BURN_IN + SAMPLES):
        keep, last = turn >= BURN_IN, turn == BURN_IN + SAMPLES - 1
        state = stage(_sampled(state, totals, discount, keep, seed + turn), "lm_state")
        packed = stage(_cells_sampled(packed, totals, grid, discount, keep, seed + turn), "lm_packed")
        mean = F.col("s") / SAMPLES if last else F.col("t").cast("double")
        tables = packed.select("cell", "q", F.col("s" if last else "t").alias("t"), void.alias("h"), void.alias("o"))
        sides = stage(_added(first, _cell_sides(tables, grid, SAMPLES if last else 1), _sides(state, mean - 1)), "lm_sides")
        totals = _totals(sides, still, still_sizes, len(lexicon), v, seed + turn + 1)
        for done in old or ():
            drop_stage(done)
        _let_go(state)
        old = (state, packed, sides)
    drop_stage(first)
    once = cells.select("cell", "once", "h", "o", *(void.alias(c) for c in "qns"))
    held = once.unionByName(packed.select("cell", *(void.alias(c) for c in ("once", "h", "o")), "q", "n", "s"))
    rare = pairs.where("n = 1").select("u", "w", "n", F.lit(1.0).alias("t")).unionByName(
        state.select("u", "w", "n", (F.col("s") / SAMPLES).alias("t")))
    return Model(counts, held, rare, grid, tally, total["n"] or 0, v, lexicon, totals, discount, frequent)


def _share(tables: np.ndarray, customers: np.ndarray, discount: float) -> np.ndarray:
    return (STRENGTH + discount * tables) / (STRENGTH + customers)


def _term(n: np.ndarray, t: np.ndarray, tu: np.ndarray, p: np.ndarray, discount: float) -> np.ndarray:
    return np.log10(1 + (n - discount * t) / ((STRENGTH + discount * tu) * p))


def terms(model: Model, pairs: DataFrame) -> DataFrame:
    """key, term, seen, cell of ``pairs``: log10 of the factor by which having been seen lifts a pair's probability."""
    ranked, parent, discount, grid = (model.totals.t, model.totals.m), model.totals.parent, model.discount, model.grid

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, w, n, tu, mw = _filled(batch, ranked)
            term = _term(n, batch.column("t").to_numpy(), tu, parent.probability(mw), discount)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (pair_key(u, w), term, n, _home(u, w, grid))], names=["key", "term", "seen", "cell"])

    return _attached(pairs, model.totals.moved, model.totals.rare).mapInArrow(run, "key long, term double, seen long, cell long")


def _top_terms(model: Model, far: DataFrame, floor: int | None) -> DataFrame:
    """key, term of the pairs with a number of ``floor`` or more. Of a cell's pairs without a rank there is none, or the
    corpus is so small that all pairs are held; those are left to their cells."""
    t, m, parent, discount, grid = model.totals.t, model.totals.m, model.totals.parent, model.discount, model.grid

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, once, q, n, s in zip(*(batch.column(c).to_pylist() for c in ("cell", "once", "q", "n", "s"))):
                u, w, n, tables = _unpacked(cell, once, None, None, q, n, s, grid, floor)
                term = _term(n, tables, t[u], parent.probability(m[w]), discount)
                yield pa.RecordBatch.from_arrays([pa.array(pair_key(u, w)), pa.array(term)], names=["key", "term"])

    often = F.col("seen") >= floor if floor is not None else F.lit(False)
    cells = model.cells if floor is not None else model.cells.limit(0)
    return cells.mapInArrow(run, "key long, term double").unionByName(far.where(often).select("key", "term"))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row; null texts count as empty.

    Words and pairs that tasks hold are scored where the text is read. The others go to their cells by blocks of texts, no
    pair among them being frequent; every cell sends a block the sums of its texts.
    """
    whole, lexicon, parent = float(model.tokens + model.distinct + 1), model.lexicon, model.totals.parent
    grid, discount = model.grid, model.discount
    floor = _floor(model.tally, model.frequent, F.col("k"))
    # written before the texts are dealt, so that the shuffle files of its joins are gone by then
    far = stage(terms(model, model.rare), "lm_terms")
    top = _top_terms(model, far, floor).toArrow()
    _let_go(docs)
    order = np.argsort(top.column("key").to_numpy())
    bits = (1 << 21) - 1
    top_key, top_term = (top.column(c).to_numpy()[order] for c in ("key", "term"))
    may = np.zeros(bits + 1, bool)
    may[top_key & bits] = True
    count = np.fromiter(lexicon.values(), np.int64, len(lexicon))
    word_term = np.log10(parent.probability(model.totals.m)) + np.log10(model.weight(model.totals.t, count))
    # a word as a context counts where it stands; the end of a text is the context of the next one's first word
    base_term = np.log10((count + 1) / whole)
    unknown = float(np.log10(parent.probability(np.zeros(1)))[0])

    sent = ("cell long, block long, d binary, q binary, key binary, word binary, at binary, "
            "ids array<long>, tokens binary, seen binary, base binary, p binary")
    back = "block long, cell long, d binary, ids array<long>, tokens binary, seen binary, base binary, p binary"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lexicon)
        for part in _parts(batches, _BLOCK):
            yield out(reader, part)

    def out(reader: Reader, part: pa.Table) -> pa.RecordBatch:
        tokens, length = _tokens(part.column("text"))
        n, name = len(length), part.column("r")[0].as_py()
        owner = np.repeat(np.arange(n), length)
        u, w, rare, words = reader.read(tokens)
        known = w < _RARE
        p, base = np.zeros(len(w)), np.zeros(len(w))
        p[known], base[known] = word_term[w[known]], base_term[w[known]]
        key = pair_key(u, w)
        miss = np.ones(len(key), bool)
        if len(top_key):
            some = np.nonzero(may[key & bits])[0]
            at = np.minimum(np.searchsorted(top_key, key[some]), len(top_key) - 1)
            hit = top_key[at] == key[some]
            p[some[hit]] += top_term[at[hit]]
            miss[some[hit]] = False
        ranked, d = known & (u < _RARE), owner.astype(np.uint16)
        ask = np.nonzero(miss & ranked)[0]
        dealt = grid.deal(u[ask], w[ask])
        order = np.argsort((dealt >> 32).astype(np.uint16 if grid.cells < 1 << 16 else np.int64), kind="stable")
        dealt, ask = dealt[order], ask[order]
        none = (None,) * 8
        rows = [(c, name, d, q.tobytes(), *none) for (c, d), q in zip(_pieces(dealt >> 32, d[ask]), _split(dealt >> 32, dealt.astype(np.uint32)))]
        ask = np.nonzero(miss & ~ranked)[0]
        ask = ask[np.argsort(_home(u[ask], w[ask], grid), kind="stable")]
        home = _home(u[ask], w[ask], grid)
        rows += [(c, name, d, None, k.tobytes(), *none[1:]) for (c, d), k in zip(_pieces(home, d[ask]), _split(home, key[ask]))]
        order = np.argsort(w[rare] % grid.cells, kind="stable")
        rare = rare[order]
        home = w[rare] % grid.cells
        for (c, e), at in zip(_pieces(home, d[rare]), _split(home, order)):
            here = [words[x] for x in at.tolist()]
            number = {x: k for k, x in enumerate(dict.fromkeys(here))}
            rows.append((c, name, e, None, None, b" ".join(number), _pack(np.array([number[x] for x in here], np.int64)), *none[3:]))
        sums = (length, *(np.bincount(owner, x, n) for x in (known, base, p)))
        rows.append((-1 - name, name, *none[:5], part.column("i").to_pylist(), *(x.astype(float).tobytes() for x in sums)))
        return _table(rows, sent)

    ranked_t, ranked_m = model.totals.t, model.totals.m

    def meet(key: tuple, asked: pa.Table, known: pa.Table) -> pa.Table:
        cell, rows = key[0].as_py(), []
        once, q, n, s = (_joined(known.column(c).drop_null().to_pylist(), k) for c, k in (
            ("once", np.uint32), ("q", np.uint32), ("n", np.int64), ("s", np.int64)))
        places = np.append(once, q)
        u, w = grid.pairs(cell, places)
        ones = np.ones(len(once))
        place_terms = _term(np.append(ones, n), np.append(ones, s / SAMPLES), ranked_t[u], parent.probability(ranked_m[w]), discount)
        order = np.argsort(places, kind="stable")
        places, place_terms = places[order], place_terms[order]
        # totals of the cell's words without a rank, and the pairs they are in
        of = {c: known.column(c).combine_chunks() for c in ("id", "t", "m", "key", "term", "word", "c")}
        some = of["id"].is_valid()
        ids, t, m = (of[c].filter(some).to_numpy(zero_copy_only=False) for c in ("id", "t", "m"))
        order = np.argsort(ids)
        ids, t, m = (np.append(x[order], 0) for x in (ids, t, m))
        near = [_near(a, b) for a, b in zip(*(known.column(c).drop_null().to_pylist() for c in "ho")) if a]
        u, w = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*near) if near else ((), ())))
        at = np.searchsorted(ids[:-1], np.maximum(u, w))
        own = u >= _RARE
        tu, mw = t[at], m[at]
        tu[~own], mw[own] = ranked_t[u[~own]], ranked_m[w[own]]
        one = np.ones(len(u))
        pair_terms = np.append(_term(one, one, tu, parent.probability(mw), discount), of["term"].drop_null().to_numpy(zero_copy_only=False))
        pair_keys = np.append(pair_key(u, w), of["key"].drop_null().to_numpy(zero_copy_only=False))
        order = np.argsort(pair_keys)
        pair_keys, pair_terms = pair_keys[order], pair_terms[order]
        words, counts = of["word"].drop_null().to_pylist(), of["c"].drop_null().to_numpy(zero_copy_only=False)
        number = _rare_numbers(words)
        at = np.searchsorted(ids[:-1], number)
        word_terms = np.log10(parent.probability(m[at])) + np.log10(_share(t[at], counts, discount))
        word = dict(zip(words, zip(counts.tolist(), word_terms.tolist())))

        def found(some: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if not len(some):
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            at = np.minimum(np.searchsorted(some, want), len(some) - 1)
            which = np.nonzero(some[at] == want)[0]
            return which, at[which]

        def send(block: int, d: np.ndarray, *values: np.ndarray) -> None:
            here = np.nonzero(np.bincount(d))[0]
            seen, base, p = (np.bincount(d, x)[here].tobytes() if x is not None else None for x in values)
            rows.append((block, cell, _pack(here.astype(np.uint16)), None, None, seen, base, p))

        for a in range(asked.num_rows):
            r = {c: asked.column(c)[a].as_py() for c in asked.column_names}
            block = r["block"]
            if r["ids"] is not None:
                rows.append((block, cell, None, *(r[c] for c in ("ids", "tokens", "seen", "base", "p"))))
            elif r["q"] is not None:
                which, at = found(places, np.frombuffer(r["q"], np.uint32))
                if len(which):
                    send(block, _array(r["d"], np.uint16)[which], None, None, place_terms[at])
            elif r["key"] is not None:
                which, at = found(pair_keys, np.frombuffer(r["key"], np.int64))
                if len(which):
                    send(block, _array(r["d"], np.uint16)[which], None, None, pair_terms[at])
            else:
                c, x = (np.array(v, float)[_array(r["at"], np.int64)] for v in zip(*(word.get(w, (0, unknown)) for w in r["word"].split(b" "))))
                send(block, _array(r["d"], np.uint16), c > 0, np.log10((c + 1) / whole), x)
        pa.default_memory_pool().release_unused()
        return pa.Table.from_batches([_table(rows, back)])

    def close(key: tuple, part: pa.Table) -> pa.Table:
        rows = sorted(part.to_pylist(), key=lambda r: r["cell"])
        ids = next(r["ids"] for r in rows if r["ids"] is not None)
        tokens, *sums = (np.zeros(len(ids)) for _ in range(4))
        for r in rows:
            d = slice(None) if r["d"] is None else _array(r["d"], np.uint16)
            if r["tokens"] is not None:
                tokens = np.frombuffer(r["tokens"], float)
            for x, c in zip(sums, ("seen", "base", "p")):
                if r[c] is not None:
                    x[d] += np.frombuffer(r[c], float)
        seen, base, p = sums
        return pa.table([pa.array(ids, pa.int64()), pa.array(tokens.astype(np.int64)), pa.array(np.rint(seen).astype(np.int64)),
                         pa.array(base), pa.array(p)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    src = docs.select(F.monotonically_increasing_id().alias("r"), F.col(doc_id).cast("long").alias("i"),
                      F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    cell = lambda number: F.pmod(number, F.lit(grid.cells)).cast("long").alias("cell")
    counts = model.words.select(cell(rare_number("word")), "word", "c")
    # no word with a rank is asked for
    known = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (
        model.cells, far.drop("seen"), counts, model.totals.rare.select(cell(F.col("id")), "id", "t", "m")))
    met = src.mapInArrow(split, sent).groupBy("cell").cogroup(known.groupBy("cell")).applyInArrow(meet, back)
    scored = met.groupBy("block").applyInArrow(close, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def perplexity(scored: DataFrame) -> DataFrame:
    """One row: perplexity per token of the model and of the base over some scored texts."""
    of = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.agg(of("score").alias("perplexity"), of("base_score").alias("base_perplexity"))
