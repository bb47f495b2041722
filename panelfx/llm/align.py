"""Alignment of the tokens of two tokenizers over the same text, merged in lockstep.

Both token sequences of a text are sequences of byte ranges that cover it. A merge walks both, always moving the side that
is behind; where both ends meet there is a link of the two tokens and a cut between groups. The walks of all documents of a
batch are one NumPy state (a pointer into A and one into B each): a step moves them all, emits links, and takes finished
ones out. Long documents enter as several walks of bounded length, so a batch needs a bounded number of steps.

Tokens of white-space separated words do not depend on their neighbours in either tokenizer, so words are encoded once
and looked up afterwards.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.stage import stage
from .bpe import byte_letters
from .common import keyed

#: Documents of one state vector, A tokens of one walk, entries of the word table before it is emptied.
_DOCS = 256
_WALK = 256
_WORDS = 1 << 18
#: An id pair is written as one number: A's id times this, plus B's id.
_B = 1 << 20


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, walk: int = _WALK, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions i, j with ends_a[i] == ends_b[j], in order. Both arrays rise; ``starts``: A positions where walks begin.

    Without ``starts`` a walk begins every ``walk`` A tokens. Its B pointer begins behind the end of the A token before.
    """
    if not len(ends_a) or not len(ends_b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.arange(0, len(ends_a), walk) if starts is None else np.unique(np.concatenate([starts, np.arange(0, len(ends_a), walk)]))
    last = np.append(first[1:], len(ends_a))
    begun = np.searchsorted(ends_b, np.where(first > 0, ends_a[np.maximum(first, 1) - 1], -1), "right")
    stop = np.append(begun[1:], len(ends_b))
    i, j = first.copy(), begun.copy()
    left, right = [], []
    live = (i < last) & (j < stop)
    i, j, last, stop = i[live], j[live], last[live], stop[live]
    while len(i):
        a, b = ends_a[i], ends_b[j]
        met = a == b
        left.append(i[met])
        right.append(j[met])
        i += a <= b
        j += b <= a
        live = (i < last) & (j < stop)
        if not live.all():
            i, j, last, stop = i[live], j[live], last[live], stop[live]
    left, right = np.concatenate(left), np.concatenate(right)
    order = np.argsort(left, kind="stable")
    return left[order], right[order]


class Pair:
    """Both tokenizers, with a table of the words met so far: their A ids and B ids, one after the other."""

    # a single space between two letters that no tokenizer takes for white space
    _CUT = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, a_json: str, b_model: bytes) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_str(a_json)
        self._a.encode_special_tokens = True
        self._a.no_truncation()
        self._a.no_padding()
        self._b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        byte = {c: n for n, c in enumerate(byte_letters())}
        vocab = self._a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (1 + max(self._a.get_vocab().values()))
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(byte[c] for c in token)
        self.b_bytes = []
        for i in range(self._b.get_piece_size()):
            piece = self._b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self._b.is_byte(i) else piece.replace("▁", " ").encode())
        if any(b" " in x.lstrip(b" ") for x in self.b_bytes):
            raise ValueError("a piece of B goes over the space between two words")
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        self._clear()

    def bound(self) -> int:
        """Id pairs that can be linked at all: ranges that end together, so one token's bytes end with the other's."""
        a, b = set(self.a_bytes) - {b""}, set(self.b_bytes) - {b""}
        return sum(x[k:] in b for x in a for k in range(len(x))) + sum(x[k:] in a for x in b for k in range(1, len(x)))

    def _clear(self) -> None:
        self._known: dict[str, int] = {}
        self._odd: set[int] = set()
        self._ids = array("i"), array("i")
        self._from = array("q", [0]), array("q", [0])

    def _learn(self, words: list[str]) -> None:
        """Both encodings of words that are not in the table; noted are words that a side does not spell."""
        spaced = [" " + w for w in words]
        whole = "".join(spaced).encode()
        size = np.fromiter((len(s) for s in spaced), np.int64, len(words)) if len(whole) == sum(map(len, spaced)) else np.array([len(s.encode()) for s in spaced])
        start = np.cumsum(size) - size
        bad = np.zeros(len(words), bool)
        first = [e.ids for e in self._a.encode_batch_fast(spaced, add_special_tokens=False)]
        second = self._b.encode(words, num_threads=1)
        for side, (lists, table, sizes) in enumerate(((first, self.a_bytes, self.a_size), (second, self.b_bytes, self.b_size))):
            n = np.fromiter(map(len, lists), np.int64, len(lists))
            ids = np.fromiter(chain.from_iterable(lists), np.int32, int(n.sum()))
            ends = np.append(0, np.cumsum(n))
            spelled = np.diff(np.append(0, np.cumsum(sizes[ids]))[ends])
            if (spelled != size).any() or b"".join(map(table.__getitem__, ids.tolist())) != whole:
                bad |= [b"".join(map(table.__getitem__, x)) != whole[i:j] for x, i, j in zip(lists, start.tolist(), (start + size).tolist())]
            self._from[side].frombytes((ends[1:] + self._from[side][-1]).tobytes())
            self._ids[side].frombytes(ids.tobytes())
        at = len(self._known)
        self._known.update(zip(words, range(at, at + len(words))))
        self._odd.update((at + np.flatnonzero(bad)).tolist())

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B of all texts, and how many each text has. Texts without tokens by the rule have none.

        These are null and empty texts, and those whose tokens of either side do not spell a space and the text.
        """
        if len(self._known) > _WORDS:
            self._clear()
        parts = [self._CUT.split(t) if t else [] for t in texts]
        known = self._known
        missing = [w for w in set().union(*parts) if w not in known]
        if missing:
            self._learn(missing)
        n_words = np.fromiter(map(len, parts), np.int64, len(parts))
        words = np.fromiter(map(known.__getitem__, chain.from_iterable(parts)), np.int64, int(n_words.sum()))
        if self._odd:
            doc = np.repeat(np.arange(len(parts)), n_words)
            out = np.zeros(len(parts), bool)
            out[doc[np.isin(words, np.fromiter(self._odd, np.int64, len(self._odd)))]] = True
            words, n_words = words[~out[doc]], np.where(out, 0, n_words)
        doc_end = np.append(0, np.cumsum(n_words))
        result = []
        for ids, ends in zip(self._ids, self._from):
            ids, ends = np.frombuffer(ids, np.int32), np.frombuffer(ends, np.int64)
            size = (ends[1:] - ends[:-1])[words]
            total = np.append(0, np.cumsum(size))
            at = np.arange(total[-1]) + np.repeat(ends[words] - total[:-1], size)
            result += [ids[at], np.diff(total[doc_end])]
        return result[0], result[2], result[1], result[3]

    def align(self, texts: list[str | None]) -> "Aligned":
        a, b, n_a, n_b = self.encode(texts)
        ends_a, ends_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        starts = np.cumsum(n_a) - n_a
        i, j = lockstep(ends_a, ends_b, starts=starts[n_a > 0])
        return Aligned(a, b, n_a, n_b, i, j)


class Aligned:
    """Tokens of a batch of texts, one text after the other, and the positions of the linked ones."""

    def __init__(self, a, b, n_a, n_b, link_a, link_b) -> None:
        self.a, self.b, self.n_a, self.n_b, self.link_a, self.link_b = a, b, n_a, n_b, link_a, link_b
        self.end_a, self.end_b = np.append(0, np.cumsum(n_a)), np.append(0, np.cumsum(n_b))
        self.at = np.searchsorted(link_a, self.end_a)

    @property
    def n_links(self) -> np.ndarray:
        return np.diff(self.at)

    def pairs(self) -> np.ndarray:
        return self.a[self.link_a].astype(np.int64) * _B + self.b[self.link_b]

    def written(self) -> list[bytes]:
        """Groups of each text: A ids, a bar, B ids; semicolons between groups."""
        cut_a, cut_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        cut_a[self.link_a], cut_b[self.link_b] = 1, 1
        # groups before a token; its place is its own position plus what the other side has in earlier groups
        before_a, before_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        up_to_a, up_to_b = np.append(self.link_a + 1, len(self.a)), np.append(0, self.link_b + 1)
        signs = np.zeros(len(self.a) + len(self.b), np.int64)
        signs[np.arange(len(self.a)) + up_to_b[before_a]] = self.a.astype(np.int64) * 4 + cut_a
        signs[np.arange(len(self.b)) + up_to_a[before_b]] = self.b.astype(np.int64) * 4 + 2 * cut_b
        if not len(signs):
            return [b""] * len(self.n_a)
        places = _places(int(signs.max()) // 4 + 1)[signs]
        letters = places.view(np.uint8).reshape(len(signs), -1)
        kept = letters != 0
        ends = np.append(0, np.cumsum(kept.sum(1)))[self.end_a + self.end_b]
        flat = letters[kept].tobytes()
        return [flat[x:max(x, y - 1)] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]


_TABLE: list[np.ndarray] = []


def _places(n: int) -> np.ndarray:
    """Decimal of every id below ``n`` with a comma, a bar or a semicolon."""
    if not _TABLE or len(_TABLE[0]) < 4 * n:
        _TABLE[:] = [np.array([f"{i}{sign}".encode() for i in range(n) for sign in (",", "|", ";", "")])]
    return _TABLE[0]


def load(a_path: str, b_path: str) -> tuple[str, bytes]:
    """Both vocabulary files, read on the driver and sent with the tasks: their size is that of the vocabularies."""
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        return a.read(), b.read()


def _over(df: DataFrame, make, schema: str) -> DataFrame:
    """``make`` gives in each task a function from texts to columns; ids go along."""
    names = ["doc_id", *(f.split()[0] for f in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = None
        for batch in batches:
            for at in range(0, batch.num_rows, _DOCS):
                part = batch.slice(at, _DOCS)
                columns = columns or make()
                yield pa.RecordBatch.from_arrays([part.column(0), *columns(part.column(1).to_pylist())], names=names)

    return df.mapInArrow(run, "doc_id long, " + schema)


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def align(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, a, b (token ids), link_a, link_b: positions in a and b of the tokens that end together, which are the cuts.

    Null and empty texts, and those that either tokenizer does not spell byte for byte, have empty arrays. One row a row;
    repeated ids are texts of their own and a null id stays null.
    """
    files = load(a_path, b_path)

    def make():
        both = Pair(*files)

        def columns(texts):
            x = both.align(texts)
            own_a, own_b = np.repeat(x.end_a[:-1], x.n_links), np.repeat(x.end_b[:-1], x.n_links)
            i32 = pa.int32()
            return [_lists(x.a, x.end_a, i32), _lists(x.b, x.end_b, i32), _lists(x.link_a - own_a, x.at, i32), _lists(x.link_b - own_b, x.at, i32)]
        return columns

    return _over(keyed(docs, doc_id, text), make, "a array<int>, b array<int>, link_a array<int>, link_b array<int>")


def _digested(docs: DataFrame, a_path: str, b_path: str, doc_id: str, text: str) -> DataFrame:
    files = load(a_path, b_path)

    def make():
        both = Pair(*files)

        def columns(texts):
            x = both.align(texts)
            codes, n = x.pairs(), len(texts)
            owner = np.repeat(np.arange(n), x.n_links)
            order = np.lexsort((codes, owner))
            codes = codes[order]
            new = np.append(True, (np.diff(codes) != 0) | (np.diff(owner) != 0))[:len(codes)]
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(codes)))
            ends = np.searchsorted(first, x.at)
            sha = [hashlib.sha256(w).hexdigest() if k else "" for w, k in zip(x.written(), x.n_a.tolist())]
            return [pa.array(x.n_a), pa.array(x.n_b), pa.array(x.n_links), pa.array(sha, pa.string()),
                    _lists(codes[first], ends, pa.int64()), _lists(times, ends, pa.int32())]
        return columns

    return _over(keyed(docs, doc_id, text), make, "n_a long, n_b long, n_links long, groups_sha256 string, pair array<long>, times array<int>")


def _summed(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, place = np.unique(codes, return_inverse=True)
    return own, np.bincount(place, weights=times, minlength=len(own)).astype(np.int64)


def pair_counts(linked: DataFrame) -> DataFrame:
    """a, b, n: how often the corpus links two ids, from rows with arrays ``pair`` and ``times``. Added up in the tasks first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            c, t = batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy()
            codes, times = _summed(np.concatenate([codes, c]), np.concatenate([times, t]))
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(times)], names=["code", "n"])

    summed = linked.select("pair", "times").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return summed.select(F.floor(F.col("code") / _B).cast("int").alias("a"), (F.col("code") % _B).cast("int").alias("b"), "n")


def digests(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every text.

    An id pair's count is how many links of the corpus hold it. n_best: links whose count is the highest of their B id,
    ties included; count_sum: the counts of all links added up. Texts without tokens (see ``align``) have zeros and an
    empty string. Every text is encoded once; a text's distinct pairs are written with it. The table of counts has as
    many rows as pairs of which one token's bytes end with the other's, a bound set by the two vocabularies (``Pair.bound``),
    which is checked before it is sent to the tasks.
    """
    held = stage(_digested(docs, a_path, b_path, doc_id, text), "align")
    table = pair_counts(held).toArrow()
    bound = Pair(*load(a_path, b_path)).bound()
    if table.num_rows > bound:
        raise ValueError(f"{table.num_rows} linked id pairs; the vocabularies allow {bound}")
    a, b, n = (table.column(c).to_numpy().astype(np.int64) for c in ("a", "b", "n"))
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    codes = a * _B + b
    highest = np.zeros(int(b.max(initial=0)) + 1, np.int64)
    np.maximum.at(highest, b, n)
    best = n == highest[b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, times = batch.column("pair"), batch.column("times").flatten().to_numpy().astype(np.int64)
            ends = np.append(0, np.cumsum(pair.value_lengths().to_numpy()))
            at = np.searchsorted(codes, pair.flatten().to_numpy())
            sums = [np.append(0, np.cumsum(v))[ends] for v in (times * best[at], times * n[at])] if len(codes) else [np.zeros(len(ends), np.int64)] * 2
            links = batch.column("n_links")
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "n_a", "n_b")), links, links, *(pa.array(np.diff(s)) for s in sums), batch.column("groups_sha256")],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return held.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
