"""Language identification by rank-order profiles of character n-grams.

A language's profile holds its most frequent n-grams in order. A document's own most frequent n-grams are compared with
every profile: each adds the distance between its two ranks, or the profile length where the language lacks it. The
smallest sum wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import keyed, per_row

SIZES = (1, 2, 3)
PROFILE = 300
UNKNOWN = "und"
_BLANK = 32
_WIDTH = np.uint64(21)
_CHUNK = 1 << 18


@cache
def _letters() -> np.ndarray:
    """True for the code points that are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> Iterator[np.ndarray]:
    """Packed n-grams of the lower-cased words, each word with a blank before and after, in bounded pieces."""
    letters = _letters()
    seq = np.array([_BLANK], np.uint64)
    for at in range(0, len(text) + 1, _CHUNK):
        codes = np.frombuffer(text[at:at + _CHUNK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        if at + _CHUNK > len(text):
            codes = np.append(codes, np.uint32(_BLANK))
        is_letter = letters[codes]
        # a run of other characters is one blank
        keep = is_letter | np.append(seq[-1] != _BLANK, is_letter[:-1])
        new = np.where(is_letter, codes, _BLANK)[keep].astype(np.uint64)
        old, seq = len(seq), np.concatenate([seq, new])
        for n in SIZES:
            first = max(0, old - n + 1)
            count = len(seq) - n + 1 - first
            if count <= 0:
                continue
            gram, ok = seq[first:first + count].copy(), np.ones(count, bool)
            if n == 1:
                ok = gram != _BLANK
            for k in range(1, n):
                part = seq[first + k:first + k + count]
                gram = gram << _WIDTH | part
                if k < n - 1:
                    ok &= part != _BLANK
            if n == 2:
                ok &= (seq[first:first + count] != _BLANK) | (seq[first + 1:first + 1 + count] != _BLANK)
            yield gram[ok]
        seq = seq[-(max(SIZES) - 1):]


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a whole text and how often each occurs."""
    return _merged([(g, np.ones(len(g), np.int64)) for g in grams(text or "")])


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, counts = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.nonzero(np.append(True, keys[1:] != keys[:-1]))[0] if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def ranked(text: str | None, profile: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams in order, ties by the n-gram itself."""
    parts = [np.sort(g) for g in grams(text or "")]
    every = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
    if not len(every):
        return every
    first = np.nonzero(np.append(True, every[1:] != every[:-1]))[0]
    counts = np.diff(np.append(first, len(every)))
    return every[first][np.argsort(-counts, kind="stable")[:profile]]


def profiles(docs: DataFrame, text: str = "text", lang: str = "lang", profile: int = PROFILE) -> DataFrame:
    """lang, rank (from 0), gram: counts over all rows with a language. Tasks add up before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for t, name in zip(batch.column("text"), batch.column("lang").to_pylist()):
                own = held.setdefault(name, [])
                own.append(gram_counts(t.as_py()))
                if len(own) >= 256:
                    held[name] = [_merged(own)]
        for name, parts in held.items():
            keys, counts = _merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys.view(np.int64)),
                                              pa.array(counts)], names=["lang", "gram", "n"])

    src = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    total = src.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = total.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < profile)
    return top.select("lang", "rank", "gram")


class Ranker:
    def __init__(self, rows: list[tuple[str, int, int]], profile: int) -> None:
        self.profile = profile
        self.names = sorted({r[0] for r in rows})
        self.known = []
        for name in self.names:
            own = sorted((g, rank) for lang, rank, g in rows if lang == name)
            self.known.append((np.array([g for g, _ in own], np.int64).view(np.uint64), np.array([r for _, r in own])))

    def guess(self, text: str | None) -> tuple[str, float]:
        own = ranked(text, self.profile)
        if not len(own) or not self.names:
            return UNKNOWN, 0.0
        place = np.arange(len(own))
        out = []
        for keys, ranks in self.known:
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            out.append(int(np.where(keys[at] == own, np.abs(ranks[at] - place), self.profile).sum()))
        best = int(np.argmin(out))
        return self.names[best], 1 - out[best] / (len(own) * self.profile)


def identify(docs: DataFrame, learned: DataFrame, doc_id: str = "doc_id", text: str = "text",
             profile: int = PROFILE) -> DataFrame:
    """doc_id, lang_pred, score of every row: the nearest language and one minus its distance as a share of the largest.

    Null texts and texts without letters get ``und`` and score 0, as does every text where nothing was learned. Ties go
    to the first language by name. ``learned`` holds ``profile`` rows a language and is collected.
    """
    rows = [(r["lang"], r["rank"], r["gram"]) for r in learned.collect()]
    src = keyed(docs, doc_id, text).toDF("doc_id", "text")

    def make():
        ranker = Ranker(rows, profile)
        return lambda r: (r["doc_id"], *ranker.guess(r["text"]))

    return per_row(src, make, "doc_id long, lang_pred string, score double")
