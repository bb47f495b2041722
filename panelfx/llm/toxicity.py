"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Presence of n-grams (3 to 5 characters, hashed to buckets) is counted in both classes of the labelled texts; the
log-count ratio of each bucket scales its feature, and a logistic regression is fitted on the scaled features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import keyed, per_row

SIZES = (3, 4, 5)
BUCKET_BITS = 20
_CHUNK = 1 << 16
_MULT = np.uint64(0x9E3779B97F4A7C15)


def buckets(text: str | None, sizes: tuple[int, ...] = SIZES) -> Iterator[np.ndarray]:
    """Buckets of all character n-grams of the lower-cased text, in bounded pieces; a text shorter than an n-gram has none."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    longest = max(sizes)
    for at in range(0, len(codes), _CHUNK):
        piece = codes[at:at + _CHUNK + longest - 1].astype(np.uint64)
        gram = np.zeros(len(piece), np.uint64)
        for n in range(1, longest + 1):
            keep = min(_CHUNK, len(piece) - n + 1)
            if keep <= 0:
                break
            gram = gram[:len(piece) - n + 1] * _MULT + piece[n - 1:] + np.uint64(n)
            if n in sizes:
                g = gram[:keep]
                yield ((g ^ (g >> np.uint64(31))) * _MULT >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def present(text: str | None) -> np.ndarray:
    """Distinct buckets of a text."""
    parts = [np.unique(b) for b in buckets(text)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)


@dataclass(frozen=True)
class Model:
    """``weight[i]`` belongs to ``bucket[i]``: the regression weight times the log-count ratio."""
    bucket: np.ndarray
    weight: np.ndarray
    intercept: float

    def scorer(self):
        place = np.zeros(1 << BUCKET_BITS, np.int16)
        place[self.bucket] = np.arange(1, len(self.bucket) + 1)

        def score(text: str | None) -> float:
            hit = np.zeros(len(self.bucket) + 1, bool)
            for b in buckets(text):
                hit[place[b]] = True
            z = self.intercept + float(self.weight[hit[1:]].sum())
            return float(1 / (1 + np.exp(-np.clip(z, -700, 700))))

        return score


def training_sample(labels: DataFrame, max_train: int) -> tuple[DataFrame, dict[int, int]]:
    """Up to ``max_train`` / 2 labelled ids of each class, by a hash of the id, and the class sizes over all labels."""
    counts = {r["y"]: r["count"] for r in labels.groupBy("y").count().collect()}
    parts = [labels.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train // 2) for c in (0, 1)]
    return parts[0].unionByName(parts[1]), counts


def _class_counts(docs: DataFrame) -> DataFrame:
    """bucket, n0, n1: documents of each class with the bucket. Each task adds up one array before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 1 << BUCKET_BITS), np.int64)
        for batch in batches:
            for text, y in zip(batch.column("text"), batch.column("y").to_pylist()):
                n[y][present(text.as_py())] += 1
        b = np.nonzero(n.any(0))[0]
        yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(n[0][b]), pa.array(n[1][b])], names=["bucket", "n0", "n1"])

    found = docs.select("text", "y").mapInArrow(run, "bucket long, n0 long, n1 long")
    return found.groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Weighted ridge logistic regression by Newton steps, the intercept unpenalised."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-9
    beta = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        grad = x.T @ (w * (p - y)) + ridge * beta
        hess = (x * (w * p * (1 - p) + 1e-12)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        beta -= step / max(1.0, np.abs(x @ step).max() / 4)
        if np.abs(step).max() < 1e-6:
            break
    return beta[:-1], float(beta[-1])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
        max_train: int = 20_000, features: int = 384, penalty: float = 1.0) -> Model:
    """Fit on at most ``max_train`` labelled documents, half of them of each class where there are enough.

    Rows are weighted back to the class sizes. Of the buckets, the ``features`` ones that tell the classes apart best
    (likelihood ratio of presence) enter the regression. A document with several labels counts as toxic if one of them
    says so; labels that are null or not 0 or 1, and labels without a document, are ignored. Without labelled
    documents of both classes the model knows no n-gram and scores the smoothed share of toxic ones (0 without any).
    """
    y = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1))
    y = y.groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    sample, sizes = training_sample(y, max_train)
    # at most max_train pairs of numbers, so the bounded side may be broadcast
    train = keyed(docs, doc_id, text).toDF("doc_id", "text").join(F.broadcast(sample), "doc_id")
    nothing = np.zeros(0, np.int64)
    drawn = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(drawn) < 2:
        n1, n0 = drawn.get(1, 0), drawn.get(0, 0)
        return Model(nothing, np.zeros(0), float(np.log((n1 + .5) / (n0 + .5))) if n0 + n1 else -700.0)
    a, b = (F.col(c) + 1.0 for c in ("n1", "n0"))
    m1, m0 = drawn[1] + 2.0, drawn[0] + 2.0
    p = (a + b) / (m1 + m0)
    part = lambda n, m: n * F.log(n / (m * p)) + (m - n) * F.log((m - n) / (m * (1 - p)))
    ranked = _class_counts(train).select("bucket", F.log(a / m1 / (b / m0)).alias("r"), (part(a, m1) + part(b, m0)).alias("g"))
    best = ranked.orderBy(F.desc("g"), "bucket").limit(features).collect()
    bucket = np.array([x["bucket"] for x in best], np.int64)
    ratio = np.array([x["r"] for x in best])
    place = np.zeros(1 << BUCKET_BITS, np.int16)
    place[bucket] = np.arange(1, len(bucket) + 1)

    def make():
        def row(r: dict) -> tuple:
            got = place[present(r["text"])]
            return r["doc_id"], r["y"], got[got > 0].tolist()
        return row

    rows = per_row(train, make, "doc_id long, y int, found array<int>").collect()  # max_train rows of at most `features` numbers
    rows.sort(key=lambda r: (r["doc_id"], r["y"], r["found"]))
    x = np.zeros((len(rows), len(bucket)))
    for i, r in enumerate(rows):
        x[i, np.array(r["found"], np.int64) - 1] = 1
    y = np.array([r["y"] for r in rows], float)
    share = {c: sizes[c] / drawn[c] for c in (0, 1)}
    scale = len(rows) / sum(sizes.values())
    beta, intercept = _logistic(x * ratio, y, np.where(y == 1, share[1], share[0]) * scale, penalty)
    return Model(bucket, beta * ratio, intercept)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, higher: more likely toxic), predicted (1 from 0.5 on), for every row.

    Null and empty texts have no n-gram and get the score of the intercept. Repeated rows are scored alike.
    """
    src = keyed(docs, doc_id, text).toDF("doc_id", "text")

    def make():
        of = model.scorer()

        def row(r: dict) -> tuple:
            s = of(r["text"])
            return r["doc_id"], s, int(s >= 0.5)
        return row

    return per_row(src, make, "doc_id long, score double, predicted int")


def score_column(text: Column, model: Model) -> Column:
    """The score of a text column, for filtering a table without a join."""
    made: list = []

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(model.scorer())
        return pd.Series([made[0](t) for t in texts], dtype=float)

    return of(text)
