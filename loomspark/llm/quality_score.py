"""Quality score by a regularised quadratic discriminant over document statistics.

Each whole text becomes a vector of transformed statistics. Each class is a normal distribution whose
covariance is shrunk towards the pooled one and towards a scaled identity. The score of a text is the
difference of the two Mahalanobis log-densities, computed from Cholesky factors that are made once and
sent with the function, and mapped to 0..1 by a logistic curve fitted on folds of the training rows.

The discriminant is fitted on at most ``TRAIN_ROWS`` labelled rows (those with the smallest hash of
their doc_id), never on held-out ones, and never sees labels, lang, source or doc_id when it scores.

Edge cases: null and empty texts have the statistics of an empty text and are scored like any other;
without both classes among the labels every score is the share of label 1 (0.5 without labels);
repeated rows are scored alike; null labels are ignored; extra columns pass by.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN_ROWS = 20_000
FOLDS = 5
POOLED_SHARE = 0.1
RIDGE_SHARE = 0.01
CUTOFF = 0.3

PUNCTUATION = re.compile(r"[.,;:!?'\"()\-]")
SYMBOL = re.compile(r"[#*$%&|<>{}\[\]^~@=+_\\/]")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
DIGIT = re.compile(r"[0-9]")
ENDING = re.compile(r"[.?!](?=\s|\Z)")


def statistics(text: str | None) -> list[float]:
    t = text or ""
    words = t.split()
    n, chars = len(words), len(t)
    kinds = len(set(words))
    per = lambda x, of: x / of if of else 0.0
    logit = lambda p: float(np.log((p + 0.002) / (1 - p + 0.002)))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in t.split("\n") if x.strip()]
    length = [len(w) for w in words]
    capital = sum(w[0].isupper() for w in words)
    whole = sum(w.isupper() for w in words)
    marks = sum(not w[-1].isalnum() for w in words)
    return [
        float(np.log1p(n)),
        float(np.log1p(per(sum(length), n))),
        float(np.log1p(np.std(length) if n else 0.0)),
        logit(per(kinds, n)),
        logit(per(pairs, max(n - 1, 0))),
        logit(per(same, max(n - 1, 0))),
        logit(per(len(UPPER.findall(t)), chars)),
        logit(per(len(DIGIT.findall(t)), chars)),
        logit(per(len(SYMBOL.findall(t)), chars)),
        logit(per(len(PUNCTUATION.findall(t)), chars)),
        logit(per(t.count("!"), chars)),
        logit(per(capital, n)),
        logit(per(whole, n)),
        logit(per(marks, n)),
        logit(per(len(set(lines)), len(lines))),
        float(np.log1p(per(n, len(lines)))),
        float(np.log1p(per(n, len(ENDING.findall(t)) + 1))),
        logit(per(chars - sum(length), chars)),
    ]


N_STATISTICS = len(statistics(""))


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log-determinants of both classes, and the logistic map."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    whiten: np.ndarray
    offset: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        density = []
        for mean, w, off in zip(self.means, self.whiten, self.offset, strict=True):
            d = (z - mean) @ w.T
            density.append(off - 0.5 * np.einsum("ij,ij->i", d, d))
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -40, 40)))


def _fit(x: np.ndarray, y: np.ndarray) -> Discriminant:
    centre, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - centre) / scale
    groups = [z[y == k] for k in (0, 1)]
    covs = [np.cov(g.T, bias=True) if len(g) > 1 else np.eye(x.shape[1]) for g in groups]
    pooled = sum(len(g) * c for g, c in zip(groups, covs, strict=True)) / len(z)
    whiten, offset = [], []
    for g, c in zip(groups, covs, strict=True):
        c = (1 - POOLED_SHARE) * c + POOLED_SHARE * pooled
        c = (1 - RIDGE_SHARE) * c + RIDGE_SHARE * max(np.trace(c) / len(c), 1e-6) * np.eye(len(c))
        factor = np.linalg.cholesky(c)
        whiten.append(np.linalg.inv(factor))
        offset.append(np.log(len(g) / len(z)) - np.log(np.diag(factor)).sum())
    return Discriminant(centre, scale, np.array([g.mean(0) for g in groups]), np.array(whiten), np.array(offset))


def train(x: np.ndarray, y: np.ndarray) -> Discriminant:
    """Fit on all rows; the logistic map is fitted on margins of rows left out of their fold's fit."""
    model = _fit(x, y)
    margin = np.empty(len(y))
    fold = np.arange(len(y)) % FOLDS
    for k in range(FOLDS):
        rest = fold != k
        one = _fit(x[rest], y[rest]) if len(set(y[rest])) == 2 else model
        margin[~rest] = one.margin(x[~rest])
    a = np.column_stack([np.clip(margin, -60, 60), np.ones(len(y))])
    w = np.array([0.5, 0.0])
    for _ in range(50):  # Newton steps of a lightly penalised logistic regression
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        hess = a.T @ (a * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, a.T @ (p - y) + 1e-3 * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    model.slope, model.shift = float(w[0]), float(w[1])
    return model


def held_out(doc_id: str | Column) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % 5 == 0, F.lit(False))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = pa.array([statistics(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), rows], names=["quality", "x"])


def fit_labels(docs: DataFrame, labels: DataFrame) -> Discriminant | float:
    """The discriminant of the labelled rows, or the share of label 1 if there is only one class."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = known.select("doc_id", F.col("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    # At most TRAIN_ROWS rows, whatever the input: a repeated doc_id counts once, with its least text and label.
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("text").alias("text")).select("quality", "text")
    got = rows.mapInArrow(_features, "quality int, x array<double>").toArrow()
    y = got.column("quality").to_numpy().astype(np.int64)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    x = np.array(got.column("x").to_pylist(), np.float64).reshape(len(y), N_STATISTICS)
    order = np.lexsort((*x.T, y))
    return train(x[order], y[order])


def _scorer(model: Discriminant | float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if isinstance(model, float):
                scores = np.full(batch.num_rows, model)
            else:
                x = np.array([statistics(t) for t in batch.column(2).to_pylist()], np.float64).reshape(batch.num_rows, N_STATISTICS)
                scores = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores)], names=["doc_id", "held_out", "score"])

    return run


def score_documents(docs: DataFrame, model: Discriminant | float) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    kind = dict(docs.dtypes)["doc_id"]
    scored = docs.select("doc_id", held_out("doc_id").alias("held_out"), "text").mapInArrow(_scorer(model), f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= CUTOFF).cast("int"))
