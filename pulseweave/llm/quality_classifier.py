"""Quality scores by regularised quadratic discriminant analysis.

Every whole text becomes a vector of transformed statistics (shares as square
roots, counts as logarithms). Each class has a mean and a covariance that is
shrunk, (1 - a) * own + a * pooled and then (1 - b) * that + b * diagonal, so that it
can be inverted; their Cholesky factors are computed once and cached in the
model. A score is the logistic of the difference of Mahalanobis log densities
plus the log prior odds. The class sums (n, sum x, sum x x') are aggregated by Spark over
all labelled rows and have a fixed size.

Defined cases: a null or empty text has all statistics 0 and is scored like any
other; a document with several labels counts once for each distinct one; null
labels are ignored; without two classes every score is the prior (0.5 without
any label); repeated rows get the same score; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .words import SPACES, repeated_window_words

STATS = [
    "words", "mean_word", "long_words", "short_words", "symbols", "punctuation", "digits", "upper", "non_ascii", "lines", "words_per_line", "duplicate_lines", "repeated_words", "distinct_words", "top_word", "compression", "upper_words", "bangs",
]


def stats(text: str | None) -> np.ndarray:
    """The transformed statistics of a text; shares as square roots."""
    out = np.zeros(len(STATS))
    words = text.encode().split() if text else []
    if not words:
        return out
    n, raw = len(words), text.encode()
    data = np.frombuffer(raw, np.uint8)
    hist = np.bincount(data, minlength=256)
    chars = max(1, len(text) - sum(map(text.count, SPACES)))
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    share = lambda x, of: np.sqrt(x / of)
    codes = lambda s: int(hist[np.frombuffer(s, np.uint8)].sum())
    out[:] = [
        np.log1p(n), np.log(chars / n), share((lengths > 12).sum(), n), share((lengths <= 3).sum(), n), share(codes(b"#*$%&|<>"), chars), share(codes(b".,;:!?"), chars), share(int(hist[48:58].sum()), chars), share(int(hist[65:91].sum()), chars), share(int((data >= 192).sum()), chars),
        np.log1p(len(lines)), np.log(n / max(len(lines), 1)), share(len(lines) - len(set(lines)), len(lines)), share(repeated_window_words(words), n), share(len(counts), n), share(max(counts.values()), n), len(zlib.compress(raw, 1)) / len(raw), share(sum(w.isupper() and len(w) > 1 for w in words), n), share(codes(b"!"), chars),
    ]
    return out


def vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and x, the statistics of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [stats(text.as_py()).tolist() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Model:
    """Class means, inverse Cholesky factors and log determinants; empty if there is nothing to tell apart."""

    means: np.ndarray
    factors: np.ndarray
    logdets: np.ndarray
    prior: float
    center: np.ndarray
    scale: np.ndarray
    temper: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.means):
            return np.full(len(x), self.prior)
        z = (x - self.center) / self.scale
        dens = [-0.5 * (((z - m) @ f.T) ** 2).sum(1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.logdets, strict=True)]
        odds = self.temper * (dens[1] - dens[0]) + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def class_sums(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """n, sum x and sum x x' for each label of ``rows`` (x, label); a task sends two rows."""
    d = len(STATS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(0).to_pylist())
                y = batch.column(1).to_numpy(zero_copy_only=False)
                for c in (0, 1):
                    own = x[y == c]
                    sums[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(sums.tolist())], ["label", "sums"])

    parts = rows.select("x", F.col("label").cast("long").alias("label")).mapInArrow(run, "label long, sums array<double>")
    found = parts.groupBy("label").agg(*[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(1 + d + d * d)]).collect()  # two rows
    return {r["label"]: (r[1], np.array(r[2 : 2 + d]), np.array(r[2 + d :]).reshape(d, d)) for r in found}


def train(labelled: DataFrame, to_pooled: float = 0.5, to_diagonal: float = 0.2, temper: float = 0.25) -> Model:
    """Fit on rows of x and label (0 or 1)."""
    sums = class_sums(labelled)
    n = np.array([sums.get(c, (0.0,))[0] for c in (0, 1)])
    d = len(STATS)
    if n.min() < 2:
        return Model(np.zeros((0, d)), np.zeros((0, d, d)), np.zeros(0), float((n[1] + 1) / (n.sum() + 2)), np.zeros(d), np.ones(d), 1.0)
    center = sum(s[1] for s in sums.values()) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(sum(s[2] for s in sums.values())) / n.sum() - center**2, 1e-9))
    means, covs = [], []
    for c in (0, 1):
        _, first, second = sums[c]
        m = first / n[c]
        means.append((m - center) / scale)
        covs.append((second / n[c] - np.outer(m, m)) / np.outer(scale, scale))
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / n.sum()
    factors, logdets = [], []
    for cov in covs:
        shrunk = (1 - to_pooled) * cov + to_pooled * pooled
        shrunk = (1 - to_diagonal) * shrunk + to_diagonal * np.diag(np.diag(shrunk)) + 1e-6 * np.eye(d)
        root = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(root))
        logdets.append(2 * np.log(np.diag(root)).sum())
    return Model(np.array(means), np.array(factors), np.array(logdets), float(n[1] / n.sum()), center, scale, temper)


def score(x: DataFrame, model: Model) -> DataFrame:
    """doc_id and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array(batch.column(1).to_pylist()).reshape(batch.num_rows, len(STATS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(rows))], ["doc_id", "score"])

    return x.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, train_on, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id and score of every document; trained on the labels of the rows for which ``train_on`` (a condition on doc_id) holds."""
    x = materialise(vectors(docs, id_col, text_col), "quality_statistics")
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("long").alias("label")).filter(F.col("label").isin(0, 1) & train_on).distinct()
    return score(x, train(x.join(known, "doc_id")))
