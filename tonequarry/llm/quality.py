"""A quality classifier learned from preference pairs (Bradley-Terry).

Of two documents the one labelled better is preferred with the chance ``sigmoid(score difference)``. Scores are linear
in features of the text alone, so the logistic loss on feature differences is convex and Newton steps find its minimum.
The threshold is a quantile of the learned scores. The model is fitted on at most ``FIT_ROWS`` labelled rows, drawn by
a hash of the id; every document is scored in one narrow pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonequarry.llm.common import narrow_batches, tidy

#: Labelled rows that the model is fitted on, at most, and the preference pairs drawn from them.
FIT_ROWS, FIT_PAIRS = 20_000, 100_000
FOLDS, SEED, RIDGE = 5, 11, 1e-3
THRESHOLD = 0.3

LOWER, UPPER, DIGIT, SPACE = (np.isin(np.arange(256), list(s)) for s in (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c"))
MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
#: Bytes that one pass of counting holds.
STEP = 1 << 22


def features(data: bytes) -> np.ndarray:
    """Shares of byte classes and marks, word and line statistics of a text; defined for empty texts too."""
    counts = np.zeros(256)
    for at in range(0, len(data), STEP):
        counts += np.bincount(np.frombuffer(data, "u1", min(STEP, len(data) - at), at), minlength=256)
    n = max(1, len(data))
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    distinct = set(words)
    lower = counts[LOWER].sum() + counts[128:].sum()
    letters = max(1.0, lower + counts[UPPER].sum())
    n_words, n_lines = max(1, len(words)), max(1, len(lines))
    sentences = counts[ord(".")] + counts[ord("!")] + counts[ord("?")]
    shares = np.sqrt(counts[MARKS] / n)
    own = [
        counts[UPPER].sum() / letters,
        counts[DIGIT].sum() / n,
        counts[SPACE].sum() / n,
        counts[128:].sum() / n,
        counts[:32].sum() / n,
        np.log1p(len(data)),
        np.log1p(len(words)),
        sum(map(len, words)) / n_words / 10,
        len(distinct) / n_words,
        len(set(lines)) / n_lines,
        np.log1p(n_words / n_lines),
        np.log1p(n_words / (1 + sentences)),
        np.log1p(max(map(len, words), default=0)),
    ]
    return np.concatenate([own, shares])


N_FEATURES = len(features(b""))


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale).clip(-8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1; the threshold stands for the cut among the raw scores."""
        at = np.clip(self.raw(x) - self.cut + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)
        return 1 / (1 + np.exp(-at))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Learns from rows of features and labels 0 or 1; without both labels all scores are equal and above the threshold."""
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    better, worse = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    weights = np.zeros(x.shape[1] if len(x) else N_FEATURES)
    if not len(better) or not len(worse):
        return Model(mean, scale, weights, 0.0)
    z = ((x - mean) / scale).clip(-8, 8)
    rng = np.random.default_rng(SEED)
    difference = z[rng.choice(better, FIT_PAIRS)] - z[rng.choice(worse, FIT_PAIRS)]
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(difference @ weights, -30, 30)))
        gradient = difference.T @ (p - 1) / FIT_PAIRS + RIDGE * weights
        hessian = (difference * (p * (1 - p))[:, None]).T @ difference / FIT_PAIRS + RIDGE * np.eye(len(weights))
        step = np.linalg.solve(hessian, gradient)
        weights = weights - step
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ weights
    # The quantile of the scores that tells the fitted labels best.
    quantiles = np.quantile(raw, np.linspace(0, 1, 401))
    right = [((raw >= q) == (y == 1)).mean() for q in quantiles]
    best = np.flatnonzero(np.array(right) == max(right))
    return Model(mean, scale, weights, float(quantiles[best[len(best) // 2]]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> Model:
    """Fits on the labelled rows that aren't held out: those of the smallest id hashes, at most ``FIT_ROWS``."""
    known = labels.where(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull() & ~held_out(F.col(id_column)))
    known = known.groupBy(F.col(id_column).cast("long").alias("doc_id")).agg(F.min(label_column).alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("binary").alias("text"))
    # An id that repeats counts once, so ``FIT_ROWS`` bounds the rows that come back.
    chosen = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min(F.struct("y", "text")).alias("x")).select("doc_id", "x.y", "x.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py() or b"") for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    rows = narrow_batches(chosen).mapInArrow(tidy(run), "doc_id long, y int, x array<double>").toArrow().to_pydict()
    order = np.argsort(rows["doc_id"], kind="stable")
    x = np.array(rows["x"], "f8").reshape(len(order), -1)[order] if len(order) else np.zeros((0, N_FEATURES))
    return fit(x, np.array(rows["y"], "i4")[order] if len(order) else np.zeros(0, "i4"))


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, score)`` of every row; a null text is empty, and an empty one has a score too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack([features(t.as_py() or b"") for t in batch.column(1)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    narrow = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("binary").alias("text"))
    return narrow_batches(narrow).mapInArrow(tidy(run), "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``; rows repeat as they stand.

    A null id isn't held out; labels other than 0 and 1 don't count, and of contradicting labels the lower one does.
    """
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject, with their columns, in one narrow pass after the fit.

    Only texts go to Python, and a score for each comes back. Null and empty texts have a score like any other; rows
    repeat as they stand; an empty table stays empty.
    """
    model = train(docs, labels)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(features(t or b"")) for t in texts], dtype="f8")

    return narrow_batches(docs).where(scored(F.col("text").cast("binary")) >= THRESHOLD)
