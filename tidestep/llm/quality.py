"""Quality by a factorisation machine.

A text becomes a sparse vector: hashed words (L2-normalised counts), binned structure
statistics and binned metadata. The model adds a bias, linear weights and all pairwise
interactions of low rank; with V the factor matrix, the interactions of a vector x are
half of |V'x|^2 - |(V*V)'(x*x)| summed over factors, linear in the entries of x.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidestep.llm.common import Scratch, filled, table, without
from tidestep.llm.samples import remainder, training_rows
from tidestep.llm.toxicity import scorer

#: Labelled rows that the model is fitted on at most: those of least hash.
TRAINING_ROWS = 4096
WORD_BITS = 14
BINS = 24
RANK = 8
THRESHOLD = 0.7
#: Upper ends of the bins of a share; sizes use powers of two.
EDGES = np.array([0, 0.001, 0.005, 0.01, 0.015, 0.02, 0.03, 0.04, 0.05, 0.06, 0.08, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])


def statistics(text: str, words: list[str], counts: Counter) -> list[int]:
    """The bin of each structure statistic and metadata value."""
    n, m = max(1, len(text)), max(1, len(words))
    upper, alpha, digit, space = sum(map(str.isupper, text)), sum(map(str.isalpha, text)), sum(map(str.isdigit, text)), sum(map(str.isspace, text))
    lines = text.split("\n")
    shares = [
        upper / n,
        (len(text) - alpha - digit - space) / n,
        digit / n,
        space / n,
        1 - len(counts) / m,
        (max(counts.values()) if counts else 0) / m,
        1 - len(set(lines)) / len(lines),
        text.count("|") / m,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / m,
        (text.count(".") + text.count(",")) / m,
        sum(map(str.isupper, map(lambda w: w[:1], counts))) / max(1, len(counts)),
    ]
    sizes = [len(text), len(words), len(text.encode()), len(lines), 4 * n / m]
    return [int(np.searchsorted(EDGES, s)) for s in shares] + [min(BINS - 1, int(math.log2(1 + s))) for s in sizes]


FIELDS = 16
SIZE = (1 << WORD_BITS) + FIELDS * BINS


def vector(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's non-zero features."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    hashed: Counter = Counter()
    for w, c in counts.items():
        hashed[zlib.crc32(w.lower().encode()) & ((1 << WORD_BITS) - 1)] += c
    norm = math.sqrt(sum(c * c for c in hashed.values())) or 1.0
    index = [*hashed, *((1 << WORD_BITS) + f * BINS + b for f, b in enumerate(statistics(text, words, counts)))]
    return np.array(index, np.int64), np.array([*(c / norm for c in hashed.values()), *[0.5] * FIELDS])


@dataclass
class QualityModel:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, text: str | None) -> float:
        if not len(self.linear):
            return self.bias
        i, x = vector(text)
        v = self.factors[i] * x[:, None]
        z = self.bias + self.linear[i] @ x + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit_machine(vectors: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.1, seed: int = 7) -> QualityModel:
    """Adagrad on the logistic loss in small batches, in an order that the seed fixes."""
    rng = np.random.default_rng(seed)
    theta = np.concatenate([np.zeros((SIZE, 1)), rng.normal(0, 0.02, (SIZE, RANK))], axis=1)  # linear weight, factors
    seen, squares = np.zeros(SIZE, bool), np.full(theta.shape, 1e-3)
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = math.log(prior / (1 - prior))
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(y), batch):
            rows = order[k : k + batch]
            size = [len(vectors[r][0]) for r in rows]
            cols, x = np.concatenate([vectors[r][0] for r in rows]), np.concatenate([vectors[r][1] for r in rows])
            at, of = np.cumsum([0, *size[:-1]]), np.repeat(np.arange(len(rows)), size)
            px = theta[cols] * x[:, None]
            total = np.add.reduceat(px, at, axis=0)
            square = np.add.reduceat((px[:, 1:] ** 2).sum(axis=1), at)
            z = bias + total[:, 0] + 0.5 * ((total[:, 1:] ** 2).sum(axis=1) - square)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
            gx = g[of] * x
            each = np.concatenate([gx[:, None], gx[:, None] * (total[of, 1:] - px[:, 1:])], axis=1)
            used, back = np.unique(cols, return_inverse=True)
            grad = np.stack([np.bincount(back, weights=each[:, f], minlength=len(used)) for f in range(RANK + 1)], axis=1)
            squares[used] += grad**2
            theta[used] -= rate * grad / np.sqrt(squares[used])
            seen[used] = True
            bias -= rate * g.sum()
    theta[~seen] = 0  # what was never seen has no say
    return QualityModel(float(bias), theta[:, 0].copy(), theta[:, 1:].copy())


def fit_quality(docs: DataFrame, labels: DataFrame, usable, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAINING_ROWS) -> QualityModel:
    """Fit on at most ``rows`` labelled documents. Without both classes the score is constant: 1, or 0 if all labels are 0."""
    scratch = Scratch(docs.sparkSession, "quality")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [vector(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in got], pa.list_(pa.int32())), pa.array([v for _, v in got], pa.list_(pa.float32())), b.column(1).cast(pa.int32())], names=["i", "v", "y"])

    sample = training_rows(docs, labels, "quality", usable, rows, id_col, text_col)
    got = scratch.keep(sample.mapInArrow(vectors, "i array<int>, v array<float>, y int"), "vectors").toPandas()
    scratch.drop()
    y = (got.y > 0).to_numpy().astype(float) if len(got) else np.zeros(0)
    if not len(y) or y.min() == y.max():
        return QualityModel(float(y.mean()) if len(y) else 1.0, np.zeros(0), np.zeros((0, RANK)))
    order = sorted(range(len(got)), key=lambda k: (y[k], len(got.i[k]), np.asarray(got.i[k]).tobytes()))  # the same whatever order the rows came in
    got, y = got.iloc[order], y[order]
    return fit_machine([(np.asarray(i, np.int64), np.asarray(v, float)) for i, v in zip(got.i, got.v, strict=True)], y)


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """docs with ``score`` (0 to 1, higher: better) and ``predicted``; null texts are scored as empty ones.

    Every row is scored on its whole text alone, so repeated rows score alike and an empty
    table stays empty. Input columns named like an output column are replaced.
    """
    out = without(docs, "score", "predicted").withColumn("score", scorer(docs.sparkSession, model)(filled(text_col)))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)
    return score_quality(docs, model).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
