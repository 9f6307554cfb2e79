"""Toxicity by weak supervision.

1. Voters. Lexicon voters are terms (whole words and word prefixes) that the training labels
   associate with toxicity, or with its absence; pattern voters look at shouting, exclamation,
   repetition and address; the annotators are one more voter. A voter says
   toxic, clean, or nothing where a text is too short to tell.
2. A generative label model explains all votes by a hidden class. Given the class, a vote
   depends on at most one other voter: the dependences are the tree of the greatest conditional
   mutual information between voters. EM estimates how often the class occurs, how often each
   voter says what in each class and beside each vote of its parent, and so every voter's
   accuracy, that of the annotators included; nothing is trusted in advance.
3. A linear classifier over an exact vocabulary is trained on the model's posterior labels.
4. Scoring is one pass over the whole texts with a model of bounded size.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidestep.llm.common import Scratch, filled, table, without
from tidestep.llm.samples import TRAINING_ROWS, remainder, training_rows

OUT = ("held_out", "score", "predicted")
PREFIXES = (4, 5, 6, 7)
TERMS = 8192
LEXICON = 256
#: Standard deviations by which a lexicon term's toxic rows exceed what its frequency explains.
SURE = 4
#: The same for a term of either class to enter the classifier's vocabulary.
NOTABLE = 2.5
#: Distinct words from which the absence of a term is a vote.
WORDS = 8
#: Twice the log likelihood ratio from which two voters depend on each other given the class (eight degrees of freedom).
DEPENDENT = 26.1
THRESHOLD = 0.5
#: Share of rows from which a posterior that differs from the annotators has found another class, as it can with few rows; EM's start is used then.
LOST = 0.1
#: How often the classifier counts a toxic row, of which there are few.
RARE = 2
ADDRESS = re.compile(r"\b(?:you|your|tu|vous|du|ihr|usted|eres)\b", re.I)


def terms(text: str) -> set[str]:
    """The distinct words, lower-cased and without edge punctuation, and their prefixes (marked by a dash)."""
    words = {w.strip(".,;:!?\"'()[]*#%&$|-") for w in set(text.lower().split())}
    words.discard("")
    out = set(words)
    for n in PREFIXES:
        out.update([w[:n] + "-" for w in words if len(w) >= n])
    return out


def patterns(text: str) -> list[int]:
    """Votes of the pattern voters on one text (1 toxic, -1 clean, 0 nothing), and whether the absence of a term is a vote."""
    n = max(1, len(text))
    loud = sum(map(str.isupper, text)) / n
    bangs = text.count("!") / n
    words = text.split()
    distinct = len(set(words))
    repeats = 1 - distinct / max(1, len(words))
    enough = distinct >= WORDS
    quiet = -1 if enough else 0
    return [
        1 if loud > 0.3 else quiet,
        1 if bangs > 0.01 else quiet if not bangs else 0,
        1 if repeats > 0.8 else quiet if repeats < 0.5 else 0,
        1 if ADDRESS.search(text) else quiet,
        int(enough),
    ]


def vote_matrix(hits: list[set[int]], lexicon: dict[int, int], clean: dict[int, int], fixed: np.ndarray, gold: np.ndarray) -> np.ndarray:
    """Votes of every voter on every row: toxic terms, clean terms, patterns, annotators.

    There is no voter for "any term": it would say again what the terms have said.
    """
    bad, good = np.zeros((len(hits), len(lexicon)), np.int8), np.zeros((len(hits), len(clean)), np.int8)
    for i, h in enumerate(hits):
        for t in h:
            if t in lexicon:
                bad[i, lexicon[t]] = 1
            elif t in clean:
                good[i, clean[t]] = -1
    absent = np.where(fixed[:, -1:] > 0, -1, 0)
    votes = [np.where(bad > 0, 1, absent), good, fixed[:, :-1], np.where(gold > 0, 1, -1)[:, None]]
    return np.concatenate(votes, axis=1).astype(np.int8)


def pick_lexicon(top: pd.DataFrame, sign: int = 1) -> dict[int, int]:
    """Voter number of each chosen term: toxic terms (sign -1: clean ones), best first, one of each family of prefixes with about the same rows."""
    out: dict[int, int] = {}
    family: dict[str, list[int]] = {}
    for i, (term, z, rows) in enumerate(zip(top.term, top.z, top.toxic if sign > 0 else top.clean, strict=True)):
        if sign * z >= SURE and len(out) < LEXICON:
            held = family.setdefault(term[:3], [])
            if not any(abs(rows - x) <= 0.15 * x for x in held):
                held.append(rows)
                out[i] = len(out)
    return out


@dataclass
class Labels:
    """What the label model says: the posterior of class 1 for each row; of each voter its accuracy where it votes and the voter it depends on (-1: none); the rounds of EM."""

    post: np.ndarray
    accuracy: np.ndarray
    parent: np.ndarray
    rounds: int


def dependences(hot: np.ndarray, post: np.ndarray) -> np.ndarray:
    """The parent of each voter in the tree of the greatest conditional mutual information; -1 for a root."""
    n, m = len(post), hot.shape[1] // 3
    info = np.zeros((m, m))
    for q in (1 - post, post):
        total = q.sum() + 1e-9
        both = ((hot * q.astype(np.float32)[:, None]).T @ hot / total).reshape(m, 3, m, 3)
        alone = np.einsum("iaia->ia", both)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = both * np.log(both / (alone[:, :, None, None] * alone[None, None]))
        info += total / n * np.where(both > 1e-12, ratio, 0).sum(axis=(1, 3))
    parent, link, best = np.full(m, -1), np.full(m, -1), np.full(m, -np.inf)
    todo = np.ones(m, bool)
    for _ in range(m):  # Prim's algorithm; a voter that depends on none before it starts a tree
        j = int(np.where(todo, best, -np.inf).argmax()) if np.isfinite(best[todo]).any() else int(np.flatnonzero(todo)[0])
        todo[j] = False
        parent[j] = link[j] if 2 * n * best[j] > DEPENDENT else -1
        nearer = todo & (info[j] > best)
        best[nearer], link[nearer] = info[j][nearer], j
    return parent


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 200, correlated: bool = True, tolerance: float = 1e-5) -> Labels:
    """EM for the votes (-1, 0, 1) of voters on rows; start: the posterior of class 1 that the first round believes.

    Without correlations, voters are independent given the class. Every cell of a table gets a
    half count; a table beside a parent's vote is drawn to the voter's own by two counts.
    """
    n, m = votes.shape
    code = votes.astype(np.int8) + np.int8(1)
    hot = (code[:, :, None] == np.arange(3)).reshape(n, 3 * m).astype(np.float32) if correlated else np.zeros((n, 0))
    post, parent, step = np.asarray(start, float), np.full(m, -1), 0
    for step in range(1, rounds + 1):
        if correlated and step in (1, 2, 4, 8, 16):
            parent = dependences(hot, post)
        prior = (post.sum() + 1) / (n + 2)
        log_odds = np.full(n, np.log(prior / (1 - prior)))
        for j in range(m):
            voice = []
            for q in (1 - post, post):
                own = (np.bincount(code[:, j], q, 3) + 0.5) / (q.sum() + 1.5)
                if parent[j] < 0:
                    voice.append(np.log(own)[code[:, j]])
                else:
                    pair = code[:, parent[j]].astype(np.int64) * 3 + code[:, j]
                    beside = np.bincount(pair, q, 9).reshape(3, 3)
                    beside = (beside + 2 * own) / (beside.sum(axis=1, keepdims=True) + 2)
                    voice.append(np.log(beside).ravel()[pair])
            log_odds += voice[1] - voice[0]
        before, post = post, 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
        if np.abs(post - before).max() < tolerance:
            break
    right = np.where(votes > 0, post[:, None], np.where(votes < 0, 1 - post[:, None], 0)).sum(axis=0)
    return Labels(post, (right + 1) / ((votes != 0).sum(axis=0) + 2), parent, step)


def fit_linear(rows: np.ndarray, cols: np.ndarray, n: int, m: int, y: np.ndarray, steps: int = 300, rate: float = 0.2, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on binary features given as (row, column) pairs, by Adam; what is class 1 counts RARE times."""
    weight = 1 + (RARE - 1) * y
    weight /= weight.mean()
    w, b = np.zeros(m + 1), 0.0
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w[m] = b = np.log(prior / (1 - prior))
    mean, var = np.zeros(m + 1), np.zeros(m + 1)
    for t in range(1, steps + 1):
        z = np.bincount(rows, weights=w[cols], minlength=n) + w[m]
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        grad = np.append(np.bincount(cols, weights=g[rows], minlength=m) / n + decay * w[:m], g.mean())
        mean, var = 0.9 * mean + 0.1 * grad, 0.99 * var + 0.01 * grad**2
        w -= rate * (mean / (1 - 0.9**t)) / (np.sqrt(var / (1 - 0.99**t)) + 1e-8)
    return w[:m], float(w[m])


@dataclass
class ToxicityModel:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -20.0
    voters: list[str] = field(default_factory=list)
    accuracy: list[float] = field(default_factory=list)
    depends: list[int] = field(default_factory=list)
    #: Training rows, and those whose posterior label is not the annotators'.
    rows: int = 0
    flips: int = 0

    def score(self, text: str | None) -> float:
        w = self.weights
        z = self.bias + sum(w[t] for t in sorted(terms(text or "") & w.keys()))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        by = (Counter(), Counter())
        for t, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            by[int(y > 0)].update(terms(t.as_py()))
        keys = list(by[0] | by[1])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([by[0][k] for k in keys], pa.int64()), pa.array([by[1][k] for k in keys], pa.int64())], names=["term", "clean", "toxic"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, usable, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAINING_ROWS) -> ToxicityModel:
    """Fit on at most ``rows`` labelled documents. Without toxic rows, or a term that tells classes apart, nothing is toxic; without clean rows everything."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = scratch.keep(training_rows(docs, labels, "toxic", usable, rows, id_col, text_col), "sample")
    n, pos = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("y") > 0).cast("int")), F.lit(0))).first()
    if not pos or pos == n:
        scratch.drop()
        return ToxicityModel(bias=-20.0 if not pos else 20.0)
    counted = sample.mapInArrow(_counts, "term string, clean bigint, toxic bigint").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # terms that differ most from what their frequency explains; the vocabulary is bounded by TERMS
    expected = (F.col("toxic") + F.col("clean")) * F.lit(pos / n)
    z = (F.col("toxic") - expected) / F.sqrt(expected + 1)
    top = counted.where("toxic + clean >= 3").select("term", "clean", "toxic", z.alias("z")).where(F.abs("z") >= NOTABLE).orderBy(F.desc(F.abs("z")), "term").limit(TERMS).toPandas()
    if top.empty:
        scratch.drop()
        return ToxicityModel(rows=n)
    vocabulary = {t: i for i, t in enumerate(top.term)}

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            found = [sorted(vocabulary[t] for t in terms(x) & vocabulary.keys()) for x in texts]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), pa.array([patterns(x) for x in texts], pa.list_(pa.int32())), b.column(1).cast(pa.int32())], names=["hits", "fixed", "y"])

    got = sample.mapInArrow(hits, "hits array<int>, fixed array<int>, y int").toPandas()
    order = sorted(range(len(got)), key=lambda i: (tuple(got.hits[i]), tuple(got.fixed[i]), got.y[i]))  # the same whatever order the rows came in
    got = got.iloc[order].reset_index(drop=True)
    gold = (got.y > 0).to_numpy().astype(int)
    lexicon, clean = pick_lexicon(top), pick_lexicon(top, -1)
    votes = vote_matrix([set(map(int, h)) for h in got.hits], lexicon, clean, np.array(got.fixed.tolist(), np.int8), gold)
    start = np.where(gold > 0, 0.9, 0.1)
    labels_ = label_model(votes, start)
    if ((labels_.post > 0.5) != (gold > 0)).mean() > LOST:
        labels_.post = start
    rows_ = np.repeat(np.arange(len(got)), [len(h) for h in got.hits])
    cols = np.concatenate([np.asarray(h, np.int64) for h in got.hits]) if len(rows_) else np.zeros(0, np.int64)
    w, b = fit_linear(rows_, cols, len(got), len(vocabulary), labels_.post)
    scratch.drop()
    names = [*top.term[list(lexicon)], *top.term[list(clean)], "loud", "bangs", "repeats", "address", "annotators"]
    weights = {t: float(w[i]) for t, i in vocabulary.items()}
    return ToxicityModel(weights, b, names, labels_.accuracy.tolist(), labels_.parent.tolist(), len(got), int(((labels_.post > 0.5) != (gold > 0)).sum()))


def scorer(spark: SparkSession, model):
    """A vectorised function of a text column that applies a model of bounded size."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([held.value.score(t) for t in texts], dtype=float)

    return score


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """docs with ``score`` (0 to 1) and ``predicted``; null texts are scored as empty ones.

    Every row is scored on its whole text alone, however long, so repeated rows and equal texts
    score alike, and an empty table stays empty. A score of exactly the threshold is toxic.
    Input columns named like an output column are replaced.
    """
    out = without(docs, "score", "predicted").withColumn("score", scorer(docs.sparkSession, model)(filled(text_col)))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def clean_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those predicted toxic; labels of held-out rows are not read."""
    model = fit_toxicity(docs, labels, remainder(id_col, 5) != 0, id_col, text_col)
    return docs.where(scorer(docs.sparkSession, model)(filled(text_col)) < THRESHOLD)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    return score_toxicity(docs, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
