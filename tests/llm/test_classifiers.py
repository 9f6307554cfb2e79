import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.util import odd_documents, prose
from tidestep.llm import quality, toxicity
from tidestep.llm.samples import remainder, training_rows


def corpus(spark, n=600, seed=5):
    """A third of the texts holds one of a few insults; another third is shouted junk."""
    rng = random.Random(seed)
    bad = [f"snar{x}" for x in ("g", "gle", "ko", "p", "tor")]
    rows, labels = [], []
    for i in range(n):
        text, toxic, good = prose(rng, rng.randint(20, 120)), int(i % 3 == 0), int(i % 3 != 1)
        if toxic:
            words = text.split()
            for _ in range(3):
                words.insert(rng.randint(0, len(words)), rng.choice(bad))
            text = " ".join(words)
        if not good:
            text = text.upper().replace(" ", "!! ")
        rows.append((i, text))
        labels.append((i, good, toxic))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = corpus(spark)
    model = toxicity.fit_toxicity(docs, labels, remainder("doc_id", 5) != 0)
    got = toxicity.score_toxicity(docs, model).where(remainder("doc_id", 5) == 0).join(labels, "doc_id").collect()
    assert len(got) > 80 and np.mean([r.predicted == r.toxic for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got) and len(model.accuracy) == len(model.voters) == len(model.depends)
    assert model.rows > 400 and model.flips < 0.05 * model.rows
    clean = toxicity.clean_documents(docs, labels)
    assert clean.columns == docs.columns and clean.join(labels, "doc_id").where("toxic = 0").count() >= 0.98 * labels.where("toxic = 0").count()


def votes_of(seed=0, n=3000):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    vote = lambda a, says=1.0: (np.where(rng.random(n) < a, 2 * y - 1, 1 - 2 * y) * (rng.random(n) < says)).astype(np.int8)
    return y, vote


def slow_em(votes, start, rounds):
    """EM for independent voters, a cell at a time."""
    post = list(start)
    n, m = votes.shape
    for _ in range(rounds):
        prior, new = (sum(post) + 1) / (n + 2), []
        rate = {}
        for y in (0, 1):
            weight = [p if y else 1 - p for p in post]
            for j in range(m):
                for v in (-1, 0, 1):
                    rate[y, j, v] = (sum(w for w, x in zip(weight, votes[:, j], strict=True) if x == v) + 0.5) / (sum(weight) + 1.5)
        for row in votes:
            odds = prior / (1 - prior)
            for j, v in enumerate(row):
                odds *= rate[1, j, int(v)] / rate[0, j, int(v)]
            new.append(odds / (1 + odds))
        post = new
    return np.array(post)


def test_label_model_equals_an_independent_em():
    y, vote = votes_of(n=400)
    votes = np.stack([vote(0.8), vote(0.7, 0.5), vote(0.9, 0.3), vote(0.6), vote(0.75)], axis=1)
    start = np.where(votes[:, -1] > 0, 0.9, 0.1)
    got = toxicity.label_model(votes, start, rounds=7, correlated=False, tolerance=0)
    assert got.rounds == 7 and (got.parent == -1).all()
    assert np.allclose(got.post, slow_em(votes, start, 7))


def test_label_model_estimates_accuracies_and_corrects_an_annotator():
    y, vote = votes_of()
    votes = np.stack([vote(0.85), vote(0.8), vote(0.9, 0.6), vote(0.8), vote(0.75)], axis=1)  # the last one starts EM
    got = toxicity.label_model(votes, np.where(votes[:, -1] > 0, 0.9, 0.1))
    gold = votes[:, -1] > 0
    flips = (got.post > 0.5) != gold
    assert flips.mean() > 0.15 and np.mean((got.post > 0.5) == y) > 0.9 > np.mean(gold == y)
    assert np.allclose(got.accuracy, [0.85, 0.8, 0.9, 0.8, 0.75], atol=0.05)


def test_copies_of_a_voter_add_nothing():
    y, vote = votes_of()
    poor = vote(0.6)
    good = [vote(0.85), vote(0.8), vote(0.9)]
    start = np.where(good[-1] > 0, 0.9, 0.1)
    one = toxicity.label_model(np.stack([*good, poor], axis=1), start)
    many = toxicity.label_model(np.stack([*good, *[poor] * 8], axis=1), start)
    naive = toxicity.label_model(np.stack([*good, *[poor] * 8], axis=1), start, correlated=False)
    assert one.parent[3] == -1 and (many.parent[3:] >= 3).sum() == 7
    assert np.abs(one.post - many.post).max() < 0.05
    assert np.mean((many.post > 0.5) == y) > np.mean((naive.post > 0.5) == y) + 0.1


def test_quality_held_out(spark):
    docs, labels = corpus(spark)
    model = quality.fit_quality(docs, labels, remainder("doc_id", 4) != 2)
    got = quality.score_quality(docs, model).where(remainder("doc_id", 4) == 2).join(labels, "doc_id").collect()
    assert len(got) > 100 and np.mean([r.predicted == r.quality for r in got]) > 0.97


def test_pairwise_sum_is_that_of_all_pairs():
    rng = np.random.default_rng(1)
    model = quality.QualityModel(0.3, rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, quality.RANK)) / 9)
    i, x = quality.vector("One two two THREE! four | five\nsix")
    z = 0.3 + model.linear[i] @ x + sum(model.factors[i[a]] @ model.factors[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
    assert model.score("One two two THREE! four | five\nsix") == pytest.approx(1 / (1 + np.exp(-z)))


def test_remainder_is_that_of_crc32(spark):
    df = spark.createDataFrame([(7,), (123456,), (None,)], "doc_id bigint")
    got = {r.doc_id: r.m for r in df.select("doc_id", remainder("doc_id", 5).alias("m")).collect()}
    assert got == {7: zlib.crc32(b"7") % 5, 123456: zlib.crc32(b"123456") % 5, None: 0}


def test_sample_is_bounded_and_skips_held_out_rows(spark):
    docs, labels = corpus(spark, 200)
    repeated = labels.unionByName(labels.limit(5)).unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None)], labels.schema))
    got = training_rows(docs, repeated, "toxic", remainder("doc_id", 5) != 0, 50)
    assert got.count() == 50
    held = {r.text for r in docs.where(remainder("doc_id", 5) == 0).collect()}
    assert not held & {r.text for r in got.collect()}


def test_odd_rows_and_missing_classes(spark):
    df = odd_documents(spark)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    everything = F.lit(True)
    scored = toxicity.score_toxicity(df, toxicity.fit_toxicity(df, none, everything))
    assert scored.count() == df.count() and {r.predicted for r in scored.collect()} == {0} and "Score" not in scored.columns
    good = quality.score_quality(df, quality.fit_quality(df, none, everything))
    assert {r.predicted for r in good.collect()} == {1}
    docs, labels = corpus(spark, 200)
    for fit, score in ((toxicity.fit_toxicity, toxicity.score_toxicity), (quality.fit_quality, quality.score_quality)):
        model = fit(docs, labels, everything)
        out = score(df, model).collect()
        assert len(out) == df.count() and all(0 <= r.score <= 1 for r in out)
        assert score(df.limit(0), model).collect() == []
