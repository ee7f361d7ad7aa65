import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.llm import quality as q


def made(n, seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "house", "river", "stone", "light", "green", "table"]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        good, toxic = rng.random() < 0.75, rng.random() < 0.25
        if not good:
            text = [w + "***" for w in text]
        for _ in range(2 * toxic):
            text[rng.randrange(len(text))] = rng.choice(["scum", "vermin"])
        rows.append((i, " ".join(text), int(good), int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = made(900, 1)
    docs = spark.createDataFrame([(i, t, 1) for i, t, _, _ in rows] + [(5000, None, 1), (None, "", 1), (5001, "x " * 50_000, 1)], "doc_id long, text string, grade int")
    labels = spark.createDataFrame([(i, g, t) for i, _, g, t in rows[:600]] + [(None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = q.train(docs, labels)
    assert model.thresholds == sorted(model.thresholds)
    got = {r.doc_id: r for r in q.classify(docs, model).collect()}
    held = rows[600:]
    assert sum(got[i].selected == bool(g and not t) for i, _, g, t in held) / len(held) > 0.95
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 for r in got.values())
    kept = q.select_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.selected for r in q.classify(docs, model).collect())


def test_one_grade_or_none(spark, odd, no_docs):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    same = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (empty, same):
        assert all(r.selected for r in q.classify(odd, q.train(odd, labels)).collect())
    assert q.classify(no_docs, q.train(no_docs, empty)).count() == 0


def test_sample_is_bounded(spark, documents, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    assert q.training_rows(documents, labels, max_rows=7).count() == 7


def test_scorer_equals_features(documents, spark, small):
    model = q.train(documents, spark.read.parquet(f"{small}/labels.parquet"))
    score = model.scorer()
    for r in documents.limit(30).collect():
        words, shares = q.features(r.text)
        want = sum(model.weights.get(p, 0) for p in words) + sum(model.weights.get(p, 0) * v for p, v in shares.items())
        assert abs(score(r.text) - want) < 1e-9


def test_classify_equals_brute_force(documents, spark, small):
    """Every document: the logistic of score less threshold, summed and last, from plain features."""
    model = q.train(documents, spark.read.parquet(f"{small}/labels.parquet"))
    got = {r.doc_id: r for r in q.classify(documents, model).collect()}
    for r in documents.collect():
        words, shares = q.features(r.text)
        score = sum(model.weights.get(p, 0) for p in words) + sum(model.weights.get(p, 0) * v for p, v in shares.items())
        tails = [1 / (1 + math.exp(min(t - score, 500))) for t in model.thresholds]
        assert got[r.doc_id].expected_grade == pytest.approx(sum(tails), abs=1e-9)
        assert got[r.doc_id].tail_probability == pytest.approx(tails[-1], abs=1e-9)
    assert len(got) == documents.count()


def test_thresholds_without_features_are_the_closed_form():
    """With no features the likelihood's best thresholds are the logits of the weighted shares at or below a grade."""
    grades = [0] * 30 + [1] * 50 + [2] * 120
    model = q.fit([{"grade": g, "words": [], "places": [], "shares": []} for g in grades])
    mass = {g: n / n**0.5 for g, n in Counter(grades).items()}
    for cut, share in zip(model.thresholds, (mass[0] / sum(mass.values()), (mass[0] + mass[1]) / sum(mass.values()))):
        assert cut == pytest.approx(math.log(share / (1 - share)), abs=0.05)


def test_several_labels_of_one_document_count_once(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.id: r.grade for r in q.graded(labels).collect()} == {1: 1, 2: 2}  # the least of 2, 1 and 1
