"""The classifiers' learning against plain Python, and awkward inputs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerflow.llm import quality, toxicity, training


def spoken(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        label = i % 3 == 0
        text = " ".join(rng.choice(words[:40] if label else words[15:]) for _ in range(rng.randint(1, 40)))
        rows.append((i, text if label else text.upper() * 2 + "!!", int(label)))
    return [*rows, (n, "", 0), (n + 1, "One.\nOne.\nTwo", 1)]


def naive_features(text):
    words = "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in text.lower()).split()
    return sorted({int(x) for x in toxicity.features(" ".join(words).encode())})


def test_ftrl_is_the_plain_recurrence(spark):
    """One row after the other with a dict of z and n by place; the weights agree to 1e-9."""
    rows = spoken(120)
    df = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(5)
    turns = {r.doc_id: r.turn for r in df.select("doc_id", F.xxhash64("doc_id").alias("turn")).collect()}
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= toxicity.L1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * toxicity.L1) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    order = sorted(rows, key=lambda r: turns[r[0]])
    for _ in range(toxicity.EPOCHS):
        for _, text, label in order:
            places = [*naive_features(text), 1 << toxicity.BITS]
            w = [weight(i) for i in places]
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w))))) - label
            for i, own in zip(places, w, strict=True):
                before = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / toxicity.ALPHA * own
                n[i] = before + g * g
    want = {i: weight(i) for i in z if weight(i)}
    places, weights = toxicity.fit(df)
    assert len(want) > 3 and dict(zip(places.tolist(), weights.tolist(), strict=True)) == pytest.approx(want, abs=1e-9)


def test_features_are_words_pairs_and_skips():
    one = lambda t: set(toxicity.features(t).tolist())
    a, b, c = (one(x) for x in (b"red", b"green", b"blue"))
    whole = one(b"Red, GREEN blue")
    assert len(toxicity.features(b"red green blue")) == 6 and a | b | c < whole and whole == one(b"red green blue") != one(b"blue green red")
    assert one(b"red green") - a - b and not len(toxicity.features(b"")) and not len(toxicity.features(b"!?"))


def test_bradley_terry_is_the_penalized_maximum(spark):
    """Gradient steps over the same pairs end at the same weights; the cut is the plain quantile."""
    df = spark.createDataFrame(spoken(90), "doc_id long, text string, label int").repartition(4)
    model = quality.fit(df)
    rows = quality._features_of(df).collect()
    x = np.array([r.x for r in rows])
    label = np.array([r.label for r in rows])
    assert np.allclose(model["mean"], x.mean(0)) and np.allclose(model["scale"], np.where(x.std(0) > 0, x.std(0), 1.0))
    turns = {r.doc_id: r.turn for r in df.select("doc_id", F.xxhash64("doc_id").alias("turn")).collect()}
    order = sorted(range(len(rows)), key=lambda i: turns[rows[i].doc_id])
    good, bad = [i for i in order if label[i]], [i for i in order if not label[i]]
    diff = np.array([(x[good[(k * quality.PARTNERS + j) % len(good)]] - x[i]) / model["scale"] for k, i in enumerate(bad) for j in range(quality.PARTNERS)])
    loss = lambda w: np.logaddexp(0, -diff @ w).mean() + quality.RIDGE / 2 * (w @ w)
    slope = lambda w: -(diff * (1 / (1 + np.exp(diff @ w)))[:, None]).mean(0) + quality.RIDGE * w
    assert np.abs(slope(model["w"])).max() < 1e-4  # the loss is strictly convex: there is one such point
    rng = np.random.default_rng(0)
    assert all(loss(model["w"]) <= loss(model["w"] + rng.normal(0, s, len(model["w"]))) + 1e-6 for s in (0.01, 0.1, 1) for _ in range(20))
    scores = ((x - model["mean"]) / model["scale"]) @ model["w"]
    assert model["cut"] == pytest.approx(np.quantile(scores, 1 - label.mean()), abs=1e-9)


@pytest.mark.parametrize(("run", "column"), [(toxicity.toxicity_scores, "toxic"), (quality.quality_scores, "quality")])
def test_awkward_rows(spark, run, column):
    """Very long, null and empty texts, repeated rows, null ids, clashing columns."""
    rows = spoken(80)
    long = "w1 w50 " * 200_000
    docs = [(i, t, "x", 0.5, i, 1) for i, t, _ in rows] + [(900, long, "x", 0.5, 1, 1), (901, None, "x", 0.5, 1, 1), (901, None, "x", 0.5, 1, 1), (None, "w1", "x", 0.5, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, label string, score double, place long, turn int")
    labels = spark.createDataFrame([(i, v, "x") for i, _, v in rows] + [(900, 1, "x"), (None, 1, "x"), (3, None, "x")], f"doc_id long, {column} int, text string")
    got = run(df, labels).collect()
    assert sorted((r.doc_id for r in got), key=repr) == sorted((d[0] for d in docs), key=repr) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 901}) == 1


def test_stage_keeps_what_op6_predicts_as_clean(spark):
    rows = spoken(80)
    df = spark.createDataFrame([(i, t, 1) for i, t, _ in rows] + [(7, None, 1), (None, "", 1), (None, "", 1)], "doc_id long, text string, __score int")
    labels = spark.createDataFrame([(i, v) for i, _, v in rows], "doc_id long, toxic int")
    kept = toxicity.drop_toxic(df, labels)
    want = toxicity.toxicity_scores(df, labels).where("predicted = 0")
    assert kept.columns == df.columns and sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, (r.doc_id for r in want.collect())))
    assert toxicity.drop_toxic(df, labels.limit(0)).count() == df.count() and toxicity.drop_toxic(df.limit(0), labels).count() == 0
    assert training.FOLDS == 5


def test_quality_learns_from_every_labelled_row(spark, monkeypatch):
    """Whatever the groups' bounds, each rejected row meets its PARTNERS preferred ones, and the fit is that of all rows that aren't held out."""
    rows, seen = spoken(200), []
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(i, v) for i, _, v in rows], "doc_id long, quality int")
    whole = quality.fit(docs.join(training.known_labels(labels, "quality"), "doc_id"))
    fit_features = quality.fit_features
    monkeypatch.setattr(quality, "BLOCK", 7)
    monkeypatch.setattr(quality, "PART", 3)
    monkeypatch.setattr(quality, "fit_features", lambda df: seen.append((df.count(), fit_features(df))) or seen[-1][1])
    quality.quality_scores(docs, labels)
    n, model = seen[0]
    assert n == training.known_labels(labels, "quality").count() and np.allclose(model["w"], whole["w"], atol=1e-9) and model["cut"] == pytest.approx(whole["cut"], abs=1e-9)
