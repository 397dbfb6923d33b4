"""The pipeline's near-duplicate stage against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from ledgerflow.llm import near_copies
from ledgerflow.llm.simhash import agree, agreeing, fingerprint_series, links, shingle_hashes, sketch


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def roots_of(texts):
    sets, up = [shingles(t or "") for t in texts], list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = (next(x for x in iter_up(up, k)) for k in (i, j))
                up[max(a, b)] = min(a, b)
    return [next(iter_up(up, k)) for k in range(len(texts))]


def iter_up(up, k):
    while up[k] != k:
        k = up[k]
    yield k


def planted():
    rng = random.Random(12)
    speak = lambda n: [rng.choice("abcdefgh") + str(rng.randrange(400)) for _ in range(n)]
    every = [None, "", "one two", "ONE  two", "one two three four five six", "one two"]
    for _ in range(40):
        text = speak(rng.randint(100, 300))
        every.append(" ".join(text))
        for share in (0.005, 0.01, 0.02, 0.03):
            every.append(" ".join("new" + str(rng.randrange(999)) if rng.random() < share else w for w in text))
    return every


@pytest.mark.parametrize("limit", [1_000, 20])
def test_links_at_a_similarity_of_0_8(spark, limit):
    """Copies with 1-3 % of their words replaced: most differ in more than the 4 bits of op4."""
    every = planted()
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(every)], "row long, text string, fp int").repartition(5)
    got = {r.row: r.component for r in near_copies.near_copies(docs, group_limit=limit).collect()}
    assert got == dict(enumerate(roots_of(every)))


def test_stage_decides_by_row(spark, data):
    """Ids repeat or are null, columns clash: of each group one row stays, and a text without copies always does."""
    import corpus_pipeline

    every = planted()
    ids = [None if i % 7 == 0 else i % 11 for i in range(len(every))]
    docs = spark.createDataFrame([(d, t, i, "x", i) for i, (d, t) in enumerate(zip(ids, every, strict=True))], "doc_id long, text string, __row long, digest string, place int").repartition(5)
    kept = corpus_pipeline.near_dedup(spark, docs, data)
    want = roots_of(every)
    assert kept.columns == docs.columns
    assert sorted(want[r.place] for r in kept.collect()) == sorted(set(want))
    few = spark.createDataFrame([(3, "a b c d e f"), (5, "g h i j k l"), (5, "a b c d e f"), (5, "a b c d e f")], "doc_id long, text string")
    assert sorted(r.text for r in corpus_pipeline.near_dedup(spark, few, data).collect()) == ["a b c d e f", "g h i j k l"]
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), data).collect() == []


def test_unrelated_texts_are_no_candidates(spark):
    """Texts of six words have two shingles, and fingerprints with few bits set: many are within the budget by chance, but their sketches differ."""
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(6)).encode() for _ in range(1_500)]
    hashes = [shingle_hashes(t, near_copies.SHINGLE) for t in texts]
    fps = np.array([fingerprint_series(h, near_copies._TURNS) for h in hashes]).view(np.int64).tolist()
    sketches = np.array([sketch(h, near_copies._SKETCH) for h in hashes]).view(np.int64).tolist()
    words = spark.createDataFrame([(k, fp, *s) for k, (fp, s) in enumerate(zip(fps, sketches, strict=True))], "node long, fp array<long>, s0 long, s1 long")
    assert links(words.drop("s0", "s1"), near_copies.BUDGET, blocks=near_copies.BLOCKS).count() > 1_000
    assert links(words, near_copies.BUDGET, blocks=near_copies.BLOCKS).count() == 0


def test_sketches_agree_where_sets_are_alike():
    """The share of equal minima is about the Jaccard similarity; labels are those of a comparison of all pairs."""
    rng = np.random.default_rng(3)
    for _ in range(50):
        a = rng.integers(0, 1 << 63, 90, dtype=np.uint64)
        b = np.concatenate((a[:80], rng.integers(0, 1 << 63, 10, dtype=np.uint64)))  # 80 of 100
        assert agree(sketch(a, near_copies._SKETCH), sketch(np.repeat(b, 3), near_copies._SKETCH))
        assert not agree(sketch(a, near_copies._SKETCH), sketch(rng.integers(0, 1 << 63, 90, dtype=np.uint64), near_copies._SKETCH))
    for n in (1, 7, 40, 200):
        own, words = rng.integers(0, 3, n), rng.integers(0, 1 << 63, (9, 2), dtype=np.uint64)[rng.integers(0, 9, n)]
        for i in range(n):
            for _ in range(rng.integers(0, 14)):
                words[i, rng.integers(0, 2)] ^= np.uint64(int(rng.integers(1, 16)) << 4 * int(rng.integers(0, 16)))
        linked = agree(words.T[:, :, None], words.T[:, None]) & (own[:, None] == own[None])
        label = np.arange(n)
        while not (label == (least := np.where(linked, label[None], n).min(1))).all():
            label = least
        got = agreeing(own, words.T)
        assert len(set(zip(got.tolist(), label.tolist(), strict=True))) == len(set(label.tolist())) == len(set(got.tolist()))
