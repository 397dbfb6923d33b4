"""Items without answers, and windows that the latent space would miss."""

from __future__ import annotations

import random

import numpy as np

from ledgerflow.llm import decontaminate
from ledgerflow.llm.common import Scratch


def speech(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 5))) for _ in range(n)]


def test_copies_without_their_tail(spark):
    """A copy of an item's first 82 % of words is found, as one of the last 82 % is; a given answer is asked for."""
    rng = random.Random(7)
    items = [speech(rng, 50) for _ in range(10)]
    docs = []
    for k, item in enumerate(items):
        docs.append((2 * k, " ".join(speech(rng, 80) + item[:41] + speech(rng, 80))))
        docs.append((2 * k + 1, " ".join(speech(rng, 80) + item[9:] + speech(rng, 80))))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(item), " ".join(item[-5:])) for k, item in enumerate(items)], "item_id long, text string, answer string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table, bench).collect()}
    assert got == {(i, i // 2) for i in range(20)}
    asked = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table, bench, answer_col="answer").collect()}
    assert asked == {(i, i // 2) for i in range(1, 20, 2)}


def test_copies_amid_noise(spark):
    """200 items of one vocabulary, more than the space has dimensions: copies with every sixth word changed, amid one benchmark word said again and again."""
    rng = random.Random(8)
    vocabulary = speech(rng, 900)
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(24, 60))] for _ in range(200)]
    docs = []
    for k, item in enumerate(items):
        copy = [w if j % 6 else "changed" for j, w in enumerate(item, 1)]
        around = [rng.choice(items[k - 1])] * 60
        docs.append((k, " ".join(around + copy + around)))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(k, " ".join(item)) for k, item in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table, bench).collect()}
    missing = {(k, k) for k in range(len(items))} - found
    assert not missing, len(missing)


def test_the_space_is_fitted_on_all_documents(spark):
    """However many documents there are, the passages of each of them are in the products, and so those of each item."""
    rng, saved = random.Random(9), []
    vocabulary = speech(rng, 60)
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 90))) for _ in range(7_000)]
    items = [" ".join(vocabulary[i : i + 20]) for i in range(0, 60, 20)]

    class Spy(Scratch):
        def save(self, df):
            out = super().save(df)
            saved.append(out.groupBy().sum("n").first()[0])
            return out

    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(k, t, None) for k, t in enumerate(items)], "i long, t string, a string")
    index = decontaminate.build_index(table, bench, Spy(spark, "test"))
    assert saved == [len(texts)]
    other, idf, rows = len(index.vocabulary), index.idf[:-1], []
    for weight, text in [(1, t) for t in texts] + [(decontaminate.WEIGHT, t) for t in items]:
        words = [index.vocabulary.get(w.encode(), other) for w in text.split()]
        for i in range(0, len(words), decontaminate.PASSAGE):
            x = np.bincount(words[i : i + decontaminate.PASSAGE], minlength=other + 1)[:-1] * idf
            if x.any():
                rows.append(weight**0.5 * x / np.linalg.norm(x))
    by = np.random.default_rng(1).normal(size=(other, 4))
    got = decontaminate._sketch(decontaminate.coded_passages(table, index.vocabulary), decontaminate.passages_of([t.encode() for t in items], index.vocabulary), idf, by)
    assert np.allclose(got, np.array(rows).T @ (np.array(rows) @ by), rtol=1e-3, atol=1e-2)


def test_items_of_few_words(spark):
    """One to four words are found where they stand next to each other, in texts of several stretches too, and a given answer is asked for."""
    docs = [(1, "A red, GREEN blue bird."), (2, "green and blue"), (3, "blue green"), (4, None), (5, "x " * 40_000 + "green blue"), (6, "one two three four"), (7, "one two four three four")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, "green blue", "bird"), (2, "Bird!", ""), (3, "one two three four", None), (4, "?", None)], "item_id long, text string, answer string")
    rows = decontaminate.contaminated(table, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(1, 1), (1, 2), (5, 1), (6, 3)} and all(r.share == 1 and r.common_words == r.item_words for r in rows)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table, bench, answer_col="answer").collect()} == {(1, 1), (1, 2), (6, 3)}
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(table, bench).collect()) == [2, 3, 4, 7]
    long = "one two three four five six seven eight nine ten"
    both = spark.createDataFrame([(1, long), (2, "green blue")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table.union(spark.createDataFrame([(8, f"green blue {long}")], table.schema)), both).collect()} == {(1, 2), (5, 2), (8, 1), (8, 2)}


def test_stage_drops_documents_with_short_items(spark, tmp_path):
    """The pipeline's stage leaves no item of the benchmark out; each row is judged for itself, null and empty texts stay."""
    import corpus_pipeline

    long = " ".join(speech(random.Random(10), 12))
    spark.createDataFrame([(1, "green blue"), (2, long)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(1, "Green, blue.", 5), (1, "green or blue", 6), (None, long, 7), (2, None, 8), (3, "", 9)], "doc_id long, text string, place int")
    assert sorted(r.place for r in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()) == [6, 8, 9]
