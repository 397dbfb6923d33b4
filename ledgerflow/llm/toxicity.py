"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import keep_rows, slices, texts_of, trim
from ledgerflow.llm.training import FOLDS, fold_of, labelled_sample

#: Feature space; weights that reach the driver and the executors are at most this many.
BITS = 20
#: Labelled rows to learn from, at most about: one task holds the numbers of their features.
SAMPLE = 20_000
#: Passes over them.
EPOCHS = 8
#: Per-coordinate rates alpha / (beta + sqrt(n)), and the two penalties.
ALPHA, BETA, L1, L2 = 3.0, 1.0, 5.0, 0.1
#: Words whose hash a worker remembers during a task.
KEPT_WORDS = 150_000

# a byte's place in a word: A-Z lower-cased, ASCII but letters and digits as white space
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 40:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = h
        return h


_hashes = _Hashes()


def features(text: bytes) -> np.ndarray:
    """Places of the text's words, word pairs and pairs with one word between, repeats included."""
    words = text.translate(_FOLD).split()
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    turned = (h << np.uint64(23)) | (h >> np.uint64(41))
    pairs = (turned[:-1] ^ h[1:]) * np.uint64(0x9E3779B97F4A7C15)
    skips = (turned[:-2] ^ h[2:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (np.concatenate([h, pairs, skips]) >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """FTRL-proximal: z and n by coordinate; a weight is zero until |z| passes the L1 penalty. The last place is the bias."""

    def __init__(self):
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def ordered(rows: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int, np.ndarray]]:
    """(turn, label, places) in the order in which they are learned, whatever partitions they come from."""
    return sorted(rows, key=lambda row: (row[0], row[1], len(row[2]), row[2].tobytes()))


def fit(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights) that aren't zero, the bias's place 1 << BITS, from (doc_id, text, label).

    Features are extracted where the texts are; only their places go to the one task that learns, 4 bytes for each. The
    rows are learned in the order of their hashed ids, one after the other as the method needs, so the result doesn't
    depend on partitions; their number is bounded by the sample. Only weights that aren't zero reach the driver. No rows give none.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            turns, labels = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i in range(0, b.num_rows, 256):
                places = [np.append(np.unique(features(t.as_py().encode("utf-8", "surrogatepass"))), 1 << BITS).astype(np.int32) for t in b.column(2)[i : i + 256]]
                yield pa.RecordBatch.from_arrays([pa.array(turns[i : i + 256], pa.int64()), pa.array(labels[i : i + 256], pa.int32()), pa.array(places, pa.list_(pa.int32()))], names=["turn", "label", "places"])
        _hashes.clear()
        trim()

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            ends, flat = b.column(2).offsets.to_numpy(), b.column(2).values.to_numpy()
            rows += [(turn, label, flat[i:j].copy()) for turn, label, i, j in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        model = Ftrl()
        rows = ordered(rows)
        for _ in range(EPOCHS):
            for _, label, at in rows:
                model.learn(at, label)
        w = model.weights(slice(None))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], names=["place", "weight"])
        del rows, model
        trim()

    rows = sample.select(F.xxhash64("doc_id").alias("turn"), "label", "text").mapInArrow(extract, "turn long, label int, places array<int>").repartition(1)
    found = rows.mapInArrow(learn, "place long, weight double").toPandas()
    return found["place"].to_numpy(np.int64), found["weight"].to_numpy(np.float64)


def _scorer(weights: tuple[np.ndarray, np.ndarray]):
    """From texts to their scores."""
    dense = np.zeros((1 << BITS) + 1)
    dense[weights[0]] = weights[1]
    used = dense[:-1] != 0

    def score(texts: list[bytes]) -> np.ndarray:
        total = np.empty(len(texts))
        for i, text in enumerate(texts):
            at = features(text)
            total[i] = dense[np.unique(at[used[at]])].sum() + dense[-1]
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score in 0..1, predicted: score >= 0.5), one row per input row.

    Learns from at most about sample labelled rows outside the held-out fold; scores read the whole text and nothing else. A
    feature counts once per text. Null and empty texts get the bias alone; without labels every score is 0.5. Rows that
    repeat or have no doc_id get a row each.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(labelled_sample(docs, labels, label_col, sample, id_col, text_col)))  # at most 2**BITS + 1 pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(model.value)
        for ids, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(score(texts))], names=["doc_id", "score"])
        _hashes.clear()
        trim()

    scored = texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold_of("doc_id", FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that toxicity_scores() predicts as 0: a score under 0.5.

    Without labels there is nothing to reject by, and all rows stay. Null and empty texts are judged by the bias alone; repeated rows,
    and rows without an id, one by one. An empty table stays empty.
    """
    found = fit(labelled_sample(docs, labels, label_col, sample, id_col, text_col))
    if not len(found[0]):
        return docs
    model = docs.sparkSession.sparkContext.broadcast(found)

    def keeps():
        _hashes.clear()
        score = _scorer(model.value)
        return lambda texts: (score(texts) < 0.5).tolist()

    return keep_rows(docs, keeps, text_col)
