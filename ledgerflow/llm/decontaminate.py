"""Benchmark decontamination: cosine search in a latent space, then longest common subsequence and answer checks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import Scratch, keep_rows, slices, texts_of, trim

#: Dimensions of the latent space, and how many more the random sketch has.
RANK, MORE = 64, 8
#: Words of a passage, fewer than 256; weight of an item against a passage of a document, squared: a space for telling the items apart; passages multiplied at one time.
PASSAGE, WEIGHT, BLOCK = 64, 100, 64
#: Cosine in the latent space from which a window is a candidate for an item, and the share of the item's length that the window must cover there.
COSINE, COVERED = 0.15, 0.4
#: Of an item's rarest words, RARE more than may be missing, windows that aren't looked at have fewer than RARE.
RARE = 3
#: Share of an item's words in the longest common subsequence; of its answer's.
SHARE, ANSWER = 0.8, 0.5
#: An item of fewer words is held where all of them stand next to each other; words around it in which its answer is looked for.
LEAST_WORDS, AROUND = 5, 16
#: Items whose lengths differ by less than this factor share windows; their steps as a share of the length; words of the grid that windows start and end on.
CLASS, STEP, GRID = 1.25, 0.25, 4
#: Characters of a part of the benchmark, about: each part has a space and an index of its own, and all documents are searched for it.
PART_CHARS = 4 << 20
#: Words of one text that are searched together; products of windows and items, and marks of items' words, made at one time.
STRETCH, PRODUCTS, MARKS = 1 << 15, 1 << 21, 1 << 24

# a byte's place in a word: A-Z lower-cased, ASCII but letters and digits as white space
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def masks_of(item: list[int]) -> dict[int, int]:
    """By word a bit for each of its places in item."""
    masks: dict[int, int] = {}
    for place, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << place
    return masks


def common_subsequence(item: list, masks: dict, window: list) -> int:
    """Length of the longest common subsequence; masks[w] has a bit for each place of w in item."""
    full = (1 << len(item)) - 1
    row = full
    for w in window:
        if m := masks.get(w):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(item) - row.bit_count()


@dataclass
class Windows:
    """Windows for items of like lengths, on a grid of GRID words: wherever an item is in a text, one window covers it."""

    wide: int
    step: int
    items: np.ndarray  # places of the items
    rare: np.ndarray  # by word: whether it is among the rarest of an item, RARE of which then are in every window with SHARE of that item


@dataclass
class Index:
    """A benchmark part: its vocabulary, weights, latent places of words, items, and the windows to look for them in."""

    vocabulary: dict[bytes, int]
    idf: np.ndarray  # the last, for all other words, is zero, as is their row of the basis
    basis: np.ndarray  # word by dimension, scaled by idf
    ids: np.ndarray
    words: list[np.ndarray]
    answers: list[np.ndarray]  # empty where the benchmark gives none: then the share alone decides
    units: np.ndarray  # items' unit vectors in the latent space
    lengths: np.ndarray  # and their lengths there
    windows: list[Windows]
    short: dict[int, list[tuple[int, int, list[int], list[int]]]]  # items of few words by their rarest one: item_id, its place there, words, answer
    kept: dict = field(default_factory=dict)  # of items looked at lately: words, masks, answer, its masks

    def item(self, k: int) -> tuple:
        if k not in self.kept:
            if len(self.kept) > 2_000:
                self.kept.clear()
            own, answer = self.words[k].tolist(), self.answers[k].tolist()
            self.kept[k] = own, masks_of(own), answer, masks_of(answer)
        return self.kept[k]


def passages_of(texts: list[bytes], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The passages of texts that have words of the vocabulary: their distinct ones, how often each is there, how many there are; and in how many texts each word is."""
    other = len(vocabulary)
    coded = [np.fromiter(map(vocabulary.get, words_of(t), repeat(other)), np.int64) for t in texts]
    long = np.array([len(c) for c in coded], np.int64)
    ends = (-(-long // PASSAGE)).cumsum()  # of each text's passages
    at = np.concatenate([np.zeros(0, np.int64), *coded])
    place = np.arange(len(at)) - np.repeat(long.cumsum() - long, long)
    passage = np.repeat(ends - -(-long // PASSAGE), long) + place // PASSAGE
    keys, tf = np.unique(passage[at < other] * other + at[at < other], return_counts=True)
    passage, word = np.divmod(keys, max(1, other))
    size = np.bincount(passage) if len(passage) else passage
    texts_with = np.bincount(np.unique(np.searchsorted(ends, passage, "right") * other + word) % max(1, other), minlength=other)
    return word, tf, size[size > 0], texts_with


def coded_passages(texts: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """All texts' passages as bytes, a row for each slice: word, tf and size, df (words, and in how many texts of the slice each is), n texts."""
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)  # a part's words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, some in slices(batches):
            word, tf, size, df = passages_of(some, shared.value)
            at = np.flatnonzero(df)
            columns = (word.astype(_code(len(df))), tf.astype(np.uint8), size.astype(np.uint8), np.stack((at, df[at])).astype("<i4"))
            yield pa.RecordBatch.from_arrays([*(pa.array([c.tobytes()], pa.binary()) for c in columns), pa.array([len(some)])], names=["word", "tf", "size", "df", "n"])
        trim()

    return texts.mapInArrow(run, "word binary, tf binary, size binary, df binary, n long")


def _code(words: int) -> str:
    return "<u2" if words <= 1 << 16 else "<u4"


def add_products(total: np.ndarray, word: np.ndarray, tf: np.ndarray, size: np.ndarray, weight: int, idf: np.ndarray, by: np.ndarray) -> None:
    """Adds A'(A by) to total for the weighted, normed TF-IDF vectors A of passages; by in single precision."""
    x = (tf * idf[word]).astype(np.float32)
    ends = np.concatenate(([0], size.cumsum(dtype=np.int64)))
    for i in range(0, len(size), BLOCK):
        n = size[i : i + BLOCK]
        at, own = np.unique(word[ends[i] : ends[i + len(n)]], return_inverse=True)
        rows = np.zeros((len(n), len(at)), np.float32)
        rows[np.repeat(np.arange(len(n)), n), own] = x[ends[i] : ends[i + len(n)]]
        rows /= np.linalg.norm(rows, axis=1)[:, None]
        total[at] += weight * (rows.T @ (rows @ by[at]))


def _sketch(passages: DataFrame, items: tuple, idf: np.ndarray, by: np.ndarray) -> np.ndarray:
    """A'(A by) for the TF-IDF passages A of coded_passages() and of the items: each partition adds its passages, Spark adds the partitions."""
    d, by = by.shape[1], by.astype(np.float32)
    shared = passages.sparkSession.sparkContext.broadcast((idf, by))  # d numbers for each of a part's words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, by = shared.value
        total = np.zeros((len(idf), d))
        for batch in batches:
            for word, tf, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                add_products(total, np.frombuffer(word, _code(len(idf))), np.frombuffer(tf, np.uint8), np.frombuffer(size, np.uint8), 1, idf, by)
        at = np.flatnonzero(total.any(1))
        for i in range(0, len(at), 1 << 14):
            rows = at[i : i + (1 << 14)]
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.FixedSizeListArray.from_arrays(pa.array(total[rows].ravel()), d).cast(pa.list_(pa.float64()))], names=["word", "row"])
        trim()

    parts = passages.select("word", "tf", "size").mapInArrow(run, "word long, row array<double>")
    sums = parts.groupBy("word").agg(F.array(*[F.sum(F.col("row")[i]) for i in range(d)]).alias("row")).toArrow()
    out = np.zeros((len(idf), d))
    if sums.num_rows:
        out[sums["word"].to_numpy()] = sums["row"].combine_chunks().flatten().to_numpy().reshape(-1, d)
    add_products(out, *items[:3], WEIGHT, idf, by)
    shared.unpersist()
    return out


def document_frequencies(passages: DataFrame, words: int) -> tuple[np.ndarray, int]:
    """In how many of all texts each word of the vocabulary is, and how many texts there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(words + 1, np.int64)
        for batch in batches:
            for some, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, count = np.frombuffer(some, "<i4").reshape(2, -1)
                df[at] += count
                df[words] += n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["word", "n"])

    counts = np.zeros(words + 1, np.int64)
    for r in passages.select("df", "n").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        counts[r["word"]] = r["n"]
    return counts[:-1], int(counts[-1])


def _rows(benchmark: DataFrame, item_col: str, text_col: str, answer_col: str | None) -> DataFrame:
    answers = F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t"), answers.alias("a"))
    return rows.where("i is not null and t is not null").distinct()


def parts_of(benchmark: DataFrame, part_chars: int = PART_CHARS) -> list[Column]:
    """Conditions on rows (i, t, a) that cut the benchmark into parts of about part_chars characters; items with one id stay together."""
    chars = benchmark.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    n = max(1, -(-chars // part_chars))
    return [F.pmod(F.xxhash64("i"), F.lit(n)) == k for k in range(n)]


def build_index(texts: DataFrame, part: DataFrame, scratch: Scratch) -> Index:
    """The index of a benchmark part (i, t, a) for the documents (doc_id, text).

    The terms are the part's words: no other word adds to a product with an item. Their idf is counted over all
    documents. The space is fitted by a distributed randomised SVD on the passages of all documents and of the items: a
    range finder with two power steps sums A'(AX) over partitions; X has RANK + MORE columns. Texts are read once: what the steps take of
    them, the passages' words that are the part's, is written to a table. What the driver holds is a part's texts and RANK + MORE numbers for
    each of its words.
    """
    found = [(r["i"], words_of(r["t"].encode()), words_of((r["a"] or "").encode())) for r in part.orderBy("i", "t", "a").collect()]  # PART_CHARS, about
    vocabulary: dict[bytes, int] = {}
    for _, words, answer in found:
        for w in words + answer:
            vocabulary.setdefault(w, len(vocabulary))
    passages = scratch.save(coded_passages(texts, vocabulary))
    counts, n_docs = document_frequencies(passages, len(vocabulary))
    idf = np.log((n_docs + 1) / (counts + 0.5)).clip(0.05)
    basis = np.zeros((len(idf) + 1, RANK), np.float32)
    if len(idf):
        items = passages_of([b" ".join(words) for _, words, _ in found], vocabulary)
        x = np.random.default_rng(11).normal(size=(len(idf), min(RANK + MORE, len(idf))))
        for _ in range(2):
            x, _ = np.linalg.qr(_sketch(passages, items, idf, x))
        values, turn = np.linalg.eigh(x.T @ _sketch(passages, items, idf, x))
        best = np.argsort(-values)[:RANK]
        basis[:-1, : len(best)] = (x @ turn[:, best]) * idf[:, None]
    scratch.drop(passages)
    short: dict[int, list[tuple[int, int, list[int], list[int]]]] = {}
    for i, words, answer in found:
        if 0 < len(words) < LEAST_WORDS:
            own = [vocabulary[w] for w in words]
            place = max(range(len(own)), key=lambda k: idf[own[k]])  # noqa: B023
            short.setdefault(own[place], []).append((i, place, own, [vocabulary[w] for w in answer]))
    found = [(i, w, a) for i, w, a in found if len(w) >= LEAST_WORDS]
    coded = [np.array([vocabulary[w] for w in words], np.int32) for _, words, _ in found]
    made = np.array([basis[at].sum(0) for at in coded], np.float32).reshape(len(coded), RANK)
    lengths = np.maximum(np.linalg.norm(made, axis=1), 1e-9)
    units = made / lengths[:, None]
    groups: dict[int, list[int]] = {}
    for k, at in enumerate(coded):
        groups.setdefault(int(np.ceil(np.log(len(at)) / np.log(CLASS) - 1e-9)), []).append(k)
    windows = []
    for size, items in sorted(groups.items()):
        length = CLASS**size
        step = max(1, int(STEP * length / GRID))
        rare = np.zeros(len(idf) + 1, np.bool_)
        for k in items:
            lost = len(coded[k]) - int(np.ceil(SHARE * len(coded[k]) - 1e-9))
            rare[coded[k][np.lexsort((coded[k], -idf[coded[k]]))[: lost + RARE]]] = True
        windows.append(Windows(-(-int(np.ceil(length)) // GRID) + 2 * step, step, np.array(items), rare))
    answers = [np.array([vocabulary[w] for w in answer], np.int32) for _, _, answer in found]
    return Index(vocabulary, np.append(idf, 0.0), basis, np.array([i for i, _, _ in found], np.int64), coded, answers, units, lengths, windows, short)


def overlaps(index: Index, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
    """How many of the words at[lo:hi] are words of item k, for many windows and items."""
    out, order = np.zeros(len(k), np.int64), np.argsort(k, kind="stable")
    items, starts = np.unique(k[order], return_index=True)
    starts = np.append(starts, len(k))
    many = max(1, MARKS // len(index.idf))
    for i in range(0, len(items), many):
        some = items[i : i + many]
        marks = np.zeros((len(some), len(index.idf)), np.bool_)
        for row, item in enumerate(some.tolist()):
            marks[row, index.words[item]] = True
        for j in range(starts[i], starts[min(i + many, len(items))], 1 << 14):
            which = order[j : min(j + (1 << 14), starts[min(i + many, len(items))])]
            place = lo[which][:, None] + np.arange((hi[which] - lo[which]).max())
            there = marks[np.searchsorted(some, k[which])[:, None], at[np.minimum(place, len(at) - 1)]]
            out[which] = (there & (place < hi[which][:, None])).sum(1)
    return out


def candidates(index: Index, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, float]]:
    """(text, first word, word after the last, item, cosine) of the windows over texts of coded words that the latent space finds for an item.

    All texts of a slice are searched in one go: running sums of their words' latent places on a grid give every window's vector, and
    one product with a class's items its cosines. Windows with under RARE of the items' rarest words are left out before, found ones
    without SHARE of the item's words after: neither can have the common subsequence.
    """
    other = len(index.vocabulary)
    sizes = np.array([-(-len(t) // GRID) for t in texts])
    ends = sizes.cumsum()
    starts = ends - sizes
    at = np.full(int(ends[-1]) * GRID, other, np.int32) if len(texts) else np.zeros(0, np.int32)
    for t, a in zip(texts, starts.tolist(), strict=True):
        at[a * GRID : a * GRID + len(t)] = t
    if not (at < other).any():
        return
    places = np.zeros((len(at) // GRID + 1, RANK), np.float32)
    for i in range(0, len(at), 1 << 15):
        part = index.basis[at[i : i + (1 << 15)]].reshape(-1, GRID, RANK)
        np.add(part[:, 0], part[:, 1], out=part[:, 0])
        np.add(part[:, 2], part[:, 3], out=part[:, 2])
        np.add(part[:, 0], part[:, 2], out=places[i // GRID + 1 : i // GRID + 1 + len(part)])
    np.cumsum(places, axis=0, out=places)
    owner = np.repeat(np.arange(len(texts)), sizes)
    within = np.arange(len(owner)) - starts[owner]
    for group in index.windows:
        a = np.flatnonzero(within % group.step == 0)
        e = np.minimum(a + group.wide, ends[owner[a]])
        rare = np.concatenate(([0], group.rare[at].reshape(-1, GRID).sum(1).cumsum()))
        fits = rare[e] - rare[a] >= RARE
        a, e = a[fits], e[fits]
        units, covered = index.units[group.items].T, (COVERED * index.lengths[group.items]).astype(np.float32)
        many = max(1, min(1 << 13, PRODUCTS // units.shape[1]))
        found = []
        for i in range(0, len(a), many):
            window = places[e[i : i + many]] - places[a[i : i + many]]
            product = window @ units
            least = np.maximum(np.float32(COSINE) * np.sqrt(np.einsum("ij,ij->i", window, window))[:, None], covered)
            w, k = np.nonzero(product >= least)
            if len(w):
                found.append((a[i + w], e[i + w], group.items[k], product[w, k] / np.maximum(np.linalg.norm(window[w], axis=1), 1e-9)))
        if found:
            lo, hi, k, cosine = (np.concatenate(c) for c in zip(*found, strict=True))
            fits = overlaps(index, at, lo * GRID, hi * GRID, k) >= SHARE * np.array([len(index.words[i]) for i in range(len(index.ids))])[k] - 1e-9
            for x, y, i, c in zip(lo[fits].tolist(), hi[fits].tolist(), k[fits].tolist(), cosine[fits].tolist(), strict=True):
                t = int(owner[x])
                yield t, int(x - starts[t]) * GRID, int(y - starts[t]) * GRID, i, c


def search(index: Index, texts: list[bytes]) -> list[dict[int, tuple[float, int, int]]]:
    """For each text the items that it holds: by item_id (cosine, length of the common subsequence, the item's words).

    A candidate is judged by its longest common subsequence with the item, and its answer's where there is one. Of several windows,
    and of several items with one id, the one with the largest share counts. Items under LEAST_WORDS words are looked for as they are, by their rarest
    word. A text longer than STRETCH words is searched in
    stretches that overlap by the widest window.
    """
    found: list[dict[int, tuple[float, int, int]]] = [{} for _ in texts]
    if not len(index.ids) and not index.short:
        return found
    other = len(index.vocabulary)
    over = max([GRID * w.wide for w in index.windows] + [2 * AROUND + LEAST_WORDS])
    coded, owner = [], []
    for t, text in enumerate(texts):
        words = words_of(text)
        at = np.fromiter(map(index.vocabulary.get, words, repeat(other)), np.int32, len(words))
        for i in range(0, max(1, len(at) - over), STRETCH):
            coded.append(at[i : i + STRETCH + over])
            owner.append(t)
    if index.short:
        rarest = np.zeros(other + 1, np.bool_)
        rarest[list(index.short)] = True
        for t, at in zip(owner, coded, strict=True):
            for p in np.flatnonzero(rarest[at]).tolist():
                for item, place, own, answer in index.short[int(at[p])]:
                    a = p - place
                    if item not in found[t] and a >= 0 and at[a : a + len(own)].tolist() == own:
                        part = at[max(0, a - AROUND) : a + len(own) + AROUND].tolist()
                        if not answer or common_subsequence(answer, masks_of(answer), part) >= ANSWER * len(answer):
                            found[t][item] = 1.0, len(own), len(own)
    if not len(index.ids):
        return found
    for t, a, e, k, cosine in candidates(index, coded):
        own, masks, answer, answer_masks = index.item(k)
        item, best = int(index.ids[k]), found[owner[t]]
        earlier = best[item][1] / best[item][2] if item in best else 0.0
        if earlier == 1.0:
            continue
        part = coded[t][a:e].tolist()
        common = common_subsequence(own, masks, part)
        if common >= SHARE * len(own) and common / len(own) > earlier and (not answer or common_subsequence(answer, answer_masks, part) >= ANSWER * len(answer)):
            best[item] = cosine, common, len(own)
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None, part_chars: int = PART_CHARS) -> DataFrame:
    """(doc_id, item_id, cosine, common_words, item_words, share) for each document and benchmark item that it holds.

    A document holds an item if one of its windows has a cosine of COSINE or more with it in the latent space, and their longest common
    subsequence SHARE of the item's words, and ANSWER of its answer's, where the benchmark gives one. Words are compared in lower
    case without punctuation. An item under LEAST_WORDS words is held where all of them stand next to each other, one without words by none; items that repeat are one, and of several texts with one
    item_id the one with the largest share counts; null and empty texts hold nothing; no benchmark gives no rows. Rows that repeat
    or have a null doc_id are searched like others. Documents aren't shuffled. A benchmark above part_chars characters is cut into
    parts, and the documents are searched once for each.
    """
    texts, items = texts_of(docs, id_col, text_col), _rows(benchmark, item_col, item_text_col, answer_col)
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "decontaminate")
    schema = "doc_id long, item_id long, cosine double, common_words long, item_words long, share double"

    def of_part(part: Column) -> DataFrame:
        shared = spark.sparkContext.broadcast(build_index(texts, items.where(part), scratch))  # bounded by part_chars

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, some in slices(batches):
                rows = [(doc, item, cosine, common, n, common / n) for doc, held in zip(ids, search(shared.value, some), strict=True) for item, (cosine, common, n) in sorted(held.items())]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "cosine", "common_words", "item_words", "share"])
            trim()

        return texts.mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, [of_part(p) for p in parts_of(items, part_chars)])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None, part_chars: int = PART_CHARS) -> DataFrame:
    """The rows of docs, with all their columns, whose text holds no benchmark item, as contaminated() finds them."""
    texts, items = texts_of(docs, id_col, text_col), _rows(benchmark, item_col, item_text_col, answer_col)
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "decontaminate")
    for part in parts_of(items, part_chars):
        shared = spark.sparkContext.broadcast(build_index(texts, items.where(part), scratch))
        docs = keep_rows(docs, lambda shared=shared: lambda some: [not held for held in search(shared.value, some)], text_col)
    return docs
