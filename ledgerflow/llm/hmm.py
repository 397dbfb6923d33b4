"""Hidden Markov language model: Baum-Welch counts summed over partitions, exact likelihoods by the scaled forward recursion."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import Scratch, fold_of, slices, texts_of, trim

#: Rows whose crc32(doc_id as text) modulo FOLDS is HELD are not learned from.
FOLDS, HELD = 7, 2
#: Latent states; words with symbols of their own; classes, by their last bytes, that share out the other words.
STATES, OWN, CLASSES = 8, 16_384, 1_024
#: Words whose counts are broadcast, at most: the most frequent ones, so the rest, joined through a shuffle, are few in any text.
FREQUENT = 200_000
#: Baum-Welch steps: how many over which share, in 64ths, of the training documents, by hashed id. The last ones are over all of them.
SCHEDULE = ((1, 5), (4, 6), (16, 3), (64, 3))
#: Tokens of a chunk. Longer texts are cut, and what they were cut from is carried over the cuts exactly.
CHUNK = 512
#: Tokens whose forward probabilities are held for the expected counts, and lanes of chunks that advance together.
HELD_TOKENS, LANES = 1 << 18, 1 << 12
#: Distinct words that a counting task holds before it hands on what it has.
KEPT_WORDS = 250_000


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # on bytes: A-Z only; white space is \x20 and \x09-\x0D


def word_class(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word[-3:]) % CLASSES


def word_counts(texts: DataFrame) -> DataFrame:
    """(word binary, class, c) over (doc_id, text): counted in each partition first, then summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(seen: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array([word_class(w) for w in seen], pa.int32()), pa.array(seen.values(), pa.int64())], names=["word", "class", "c"])

        seen: Counter = Counter()
        for _, texts in slices(batches):
            for text in texts:
                seen.update(words_of(text))
            if len(seen) > KEPT_WORDS:
                yield out(seen)
                seen = Counter()
        if seen:
            yield out(seen)
        del seen
        trim()

    return texts.mapInArrow(count, "word binary, class int, c long").groupBy("word", "class").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    """Symbols are 0: end, 1..OWN: words of their own, then the classes. Rows of emit sum to 1 over symbols."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbol by state


def _fresh(symbols: int, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    move = np.full((STATES, STATES), 0.5 / STATES) + np.eye(STATES) * 0.5
    emit = rng.gamma(1.0, size=(symbols, STATES)) + 0.1
    return Model(np.full(STATES, 1 / STATES), move, emit / emit.sum(0))


def _maximized(start: np.ndarray, move: np.ndarray, emit: np.ndarray, prior: np.ndarray) -> Model:
    """Parameters from expected counts; prior, the symbols' overall shares, smooths each state's emissions."""
    start, move = start + 1e-3, move + 1e-2
    emit = emit + 0.5 * len(prior) * prior[:, None] * 1e-2 + 1e-6
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


@dataclass
class Piece:
    """A chunk of a sequence: which sequence, its symbols, the state shares before it (None: it is the first), the weights of what follows its last state."""

    owner: int
    symbols: np.ndarray
    before: np.ndarray | None
    after: np.ndarray


def _transfers(model: Model, pieces: list[np.ndarray], first: np.ndarray) -> np.ndarray:
    """For each chunk the matrix from state shares before it to those after it, up to a factor; the chunks advance in step."""
    states = len(model.start)
    out = np.empty((len(pieces), states, states))
    for at in range(0, len(pieces), LANES):
        some = sorted(range(at, min(at + LANES, len(pieces))), key=lambda i: -len(pieces[i]))
        steps, running = _lanes([pieces[i] for i in some])
        maps = np.tile(np.eye(states), (len(some), 1, 1))
        begins = first[some]
        for t, (symbols, r) in enumerate(zip(steps, running, strict=True)):
            now = maps[:r]
            moved = (now.reshape(-1, states) @ model.move).reshape(now.shape)
            if t == 0:
                moved[begins] = now[begins]
            moved *= model.emit[symbols[:r]][:, None, :]
            maps[:r] = moved / moved.sum((1, 2), keepdims=True)
        out[some] = maps
    return out


def cut(model: Model, sequences: list[np.ndarray]) -> list[Piece]:
    """Chunks of the sequences. The maps of a long sequence's chunks compose, so each knows the exact shares before and weights after it."""
    states, ones = len(model.start), np.ones(len(model.start))
    out, chunks, first, spans = [], [], [], []
    for i, s in enumerate(sequences):
        if len(s) <= CHUNK:
            out.append(Piece(i, s, None, ones))
        else:
            begin = len(chunks)
            chunks += [s[k : k + CHUNK] for k in range(0, len(s), CHUNK)]
            first += [k == 0 for k in range(0, len(s), CHUNK)]
            spans.append((i, begin, len(chunks)))
    if chunks:
        maps = _transfers(model, chunks, np.array(first))
        for i, begin, end in spans:
            share, weight = model.start, ones
            before, after = [None], [ones]
            for k in range(begin, end - 1):
                share = share @ maps[k]
                share = share / share.sum()
                before.append(share)
            for k in range(end - 1, begin, -1):
                weight = maps[k] @ weight
                weight = weight * (states / weight.sum())
                after.append(weight)
            out += [Piece(i, chunks[k], before[k - begin], after[end - 1 - k]) for k in range(begin, end)]
    return out


def _lanes(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols by step and lane, lanes still running at each step) of sequences, the longest first."""
    sizes = np.array([len(s) for s in sequences])
    steps = np.zeros((sizes[0], len(sequences)), np.int32)
    for lane, s in enumerate(sequences):
        steps[: sizes[lane], lane] = s
    return steps, np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")


def _groups(pieces: list[Piece], tokens: int) -> Iterator[list[Piece]]:
    """Pieces of like length together, about tokens in a group, each group's longest first."""
    pieces = sorted(pieces, key=lambda p: -len(p.symbols))
    at = 0
    while at < len(pieces):
        n = max(1, tokens // len(pieces[at].symbols))
        yield pieces[at : at + n]
        at += n


def _begin(model: Model, group: list[Piece]) -> np.ndarray:
    """State shares at each lane's first token before it is seen."""
    return np.array([model.start if p.before is None else p.before @ model.move for p in group])


def log_likelihoods(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 likelihood of each sequence of symbols by the scaled forward recursion, exact also over the cuts."""
    total = np.zeros(len(sequences))
    for group in _groups(cut(model, sequences), 4 * HELD_TOKENS):
        steps, running = _lanes([p.symbols for p in group])
        alpha, logs = _begin(model, group), np.zeros(len(group))
        for t, (symbols, r) in enumerate(zip(steps, running, strict=True)):
            a = (alpha[:r] if t == 0 else alpha[:r] @ model.move) * model.emit[symbols[:r]]
            scale = a.sum(1)
            alpha = a / scale[:, None]
            logs[:r] += np.log10(scale)
        np.add.at(total, [p.owner for p in group], logs)
    return total


def expected_counts(model: Model, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch: expected starts, moves and emissions over whole sequences, moves over the cuts included."""
    states = len(model.start)
    start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros_like(model.emit)
    for group in _groups(cut(model, sequences), HELD_TOKENS):
        steps, running = _lanes([p.symbols for p in group])
        n, lanes = steps.shape
        alphas, scales = np.zeros((n, lanes, states)), np.ones((n, lanes, 1))
        alpha = _begin(model, group)
        for t, (symbols, r) in enumerate(zip(steps, running, strict=True)):
            a = (alpha[:r] if t == 0 else alpha[:r] @ model.move) * model.emit[symbols[:r]]
            scales[t, :r] = scale = a.sum(1, keepdims=True)
            alphas[t, :r] = alpha = a / scale
        ends = np.array([len(p.symbols) for p in group]) - 1
        after = np.array([p.after for p in group])
        after /= (alphas[ends, np.arange(lanes)] * after).sum(1, keepdims=True)
        gammas, beta, later = [None] * n, np.zeros((0, states)), 0
        for t in range(n - 1, -1, -1):
            r = running[t]
            now = after[:r].copy()
            if later:
                ahead = model.emit[steps[t + 1, :later]] * beta / scales[t + 1, :later]
                move += model.move * (alphas[t, :later].T @ ahead)
                now[:later] = ahead @ model.move.T
            beta, later = now, r
            gammas[t] = alphas[t, :r] * beta
        begins = np.array([p.before is None for p in group])
        start += gammas[0][begins].sum(0)
        if not begins.all():  # the move into a chunk
            before = np.array([p.before for p in group if p.before is not None])
            ahead = (model.emit[steps[0]] * beta / scales[0])[~begins]
            move += model.move * (before.T @ ahead)
        seen = np.concatenate([s[:r] for s, r in zip(steps, running, strict=True)])
        gamma = np.concatenate(gammas)
        for k in range(states):
            emit[:, k] += np.bincount(seen, weights=gamma[:, k], minlength=len(emit))
    return start, move, emit


def sequences_of(column: pa.Array) -> list[np.ndarray]:
    """Sequences of symbols from their bytes."""
    return [np.frombuffer(x.as_buffer(), "<u2") for x in column]


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per input row.

    Tokens are the words of the lower-cased text and one end. base_score sums log10((c+1)/(N+1*(V+1))) over the tokens with the counts c, N, V
    of all training rows. score is the model's log10 probability of the text: states move, each emits an end, a word
    of its own or a class, and a class emits its words by their counts, with one share for all unseen ones. Null and
    empty texts are one end. Without training rows N is 0 and every word unseen. Rows with a null doc_id are training rows (their
    crc is that of the empty text); rows that repeat count and are scored each. Whole texts are learned from and scored.

    Words are looked up once: each text is written as its symbols, two bytes a token, and every Baum-Welch step and the
    scores read those. Steps follow SCHEDULE, shares of the training rows and so alike at every size. What reaches the driver: FREQUENT
    words at most, the most frequent, per-class totals, and tables of (OWN + CLASSES) * STATES. The other words' counts
    are joined to (row, word) pairs by a shuffle, pre-counted per row.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "hmm")
    texts = texts_of(docs, id_col, text_col)
    training = texts.where(fold_of("doc_id", FOLDS) != HELD)
    vocab = scratch.save(word_counts(training))
    n_docs = training.count()
    n_words, kinds = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, distinct = n_words + n_docs, kinds + (n_docs > 0)
    # the most frequent words, whole counts together: by a histogram of the counts' logarithms, a few hundred rows
    level = F.floor(F.log2("c") * 16)
    cut_at, chosen = None, 0
    for row in sorted(vocab.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["level"]):
        chosen += row["n"]
        if chosen > FREQUENT:
            break
        cut_at = row["level"]
    top = vocab.where(F.lit(False) if cut_at is None else level >= cut_at).toArrow()
    names, known, classes = top["word"].to_pylist(), top["c"].to_numpy().astype(np.int64), top["class"].to_numpy().astype(np.int64)
    order = sorted(range(len(names)), key=lambda i: (-known[i], names[i]))
    names, known, classes = [names[i] for i in order], known[order], classes[order]
    own = min(OWN, len(names))
    shares = np.zeros(1 + OWN + CLASSES)
    shares[0] = n_docs
    shares[1 : 1 + own] = known[:own]
    own_classes = np.bincount(classes[:own], minlength=CLASSES)
    own_mass = np.bincount(classes[:own], weights=known[:own], minlength=CLASSES)
    room = np.ones(CLASSES)  # of a class: its other words' counts, one more for each, and one for all unseen words
    for row in vocab.groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        k = row["class"]
        shares[1 + OWN + k] = row["c"] - own_mass[k]
        room[k] += row["c"] - own_mass[k] + row["n"] - own_classes[k]
    shares = (shares + 0.1) / (shares + 0.1).sum()
    symbol = np.where(np.arange(len(names)) < own, np.arange(len(names)) + 1, 1 + OWN + classes)
    words = spark.sparkContext.broadcast((names, symbol, known, np.log10(room)))  # FREQUENT words at most
    del top, order, names

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, symbol, known, per = words.value
        table, lift_of = {w: i for i, w in enumerate(names)}, np.log10(known + 1.0)
        for ids, some in slices(batches):
            rows = []
            for t in some:
                tokens = words_of(t)
                at = np.fromiter(map(table.get, tokens, repeat(-1)), np.int32, len(tokens))
                there = at >= 0
                of_words = symbol[at] if len(symbol) else np.zeros(len(at), np.int64)
                missing = np.flatnonzero(~there).tolist()
                of_words[missing] = [OWN + 1 + word_class(tokens[i]) for i in missing]
                left = Counter(tokens[i] for i in missing)
                # log10(c + 1) of every word, and of those that classes emit, as far as the counts are at hand
                lifts = np.where(there, lift_of[at], 0.0) if len(symbol) else np.zeros(len(at))
                others = of_words > OWN
                rows.append((len(tokens) + 1, int(there.sum()), lifts.sum(), lifts[others].sum() - per[of_words[others] - OWN - 1].sum(), np.append(of_words, 0).astype("<u2").tobytes(), list(left.keys()), list(left.values())))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *columns], names=["doc_id", "n_tokens", "n_known", "lift", "class_lift", "symbols", "rare", "rare_n"])
        del table
        trim()

    coded = texts.mapInArrow(encode, "doc_id long, n_tokens long, n_known long, lift double, class_lift double, symbols binary, rare array<binary>, rare_n array<long>")
    turn = F.pmod(F.xxhash64("doc_id", F.lit("turn")), F.lit(64)).cast("int")
    coded = scratch.save(coded.withColumn("row", F.monotonically_increasing_id()).withColumn("held_out", fold_of("doc_id", FOLDS) == HELD).withColumn("turn", turn))
    columns = ", ".join(f"s{k} double" for k in range(STATES))

    def improved(model: Model, source: DataFrame) -> Model:
        parameters = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = None
            for batch in batches:
                for i in range(0, batch.num_rows, 2_000):
                    found = expected_counts(parameters.value, sequences_of(batch.column(0)[i : i + 2_000]))
                    sums = found if sums is None else tuple(a + b for a, b in zip(sums, found, strict=True))
            if sums is not None:
                at = np.flatnonzero(sums[2].any(1))
                rows = np.concatenate([sums[0][None], sums[1], sums[2][at]])
                keys = np.concatenate([[-1], -2 - np.arange(STATES), at])
                for i in range(0, len(keys), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 4096], pa.int64()), *[pa.array(c) for c in rows[i : i + 4096].T]], names=["key", *[f"s{k}" for k in range(STATES)]])
            trim()

        sums = source.mapInArrow(run, f"key long, {columns}").groupBy("key").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(STATES)]).toPandas()
        parameters.unpersist()
        if not len(sums):
            return model
        table = np.zeros((1 + STATES + len(shares), STATES))
        key = sums["key"].to_numpy()
        table[np.where(key < 0, -key - 1, key + 1 + STATES)] = sums[[f"s{k}" for k in range(STATES)]].to_numpy()
        return _maximized(table[0], table[1 : 1 + STATES], table[1 + STATES :], shares)

    model, learned = _fresh(len(shares)), coded.where("not held_out")
    for share, times in SCHEDULE:
        source = (learned if share == 64 else learned.where(F.col("turn") < share)).select("symbols")
        for _ in range(times):
            model = improved(model, source)
    final = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2_000):
                part = batch.slice(i, 2_000)
                forward = log_likelihoods(final.value, sequences_of(part.column(part.schema.names.index("symbols"))))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in range(part.num_columns - 1)], pa.array(forward)], names=[*part.schema.names[:-1], "forward"])
        trim()

    kept = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, lift double, class_lift double, "
    scored = coded.select("row", "doc_id", "held_out", "n_tokens", "n_known", "lift", "class_lift", "symbols").mapInArrow(score, kept + "forward double")
    pairs = coded.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("p")).select("row", F.col("p.rare").alias("word"), F.col("p.rare_n").alias("n"))
    rest = pairs.join(vocab.select("word", "c"), "word").groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more_lift"))
    end = np.log10(n_docs + 1.0)
    unit = np.log10(total + distinct + 1.0)
    more, more_lift = F.coalesce("more", F.lit(0)), F.coalesce("more_lift", F.lit(0.0))
    return scored.join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + more + F.lit(int(n_docs > 0))).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("lift") + more_lift + F.lit(float(end)) - F.col("n_tokens") * F.lit(float(unit))).alias("base_score"),
        (F.col("forward") + F.col("class_lift") + more_lift).alias("score"),
    )
