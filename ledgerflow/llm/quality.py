"""Quality scores: Bradley-Terry ranking from preference pairs, with a threshold at a quantile of the scores."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.llm.common import Scratch, fold_of, texts_of, trim
from ledgerflow.llm.training import FOLDS, known_labels

#: Preferred partners for each rejected row; Newton steps; ridge penalty.
PARTNERS, STEPS, RIDGE = 8, 12, 1e-3
#: Preferred and rejected rows of a group of pairs, about.
BLOCK, PART = 4_096, 16_384
#: The score that the threshold is mapped to.
CUT = 0.3

NAMES = (
    "length", "distinct", "repeated", "upper", "exclaimed", "barred", "symbols", "digits", "word_length", "lines", "points", "other_marks",
    "top_word", "again_after_two", "pairs", "short_words", "long_words", "capitalized", "numbers", "sentence", "ended_lines", "same_lines", "bullets", "letters", "byte_entropy", "quoted",
)


def features(text: bytes) -> list[float]:
    """Shares and means of a text that don't depend on its language; all zero for an empty one."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    by = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    capitals, small, high = by[65:91].sum(), by[97:123].sum(), by[128:].sum() / 2
    symbols = by[[35, 36, 37, 38, 42]].sum()
    points, marks = by[[44, 46]].sum(), by[33:48].sum() + by[58:65].sum() + by[91:97].sum() + by[123:127].sum()
    repeated = sum(map(bytes.__eq__, words, words[1:]))
    seen = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in map(bytes.strip, text.split(b"\n")) if x]
    sizes = np.fromiter(map(len, words), np.int64, n)
    shares = by[by > 0] / len(text)
    ends = by[33] + by[46] + by[63]
    return [
        np.log1p(n),
        len(seen) / np.sqrt(n) / np.sqrt(min(n, 400)),
        repeated / n,
        capitals / max(1, capitals + small + high),
        min(1, by[33] / n),
        min(1, by[124] / n),
        min(3, symbols / n),
        by[48:58].sum() / len(text),
        min(40, len(text) / n),
        min(1, by[10] / n),
        min(1, points / n),
        min(3, (marks - symbols - points - by[33] - by[124]) / n),
        max(seen.values()) / n,
        sum(map(bytes.__eq__, words, words[2:])) / n,
        pairs / max(1, n - 1),
        (sizes <= 3).mean(),
        (sizes > 12).mean(),
        sum(map(bytes.istitle, words)) / n,
        sum(map(bytes.isdigit, words)) / n,
        min(60, n / max(1, ends)) / 60,
        sum(x[-1] in b".!?:;\"'" for x in lines) / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
        sum(x[0] in b"-*#>|" for x in lines) / max(1, len(lines)),
        (capitals + small + high) / len(text),
        -(shares * np.log2(shares)).sum() / 8,
        min(1, (by[34] + by[39]) / n),
    ]


def _features_of(texts: DataFrame) -> DataFrame:
    """(doc_id, label, x: array of features)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py().encode("utf-8", "surrogatepass")) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "label", "x"])
        trim()

    return texts.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, x array<double>")


def ranked(rows: DataFrame) -> DataFrame:
    """rows (label, x, doc_id) with rank: from 0 within a label, by hashed id. Ranks go by buckets of the hash, so no task sees a label's rows all."""
    by = F.xxhash64("doc_id")
    rows = rows.withColumn("bucket", F.shiftright(by, 48))
    before = F.sum("n").over(Window.partitionBy("label").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = rows.groupBy("label", "bucket").agg(F.count("*").alias("n")).select("label", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("label", "bucket").orderBy(by, "doc_id", "x")) - 1
    return rows.withColumn("own", own).join(F.broadcast(counts), ["label", "bucket"]).select("label", "x", (F.col("own") + F.col("before")).alias("rank"))


def pairs_of(rows: DataFrame, good: int, bad: int) -> DataFrame:
    """(base, x, rank, y): groups of preferred rows, ranked from base on, and of rejected ones with their ranks. Every rejected row meets PARTNERS preferred
    ones, dealt by rank: its j-th is that of rank (PARTNERS * rank + j) mod good. A group has BLOCK preferred rows and about PART rejected ones at most."""
    span = PART * max(1, -(-good // BLOCK))
    turns = F.transform(F.sequence(F.lit(0), F.lit(PARTNERS - 1)), lambda j: F.floor((F.col("rank") * PARTNERS + j) % good / BLOCK))
    lost = rows.where("label = 0").select("label", "x", "rank", F.explode(F.array_distinct(turns)).alias("block"), F.floor(F.col("rank") / span).alias("part"))
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((bad - 1) // span).cast("long")))
    won = rows.where("label = 1").select("label", "x", "rank", F.floor(F.col("rank") / BLOCK).alias("block"), parts.alias("part"))

    def together(table: pa.Table) -> pa.Table:
        table = table.sort_by([("label", "descending"), ("rank", "ascending")]).combine_chunks()
        n = int(np.count_nonzero(table["label"].to_numpy()))
        kinds = {"base": pa.int64(), "x": pa.list_(pa.float64()), "rank": pa.list_(pa.int64()), "y": pa.list_(pa.float64())}
        rank, x = table["rank"].to_numpy(), np.concatenate([c.flatten().to_numpy() for c in table["x"].chunks])
        d = len(NAMES)
        if not 0 < n < len(rank):
            return pa.table({k: pa.array([], t) for k, t in kinds.items()})
        return pa.table({"base": pa.array([int(rank[0])], kinds["base"]), "x": pa.array([x[: n * d]], kinds["x"]), "rank": pa.array([rank[n:]], kinds["rank"]), "y": pa.array([x[n * d :]], kinds["y"])})

    return won.unionByName(lost).groupBy("block", "part").applyInArrow(together, "base long, x array<double>, rank array<long>, y array<double>")


def quantile(values: DataFrame, share: float, n: int, scratch: Scratch) -> float:
    """The exact quantile of the column s of n rows, between neighbours in proportion: by a sort, of which two values are looked up."""
    table = scratch.save(values.select("s").orderBy("s").withColumn("at", F.monotonically_increasing_id()))
    where, got = share * (n - 1), []
    counts = table.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # one row for each task of the sort
    for k in (int(where), min(int(where) + 1, n - 1)):
        for r in counts:
            if k < r["n"]:
                got.append(table.where(F.col("at") == (r["part"] << 33) + k).first()["s"])
                break
            k -= r["n"]
    scratch.drop(table)
    return got[0] + (where - int(where)) * (got[1] - got[0])


def fit(labelled: DataFrame) -> dict:
    """fit_features() of (doc_id, text, label 0/1)."""
    return fit_features(_features_of(labelled))


def fit_features(rows: DataFrame) -> dict:
    """mean, scale and weights of the features, and the cut, from all of (doc_id, label 0/1, x).

    The log-likelihood that a preferred row wins against a rejected one is log sigmoid(w . (x - y)). Newton steps sum gradient and
    curvature over the pairs' partitions and then in Spark: what reaches the driver is a matrix of len(NAMES) squared. The cut is the quantile of
    the rows' scores at the share of rejected ones.
    """
    scratch = Scratch(rows.sparkSession, "quality")
    rows = scratch.save(rows)
    d = len(NAMES)
    stats = rows.agg(F.count("*"), F.sum("label"), *[f(F.col("x")[i]) for i in range(d) for f in (F.avg, F.stddev_pop)]).first()
    n, good = stats[0], stats[1] or 0
    if not 0 < good < n:
        return {"mean": np.zeros(d), "scale": np.ones(d), "w": np.zeros(d), "cut": -2.0 if good else 2.0}
    mean, scale = np.array(stats[2::2]), np.array([s or 1.0 for s in stats[3::2]])
    pairs = scratch.save(pairs_of(ranked(rows), good, n - good))
    w = np.zeros(d)
    for _ in range(STEPS):
        at = w.copy()

        def sums(batches: Iterator[pa.RecordBatch], at=at) -> Iterator[pa.RecordBatch]:
            out = np.zeros(d + d * d + 1)
            for b in batches:
                for base, xs, ranks, ys in zip(*(b.column(i) for i in range(4)), strict=True):
                    x, y = (c.values.to_numpy().reshape(-1, d) for c in (xs, ys))
                    turn = ranks.values.to_numpy() * PARTNERS
                    for k in range(PARTNERS):
                        place = (turn + k) % good - base.as_py()
                        here = (place >= 0) & (place < len(x))
                        diff = (x[place[here]] - y[here]) / scale
                        p = 1 / (1 + np.exp(np.clip(diff @ at, -35, 35)))  # of the rejected row's winning
                        out += np.concatenate([(diff * p[:, None]).sum(0), ((diff * (p * (1 - p))[:, None]).T @ diff).ravel(), [len(p)]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out)], names=["place", "sum"])

        found = pairs.mapInArrow(sums, "place long, sum double").groupBy("place").agg(F.sum("sum").alias("sum")).toPandas()
        total = np.zeros(d + d * d + 1)
        total[found["place"].to_numpy()] = found["sum"].to_numpy()
        gradient = total[:d] / total[-1] - RIDGE * w
        step = np.linalg.solve(total[d:-1].reshape(d, d) / total[-1] + RIDGE * np.eye(d), gradient)
        w = w + step
        if np.abs(step).max() < 1e-4:
            break
    score = sum(F.lit(float(w[i] / scale[i])) * (F.col("x")[i] - F.lit(float(mean[i]))) for i in range(d))
    share = (n - good) / n
    cut = quantile(rows.select(score.alias("s")), share, n, scratch)
    scratch.drop(rows)
    scratch.drop(pairs)
    return {"mean": mean, "scale": scale, "w": w, "cut": float(cut)}


def quality_scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score in 0..1, predicted: score >= CUT), one row per input row.

    Learns from all labelled rows outside the held-out fold; a score depends on the whole text and nothing else. Features are
    extracted once, for learning and scores. The quantile cut is mapped to CUT. Null and empty texts have all features zero; without labels, or
    with one kind only, all scores are equal. Rows that repeat or have no doc_id get a row each.
    """
    scratch = Scratch(docs.sparkSession, "quality-features")
    found = scratch.save(_features_of(texts_of(docs, id_col, text_col).withColumn("label", F.lit(None).cast("int")))).drop("label")
    model = fit_features(found.join(known_labels(labels, label_col), "doc_id").select("doc_id", "label", "x"))
    shift = np.log(CUT / (1 - CUT)) - model["cut"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = (b.column(1).flatten().to_numpy().reshape(-1, len(NAMES)) - model["mean"]) / model["scale"]
            score = 1 / (1 + np.exp(-np.clip(x @ model["w"] + shift, -35, 35)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], names=["doc_id", "score"])

    scored = found.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold_of("doc_id", FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
