"""Links, classifiers, retrieval, top-k and the pipeline against brute force."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerflow.llm import decontaminate, quality, simhash, topk, toxicity, training
from ledgerflow.llm.common import Scratch, read_table, texts_of
from ledgerflow.llm.components import connected_components
from tests.llm.test_near_copies import roots_of as copies


def roots_of(n, edges):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def near(words, budget):
    words = np.array(words, np.uint64)
    return [(i, int(j)) for i in range(len(words)) for j in np.flatnonzero(np.bitwise_count(words ^ words[i]) <= budget) if j > i]


def naive_fingerprint(text):
    words = [w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in "".join(c.lower() if "A" <= c <= "Z" else c for c in text)).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates(spark, data):
    texts = [r.text for r in read_table(spark, data, "documents").orderBy("doc_id").collect()]
    rng = random.Random(6)
    long = " ".join(rng.choice("abcdefgh") + str(i) for i in range(900))
    every = [None, "", "\xa0", "One two", "one TWO", "a b c d", *texts, long, *[long.replace(f"{c}1", "zz", 1) for c in "abcdefgh"]]
    docs = spark.createDataFrame([(i + 5, t, "x") for i, t in enumerate(every)], "doc_id long, text string, fp string").repartition(5)
    rows = sorted(simhash.near_duplicates(docs).collect(), key=lambda r: r.doc_id)
    prints = [naive_fingerprint(t or "") for t in every]
    assert [int(r.fingerprint, 16) for r in rows] == prints and all(len(r.fingerprint) == 16 for r in rows)
    assert [r.component_id - 5 for r in rows] == roots_of(len(every), near(prints, 4))


@pytest.mark.parametrize("limit", [20_000, 40])
def test_links_with_and_without_split_groups(spark, limit):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, 30, dtype=np.uint64)
    words = centre[np.minimum(rng.integers(0, 60, 900), 29)]  # half of them around one word
    for _ in range(4):
        words = words ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64))
    words = np.unique(words)
    df = spark.createDataFrame([([int(w)], i) for i, w in enumerate(words.view(np.int64))], "fp array<long>, node long")
    edges = [(r.src, r.dst) for r in simhash.links(df, 4, limit).collect()]
    assert roots_of(len(words), edges) == roots_of(len(words), near(words, 4))


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)] + [(7, 7), (3, 4)]
    got = {r.node: r.root for r in connected_components(spark, spark.createDataFrame(edges, "src long, dst long"), Scratch(spark, "test")).collect()}
    roots = roots_of(300, edges)
    assert got == {x: roots[x] for e in edges if e[0] != e[1] for x in e}
    assert connected_components(spark, spark.createDataFrame([], "src long, dst long"), Scratch(spark, "test")).collect() == []


def marked(spark, n=400):
    rng = random.Random(2)
    bad, rows, labels = ["moron", "scum", "vile"], [], []
    for i in range(n):
        words = [rng.choice("abcdefghijklmnop") + rng.choice("xyz") for _ in range(rng.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(bad)
        low = i % 5 == 3
        text = " ".join([words[0]] * 30 if low else words).upper() if i % 2 else " ".join([words[0]] * 30 + ["moron"] * toxic if low else words)
        rows.append((i, text if not (low and toxic) else text + " moron", "z", 3))
        labels.append((i, int(not low), int(toxic)))
    rows += [(n, None, "z", 3), (n + 1, "", "z", 3), (0, rows[0][1], "z", 3), (None, "SCUM", "z", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, label string, turn int"), spark.createDataFrame([*labels, (n + 5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("run", "column"), [(toxicity.toxicity_scores, "toxic"), (quality.quality_scores, "quality")])
def test_classifiers(spark, run, column):
    docs, labels = marked(spark)
    rows = run(docs, labels).collect()
    assert len(rows) == docs.count()
    truth = {r.doc_id: r[column] for r in labels.collect()}
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert {r.doc_id for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= (0.5 if column == "toxic" else 0.3)) for r in rows)
    again = {(r.doc_id, r.score) for r in run(docs.repartition(3), labels.repartition(2)).collect()}
    assert all(any(a == r.doc_id and abs(s - r.score) < 1e-6 for a, s in again) for r in rows)


@pytest.mark.parametrize("run", [toxicity.toxicity_scores, quality.quality_scores])
def test_classifiers_without_labels_or_rows(spark, run):
    docs, labels = marked(spark, 20)
    assert len({r.score for r in run(docs, labels.limit(0)).collect()}) == 1
    assert run(docs.limit(0), labels).collect() == []


def test_sample_is_bounded_and_leaves_held_out_rows(spark):
    docs, labels = marked(spark)
    ids = [r.doc_id for r in training.labelled_sample(docs, labels, "toxic", 100).collect()]
    assert 50 < len(ids) < 150 and all(zlib.crc32(str(i).encode()) % 5 for i in ids)


def test_held_out_accuracy_on_the_tables(spark, data):
    docs, labels = read_table(spark, data.replace("0.001", "0.01"), "documents"), read_table(spark, data.replace("0.001", "0.01"), "labels")
    truth = {r.doc_id: r for r in labels.collect()}
    good = [r for r in quality.quality_scores(docs, labels).where("held_out").collect() if r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id].quality for r in good]) > 0.95
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, labels).collect()}
    calm = [i for i, r in truth.items() if not r.toxic]
    assert np.mean([i in kept for i in calm]) > 0.98


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        out = [0]
        for j, y in enumerate(b):
            out.append(row[j] + 1 if x == y else max(row[j + 1], out[j]))
        row = out
    return row[-1]


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        masks = {}
        for i, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << i
        assert decontaminate.common_subsequence(a, masks, b) == lcs(a, b)


def test_contaminated_documents(spark, data):
    """Planted passages, some with every eighth word changed, against the best window by brute force."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 5)))
    common = [word() for _ in range(30)]
    speak = lambda n: [rng.choice(common) if rng.random() < 0.5 else word() for _ in range(n)]
    items = [speak(rng.randint(12, 60)) for _ in range(12)]
    docs, held = [], set()
    for i in range(120):
        text = speak(rng.randint(0, 300))
        if i % 6 == 0:
            k = i // 6 % 12
            copy = [w if j % 8 or i % 12 else "changed" for j, w in enumerate(items[k])]
            at = rng.randint(0, len(text))
            text[at:at] = copy
            held.add((i, k))
        docs.append((i, " ".join(text).capitalize() + ".", 1.0))
    docs += [(200, None, 1.0), (201, "", 1.0), (None, " ".join(items[0]), 1.0)]
    table = spark.createDataFrame(docs, "doc_id long, text string, cosine double")
    bench = spark.createDataFrame([*[(k, ", ".join(w)) for k, w in enumerate(items)], (0, ", ".join(items[0])), (90, "!?"), (91, None), (None, "x")], "item_id long, text string")
    got = decontaminate.contaminated(table, bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == held | {(None, 0)}
    assert all(r.common_words >= 0.8 * r.item_words for r in got.collect())
    kept = decontaminate.drop_contaminated(table, bench)
    assert {r.doc_id for r in kept.collect()} == {d[0] for d in docs} - {i for i, _ in held} - {None} and kept.columns == table.columns
    assert decontaminate.contaminated(table, bench.limit(0)).collect() == [] and decontaminate.contaminated(table.limit(0), bench).collect() == []


def test_a_list_is_left_early_where_bounds_allow():
    """One component decides: the lists of the others needn't be read far before a few candidates are left."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 3, (4_000, 4)).astype(float)
    x[:, 0] = rng.permutation(4_000) ** 2
    lists = topk.SortedLists(x, np.arange(4_000))
    got = lists.top(x[:3] * [[1, 0, 0, 0]] + [[5.0, 0, 0, 0]], np.array([-1, -2, -3]), 5)
    best = np.argsort(-x[:, 0])[:5].tolist()
    assert [i for _, i, _ in got] == best * 3 and lists.reads <= 3 * 4_000


def test_retrieval_recall_on_the_tables(spark, data):
    """All pairs with LCS of 0.8 of an item in some window, found by a scan of windows at every word."""
    docs, bench = read_table(spark, data, "documents"), read_table(spark, data, "benchmark")
    items = {r.item_id: decontaminate.words_of(r.text.encode()) for r in bench.collect()}
    expected = set()
    for r in docs.collect():
        words = decontaminate.words_of((r.text or "").encode())
        for k, item in items.items():
            own, size = set(item), len(item)
            flags = np.concatenate(([0], np.cumsum([w in own for w in words])))
            for at in range(max(1, len(words) - size + 1)):
                if flags[min(len(words), at + size)] - flags[at] >= 0.8 * size and lcs(item, words[at : at + size]) >= 0.8 * size:
                    expected.add((r.doc_id, k))
                    break
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert expected and len(found & expected) >= 0.9 * len(expected)


def test_index_follows_the_tables(spark, data):
    docs, bench = read_table(spark, data, "documents"), read_table(spark, data, "benchmark")
    index = decontaminate.build_index(texts_of(docs), decontaminate._rows(bench, "item_id", "text", None), Scratch(spark, "test"))
    assert np.allclose(np.linalg.norm(index.units, axis=1), 1, atol=1e-3) and (index.lengths > 0).all() and len(index.ids) == bench.count()
    texts = [set(decontaminate.words_of((r.text or "").encode())) for r in docs.collect()]
    for word, k in list(index.vocabulary.items())[::40]:
        assert index.idf[k] == pytest.approx(max(0.05, np.log((len(texts) + 1) / (sum(word in t for t in texts) + 0.5))))


def test_the_latent_space_is_a_truncated_svd(spark, data, monkeypatch):
    """Products in the space against those of an exact SVD of the same weighted passages."""
    rng = np.random.default_rng(1)
    monkeypatch.setattr(decontaminate, "RANK", 10)
    topics = [[f"t{k}w{i}" for i in range(8)] for k in range(10)]
    texts = [" ".join(rng.choice(topics[i % 10], 30)) for i in range(60)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(t), None) for k, t in enumerate(topics)], "i long, t string, a string")
    index = decontaminate.build_index(table, bench, Scratch(spark, "test"))
    rows = []
    for weight, text in [(1, t) for t in texts] + [(decontaminate.WEIGHT, " ".join(t)) for t in topics]:
        x = np.zeros(len(index.vocabulary))
        for w in text.split():
            x[index.vocabulary[w.encode()]] += index.idf[index.vocabulary[w.encode()]]
        rows.append(np.sqrt(weight) * x / np.linalg.norm(x))
    _, _, v = np.linalg.svd(np.array(rows))
    space = v[:10].T @ v[:10]
    ours = index.basis[:-1] / index.idf[:-1, None]
    assert np.allclose(ours @ ours.T, space, atol=1e-3)


def test_benchmark_in_parts_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "STRETCH", 64)
    rng = random.Random(5)
    speak = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(n)]
    items = [speak(20) for _ in range(12)]
    long = speak(500)
    for k, at in enumerate(range(30, 480, 40)):
        if k < len(items):
            long[at:at] = items[k]
    docs = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(speak(400))), (1, " ".join(items[3]))], "doc_id long, text string")
    bench = spark.createDataFrame([*[(k, " ".join(w)) for k, w in enumerate(items)], (3, " ".join(speak(15))), (50, "abc")], "item_id long, text string")
    for chars in (100, 1 << 20):
        got = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench, part_chars=chars).collect())
        assert got == sorted([(1, k) for k in range(12)] + [(1, 3)])
        assert [r.doc_id for r in decontaminate.drop_contaminated(docs, bench, part_chars=chars).collect()] == [2]


def naive_top(rows, k):
    fine = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in fine:
        if i % 5 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in fine if j != i and len(v) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize(("block", "queries"), [(16_384, 1_024), (13, 4)])
def test_top_k(spark, block, queries):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, -0.3, 0.0, 0.2, 0.7]) for _ in range(6)]) for i in range(90)]
    rows += [(90, None), (95, [1.0, None] * 3), (100, [float("nan")] * 6), (105, [float("inf")] * 6), (110, [1.0, 2.0]), (115, []), (120, [0.0] * 6), (96, rows[1][1])]
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<float>, d int").repartition(3)
    got = topk.exact_top_k(df, F.col("vec_id") % 5 == 0, 4, block=block, queries=queries)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(tuple(r) for r in got.collect()) == naive_top(rows, 4)


def test_top_k_small_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk.exact_top_k(df, F.col("vec_id") == 0).collect()) == [(0, 1, 1, 256 * 512)]
    assert topk.exact_top_k(df.where("vec_id = 0"), F.col("vec_id") == 0).collect() == []
    assert topk.exact_top_k(df.limit(0), F.col("vec_id") == 0).collect() == []


@pytest.mark.parametrize("scale", [1, 1 << 40])
def test_sorted_lists_by_integers_and_doubles(scale):
    rng = np.random.default_rng(0)
    x, ids = rng.integers(-9, 9, (300, 8)), np.arange(300) * 3
    for kind in (np.int64, np.float64):
        lists = topk.SortedLists((x * (scale if kind is np.int64 else 1)).astype(kind), ids)
        got = sorted(lists.top(x[::7].astype(kind), ids[::7], 5))
        assert 0 < lists.reads <= len(x[::7]) * x.size  # each list is read once by each query, at most to its end
        assert len(got) == 5 * len(x[::7])
        for own, i, s in got:
            assert s == int(x[own // 3] @ x[i // 3]) * (scale if kind is np.int64 else 1)


def test_pipeline(spark, data):
    """Each stage against what its operator says of the stage's own input."""
    import corpus_pipeline

    docs = read_table(spark, data, "documents")
    labels, bench = read_table(spark, data, "labels"), read_table(spark, data, "benchmark")
    scratch, ids = Scratch(spark, "test"), lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    stages = dict(corpus_pipeline.STAGES)
    calm = scratch.save(stages["toxicity"](spark, docs, data))
    assert ids(calm) == ids(toxicity.toxicity_scores(docs, labels).where("predicted = 0")) and calm.columns == docs.columns
    single = scratch.save(stages["near_dedup"](spark, calm, data))
    group = dict(zip((r.doc_id for r in calm.collect()), copies([r.text for r in calm.collect()]), strict=True))
    assert sorted(group[i] for i in ids(single)) == sorted(set(group.values()))
    clean = scratch.save(stages["decontamination"](spark, single, data))
    assert set(ids(single)) - set(ids(clean)) == {r.doc_id for r in decontaminate.contaminated(single, bench).collect()}
    masked = scratch.save(stages["secrets"](spark, clean, data))
    assert ids(masked) == ids(clean) and masked.columns == docs.columns
    packed = stages["packing"](spark, masked, data)
    assert sorted({r.doc_id for r in packed.collect()}) == ids(masked)
    assert sorted(r[:5] for r in corpus_pipeline.run(spark, data).collect()) == sorted(r[:5] for r in packed.collect())
