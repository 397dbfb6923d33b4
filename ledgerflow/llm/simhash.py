"""SimHash near-duplicates: 64-bit fingerprints, a binary trie self-join within a Hamming budget, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import Scratch, slices, texts_of, trim
from ledgerflow.llm.components import connected_components

#: Distinct fingerprints of one block value that one task joins; larger groups are split into pairs of parts.
GROUP_LIMIT = 20_000
#: Words of small groups that a task joins at one time; split groups whose numbers of parts are broadcast, at most.
TOGETHER, LARGE_GROUPS = 50_000, 100_000
#: Node pairs that a step of the traversal handles at one time.
FRONTIER = 1 << 14
#: Leaf pairs below two nodes up to which they are compared at once.
LEAVES = 64
#: Minima that a sketch keeps, BITS of each; equal ones from which two sketches agree: at a Jaccard similarity of 0.8 there are fewer in one pair of 10^8,
#: of texts without a common shingle as many in one pair of 4 * 10^6.
MINIMA, BITS, EQUAL = 32, 4, 12
#: Rows up to which a component's sketches are compared pair by pair; those that are compared with all others before, in larger ones; pairs at one time.
FEW, LEADERS, PAIRS = 32, 64, 1 << 16


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 values (seed 42) of the text's shingles in order; a text of fewer words is one shingle, one without words has none."""
    words = text.lower().split()  # on bytes: A-Z only, and white space is \x20 and \x09-\x0D
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.fromiter(map(len, words), np.int64, len(words)).cumsum() + np.arange(len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    spans = zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, n)


def _majority(parts: Iterator[np.ndarray], n: int) -> np.ndarray:
    """For each column of 64-bit hashes the word of the bits that are set in over half of the n rows, which come in parts."""
    ones = 0
    for part in parts:
        for at in range(0, len(part), 255):  # so many rows add up within a byte
            some = np.ascontiguousarray(part[at : at + 255]).view(np.uint8)
            ones = ones + np.unpackbits(some, axis=1, bitorder="little").sum(0, dtype=np.uint8).astype(np.int64)
    return np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """The text's fingerprint: a bit is set if it is set in over half of the shingles' hashes."""
    hashes = shingle_hashes(text, shingle)
    return int(_majority(iter([hashes[:, None]]), len(hashes))[0]) if len(hashes) else 0


def _scrambled(hashes: np.ndarray, turns: np.ndarray) -> Iterator[np.ndarray]:
    """For some hashes after the other, a row each, their scrambled values, a column for each of turns."""
    for at in range(0, len(hashes), 4080):
        x = (hashes[at : at + 4080, None] ^ turns) * np.uint64(0xFF51AFD7ED558CCD)  # fixed values: multipliers of a public 64-bit finalizer
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        yield x ^ (x >> np.uint64(33))


def fingerprint_series(hashes: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """One fingerprint for each of turns, from the shingles' hashes scrambled by it: independent views of one text. All zero without words."""
    return _majority(_scrambled(hashes, turns), len(hashes)) if len(hashes) else np.zeros(len(turns), np.uint64)


def sketch(hashes: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """BITS of the least scrambled hash for each of MINIMA turns, as words of 64 bits: of two sets' the share of equal ones follows their Jaccard similarity."""
    least = np.min([x.min(0) for x in _scrambled(hashes, turns)], axis=0) if len(hashes) else np.zeros(len(turns), np.uint64)
    each = 64 // BITS
    parts = (least & np.uint64((1 << BITS) - 1)).reshape(-1, each) << (np.arange(each, dtype=np.uint64) * np.uint64(BITS))
    return np.bitwise_or.reduce(parts, axis=1)


def agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sketches, of words along the first axis, have EQUAL equal minima or more."""
    other = np.uint8(0)
    for x in map(np.bitwise_xor, a, b):
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        x &= np.uint64(0x1111111111111111)
        other = other + np.bitwise_count(x)
    return other <= MINIMA - EQUAL


def agreeing(own: np.ndarray, sketches: np.ndarray) -> np.ndarray:
    """Labels (a row's place each) of the components that agreeing sketches (word by row) make within those of own, all pairs of which count.

    In a large one some rows, each of no group so far, are compared with all first; then all outside the largest group are. Two rows of the
    largest group are of one component already, so no link is missed.
    """
    label, order = np.arange(len(own)), np.argsort(own, kind="stable")
    begins = np.flatnonzero(np.concatenate(([True], own[order][1:] != own[order][:-1])))
    sizes = np.diff(np.append(begins, len(order)))
    few = (sizes > 1) & (sizes <= FEW)
    first, last = np.repeat(begins[few], sizes[few]), np.repeat((begins + sizes)[few], sizes[few])
    place = np.arange(len(first)) - np.repeat(sizes[few].cumsum() - sizes[few], sizes[few]) + first  # of each row of a small one
    after = last - place - 1
    for at in range(0, len(place), PAIRS // FEW):
        some, n = place[at : at + PAIRS // FEW], after[at : at + PAIRS // FEW]
        i = np.repeat(some, n)
        j = i + 1 + np.arange(len(i)) - np.repeat(n.cumsum() - n, n)
        i, j = order[i], order[j]
        linked = agree(sketches[:, i], sketches[:, j])
        label = _unite(label, i[linked], j[linked])
    for a, n in zip(begins[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
        rows = order[a : a + n]
        held, inner, led = sketches[:, rows], np.arange(n), -1
        for _ in range(min(LEADERS, n // 8)):
            alone = np.flatnonzero(np.bincount(inner, minlength=n)[inner] == 1)
            alone = alone[alone > led]
            if not len(alone):
                break
            led = alone[0]
            linked = np.flatnonzero(agree(held, held[:, alone[:1]]))
            inner = _unite(inner, linked, np.full(len(linked), led))
        rest = np.flatnonzero(inner != np.bincount(inner).argmax())
        step = max(1, PAIRS // n)
        for at in range(0, len(rest), step):
            some = rest[at : at + step]
            i, j = np.nonzero(agree(held[:, some, None], held[:, None]))
            inner = _unite(inner, some[i], j)
        label[rows] = rows[inner]
    return label


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp long: the fingerprint's 64 bits as a signed number), one row per input row. Empty and null texts: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            fp = np.array([fingerprint(t, shingle) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])
        trim()

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _high_bit(x: np.ndarray) -> np.ndarray:
    """Place of the highest set bit, -1 for zero."""
    top = (x >> np.uint64(32)).astype(np.float64)
    low = (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(top > 0, np.frexp(top)[1] + 31, np.frexp(low)[1] - 1)


def _unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (smallest place in the component) after linking places i and j."""
    while True:
        a, b = label[i], label[j]
        if (a == b).all():
            return label
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(parent, up := parent[parent]):
            parent = up
        label = parent[label]


def trie_components(fp: np.ndarray, starts: np.ndarray, budget: int) -> np.ndarray:
    """Labels of the components of sorted distinct 64-bit words that differ from one another in at most budget bits.

    The sorted words are a path-compressed binary trie: a node is a range, its branching bit the highest in which the
    range's ends differ. starts: where the subtrees begin that are joined with themselves. Pairs of nodes go down
    together; the bits above both branching bits are settled, and once more than budget of them differ the pair
    is dropped. So is a pair whose leaves are all of one component already: a dense ball of near copies takes about
    linear work, and what comes out is a label per word, not the ball's pairs.
    """
    n = len(fp)
    label = np.arange(n)
    if n < 2:
        return label
    root = np.zeros(n, np.int64)
    root[starts[1:]] = 1
    root = root.cumsum()
    near = np.flatnonzero((np.bitwise_count(fp[1:] ^ fp[:-1]) <= budget) & (root[1:] == root[:-1]))
    label = _unite(label, near, near + 1)

    def middle(lo, hi, bit):
        shift = bit.astype(np.uint64)
        return np.searchsorted(fp, (fp[hi - 1] >> shift) << shift)

    lo, hi, pairs = starts, np.append(starts[1:], n), []
    while len(lo):
        lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
        if not len(lo):
            break
        mid = middle(lo, hi, _high_bit(fp[lo] ^ fp[hi - 1]))
        pairs.append(np.stack([lo, mid, mid, hi]))
        lo, hi = np.concatenate([lo, mid]), np.concatenate([mid, hi])
    stack = pairs
    while stack:
        pair = stack.pop()
        if pair.shape[1] > FRONTIER:
            stack.append(pair[:, FRONTIER:])
            pair = pair[:, :FRONTIER]
        changes = np.concatenate(([0], (label[1:] != label[:-1]).cumsum()))
        one = (changes[pair[0]] == changes[pair[1] - 1]) & (changes[pair[2]] == changes[pair[3] - 1]) & (label[pair[0]] == label[pair[2]])
        pair = pair[:, ~one]
        a_lo, a_hi, b_lo, b_hi = pair
        a_bit, b_bit = _high_bit(fp[a_lo] ^ fp[a_hi - 1]), _high_bit(fp[b_lo] ^ fp[b_hi - 1])
        open_bits = np.maximum(a_bit, b_bit) + 1
        fits = np.bitwise_count((fp[a_lo] ^ fp[b_lo]) >> open_bits.astype(np.uint64)) <= budget
        across = b_hi - b_lo
        below = (a_hi - a_lo) * across
        leaf = below <= LEAVES
        at = np.flatnonzero(fits & leaf)
        of = np.repeat(at, below[at])
        place = np.arange(len(of)) - np.repeat(below[at].cumsum() - below[at], below[at])
        step = place // across[of]
        i, j = a_lo[of] + step, b_lo[of] + place - step * across[of]
        linked = np.flatnonzero(np.bitwise_count(fp[i] ^ fp[j]) <= budget)
        label = _unite(label, i[linked], j[linked])
        for left in (True, False):
            down = fits & ~leaf & ((a_bit >= b_bit) == left)
            if not down.any():
                continue
            lo, hi, o_lo, o_hi = (a_lo, a_hi, b_lo, b_hi) if left else (b_lo, b_hi, a_lo, a_hi)
            lo, hi, o_lo, o_hi = lo[down], hi[down], o_lo[down], o_hi[down]
            mid = middle(lo, hi, (a_bit if left else b_bit)[down])
            stack.append(np.concatenate([np.stack([lo, mid, o_lo, o_hi]), np.stack([mid, hi, o_lo, o_hi])], axis=1))
    return label


def _cuts(blocks: int) -> list[tuple[int, int]]:
    """(start, width) of so many blocks of the 64 bits, from the top."""
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _joined(fp: np.ndarray, node: np.ndarray, start: int, width: int, budget: int, sketches: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(src, dst) from the nodes of each component of words that agree in the block and chain up within budget bits to its smallest node.

    With sketches a component falls into those that agreeing sketches make. Components of different blocks that share their smallest node so give the same edges, and the edges of a group of copies stay few.
    """
    shift = np.uint64(start)
    word = (fp << shift) | (fp >> np.uint64(64 - start)) if start else fp
    by = np.lexsort((node, word))
    word, node = word[by], node[by]
    first = np.concatenate(([True], word[1:] != word[:-1]))
    distinct = word[first]
    top = distinct >> np.uint64(64 - width)
    label = trie_components(distinct, np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1]))), budget)
    own = label[first.cumsum() - 1]
    if sketches is not None:
        own = agreeing(own, sketches[:, by])
    order = np.lexsort((node, own))
    begins = np.flatnonzero(np.concatenate(([True], own[order][1:] != own[order][:-1])))
    least = np.repeat(node[order][begins], np.diff(np.append(begins, len(order))))
    moved = node[order] != least
    return node[order][moved], least[moved]


def links(words: DataFrame, budget: int = 4, group_limit: int = GROUP_LIMIT, blocks: int | None = None) -> DataFrame:
    """(src, dst) between nodes of words (fp array<long>, node long) that chain up all pairs found within budget bits at one place of fp.

    With columns s0 and s1, a row's sketch, pairs are linked that chain up so and whose sketches agree.

    The words of a place are cut into blocks, budget + 1 if not said otherwise: then words within budget agree in one of
    them, and nothing is missed; with fewer blocks only pairs that agree in one are found. Each word is dealt out once by each
    block's value, and the tries of one value are joined in one task. A value with over group_limit words is dealt to
    pairs of hashed parts: each pair of its words still meets in a task, and no task holds over about group_limit words of it.
    Rows come to a task sorted by value and are joined group by group, TOGETHER or the largest group at one time. At
    most one edge comes out per word and task.
    """
    cuts = _cuts(blocks or budget + 1)
    n, more = len(cuts), [c for c in ("s0", "s1") if c in words.columns]
    each = words.select("node", *more, F.posexplode("fp").alias("place", "fp")).select("node", *more, "fp", F.explode(F.sequence(F.col("place") * n, F.col("place") * n + n - 1)).alias("k"))
    value = F.lit(None).cast("long")
    for k, (a, w) in enumerate(cuts):  # a block's value is computed where it is needed and not shuffled
        value = F.when(F.col("k") % n == k, F.shiftrightunsigned(F.shiftleft(F.col("fp"), a), 64 - w)).otherwise(value)
    large = each.groupBy("k", value.alias("v")).count().where(F.col("count") > group_limit)
    large = Scratch(words.sparkSession, "links").save(large.select("k", "v", F.ceil(F.col("count") * 2 / group_limit).cast("long").alias("parts")))
    found = large.count()
    tag = F.lit(-1).cast("long")
    if found:
        large = F.broadcast(large) if found <= LARGE_GROUPS else large
        own = F.pmod(F.xxhash64("fp", "node"), F.col("parts"))
        tags = F.expr("transform(filter(sequence(0L, coalesce(parts, 1L) - 1), x -> x <> own), x -> least(x, own) * parts + greatest(x, own))")
        each = each.withColumn("v", value).join(large, ["k", "v"], "left").withColumn("own", own)
        each = each.select("node", *more, "fp", "k", F.explode(F.when(F.col("parts").isNull(), F.array(tag)).otherwise(tags)).alias("tag"))
    else:
        each = each.withColumn("tag", tag)
    dealt = each.repartition("k", value, "tag").select("fp", "node", "k", value.alias("v"), "tag", *more).sortWithinPartitions("k", "tag", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush(columns: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            fp, node, k, _, tag, *s = columns
            sketches = np.stack(s).view(np.uint64) if s else None
            edges = np.flatnonzero((k[1:] != k[:-1]) | (tag[1:] != tag[:-1])) + 1
            for a, e in zip([0, *edges.tolist()], [*edges.tolist(), len(k)], strict=True):
                if e - a > 1:
                    src, dst = _joined(fp[a:e], node[a:e], *cuts[int(k[a]) % len(cuts)], budget, None if sketches is None else sketches[:, a:e])
                    if len(src):
                        yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])

        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            fp, node, k, v, tag, *s = (c.to_numpy() for c in batch.columns)
            held.append((fp.view(np.uint64), node, k, v, tag, *s))
            size += len(fp)
            if size >= TOGETHER:
                whole = tuple(np.concatenate(c) for c in zip(*held, strict=True))
                change = np.flatnonzero((whole[2][1:] != whole[2][:-1]) | (whole[3][1:] != whole[3][:-1]) | (whole[4][1:] != whole[4][:-1]))
                cut = int(change[-1]) + 1 if len(change) else 0  # the last group may go on
                if cut:
                    yield from flush(tuple(c[:cut] for c in whole))
                held, size = [tuple(c[cut:].copy() for c in whole)], size - cut
        if size:
            yield from flush(tuple(np.concatenate(c) for c in zip(*held, strict=True)))
        held.clear()
        trim()

    return dealt.mapInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, budget: int = 4, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(doc_id, fingerprint: 16 lowercase hex digits, component_id: smallest doc_id reachable), one row per input row.

    Rows with one fingerprint are one node, its smallest doc_id, before any join: copies cost nothing further. Empty and
    null texts have fingerprint zero and are linked like others. Repeated rows stay; rows with a null doc_id get a
    fingerprint and no component of their own (component_id null unless others share it). An empty table gives none.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    marked = scratch.save(fingerprints(docs, id_col, text_col, shingle))
    words = scratch.save(marked.groupBy("fp").agg(F.min("doc_id").alias("node")))
    edges = scratch.save(links(words.where("node is not null").select("node", F.array("fp").alias("fp")), budget, group_limit))
    roots = connected_components(spark, edges, scratch)
    scratch.drop(edges)
    words = words.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return marked.join(words, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
