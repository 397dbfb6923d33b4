"""Near copies: SimHash fingerprints joined by tries deal out candidates, exact Jaccard similarities confirm them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import Scratch, slices, texts_of, trim
from ledgerflow.llm.components import connected_components
from ledgerflow.llm.simhash import MINIMA, fingerprint_series, links, shingle_hashes, sketch

#: Words of a shingle; Jaccard similarity from which texts are copies, as a fraction.
SHINGLE, SIMILARITY = 5, (4, 5)
#: Fingerprints of a text, blocks of each, and bits in which candidates differ at most: similarity 0.8 as a share of the 64 bits.
VIEWS, BLOCKS, BUDGET = 12, 4, 12
#: Fingerprints that are joined first: what they link is one node for the others, so that a large group of copies isn't linked again in every block.
FIRST = 2
#: Texts and bytes of text that one task compares; larger groups are split into pairs of parts.
GROUP_LIMIT, GROUP_BYTES = 1_000, 4 << 20
#: Texts with which all others are compared before the rest, at most.
LEADERS = 64
#: Row numbers up to which a table of them is sent to where the texts are; a larger one is shuffled with the texts.
SENT = 1 << 20

_TURNS = np.random.default_rng(5).integers(1, 1 << 63, VIEWS, dtype=np.uint64)
_SKETCH = np.random.default_rng(6).integers(1, 1 << 63, MINIMA, dtype=np.uint64)


def confirmed(nodes: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges, to the smallest node of each group, that chain up all nodes whose sets have a Jaccard similarity of SIMILARITY or more.

    First some texts, each of no group so far, are compared with all: a dense group of copies becomes one by a few of them. Then
    every text outside the largest group is compared with all that share a member of its set. Two texts of the largest group are
    linked already, so no link between groups is missed, and no pair within the largest group is looked at.
    """
    over, under = SIMILARITY
    n = len(sets)
    if n < 2:
        return []
    sizes = np.array([len(s) for s in sets], np.int64)
    _, member = np.unique(np.concatenate(sets), return_inverse=True)
    ends = sizes.cumsum()
    starts, up = ends - sizes, list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def link(i: int, both: np.ndarray) -> None:
        for j in np.flatnonzero((under + over) * both >= over * (sizes[i] + sizes)).tolist():  # both / (a + b - both) >= over / under
            a, b = top(i), top(j)
            up[max(a, b)] = min(a, b)

    full, led = sizes > 0, 0
    mark = np.zeros(int(member.max()) + 1 if len(member) else 1, np.int64)
    for i in range(n):
        if led == min(LEADERS, 1 + n // 8):
            break
        if full[i] and up[i] == i:
            own = member[starts[i] : ends[i]]
            mark[own] = 1
            both = np.zeros(n, np.int64)
            both[full] = np.add.reduceat(mark[member], starts[full])
            mark[own] = 0
            link(i, both)
            led += 1
    groups = np.array([top(i) for i in range(n)])
    largest = np.bincount(groups).argmax()
    rest = np.flatnonzero((groups != largest) & full)
    if len(rest):
        order = np.argsort(member, kind="stable")
        listed, begins = np.repeat(np.arange(n), sizes)[order], np.concatenate(([0], np.bincount(member).cumsum()))
        for i in rest.tolist():
            own = member[starts[i] : ends[i]]
            own = own[begins[own + 1] - begins[own] > 1]
            if len(own):
                link(i, np.bincount(np.concatenate([listed[begins[x] : begins[x + 1]] for x in own.tolist()]), minlength=n))
    groups, least = [top(i) for i in range(n)], {}
    for i, g in enumerate(groups):
        least[g] = min(least.get(g, nodes[i]), nodes[i])
    return [(int(nodes[i]), int(least[g])) for i, g in enumerate(groups) if nodes[i] != least[g]]


def sent(rows: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it has SENT rows at most."""
    return F.broadcast(rows) if rows.count() <= SENT else rows


def near_copies(docs: DataFrame, row_col: str = "row", text_col: str = "text", group_limit: int = GROUP_LIMIT, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(row, component: smallest row reachable over pairs with a 5-word Jaccard similarity of 0.8 or more), one per row of docs.

    row_col tells rows apart: a long, never null, no two alike. Texts with one list of words are one node, their smallest row, before any join.
    Candidates are nodes that agree in a block of one of VIEWS fingerprints of their 5-word shingles, differ in at most BUDGET
    bits of it, as the trie join that links() runs finds, and whose sketches agree: the more texts there are, the more of them are within BUDGET
    bits by chance, and without sketches most would become one component. The components of candidates are compared pair by pair, on
    shingle sets (as 64-bit hashes) and not on fingerprints, so that no link is unconfirmed. A component above the limits is
    dealt to pairs of hashed parts: each pair of its texts still meets in a task. Null and empty texts are without words and copies of each
    other; a text under five words is one shingle. An empty table gives none.
    """
    spark = docs.sparkSession
    texts = texts_of(docs, row_col, text_col).withColumnRenamed("doc_id", "row")
    scratch = Scratch(spark, "near-copies")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, some in slices(batches):
            digests = [xxhash.xxh3_128_digest(b" ".join(t.lower().split())) for t in some]
            hashes = [shingle_hashes(t, SHINGLE) for t in some]
            views = np.array([fingerprint_series(h, _TURNS) for h in hashes]).view(np.int64)
            sketches = np.array([sketch(h, _SKETCH) for h in hashes]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, views.size + 1, VIEWS, dtype=np.int32)), pa.array(views.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), lists, *map(pa.array, sketches.T.copy())], names=["row", "digest", "fp", "s0", "s1"])
        trim()

    marked = scratch.save(texts.mapInArrow(mark, "row long, digest binary, fp array<long>, s0 long, s1 long"))
    nodes = scratch.save(marked.groupBy("digest").agg(F.min(F.struct("row", "fp", "s0", "s1")).alias("n")).select("digest", F.col("n.row").alias("node"), "n.fp", "n.s0", "n.s1"))
    early = scratch.save(links(nodes.select("node", F.slice("fp", 1, FIRST).alias("fp"), "s0", "s1"), BUDGET, blocks=BLOCKS))
    linked = scratch.save(connected_components(spark, early, scratch))
    labels = nodes.join(linked, "node", "left").select("node", F.coalesce("root", "node").alias("label"), F.slice("fp", FIRST + 1, VIEWS - FIRST).alias("fp"), "s0", "s1")
    labels = scratch.save(labels)
    late = scratch.save(links(labels.select(F.col("label").alias("node"), "fp", "s0", "s1"), BUDGET, blocks=BLOCKS))
    roots = scratch.save(connected_components(spark, late, scratch))
    found = labels.select("node", "label").join(roots.withColumnRenamed("node", "label"), "label", "left")
    moved = found.select("node", F.coalesce("root", "label").alias("root")).where("node <> root")
    groups = scratch.save(moved.unionByName(moved.select(F.col("root").alias("node"), "root").distinct()))
    for table in (early, linked, labels, late, roots):
        scratch.drop(table)
    own = scratch.save(texts.join(sent(groups.withColumnRenamed("node", "row")), "row"))
    parts = F.ceil(2 * F.greatest(F.count("*") / F.lit(group_limit), F.sum(F.octet_length("text")) / F.lit(group_bytes))).alias("parts")
    large = own.groupBy("root").agg(parts).where("parts > 2")
    tags = F.expr("transform(filter(sequence(0L, parts - 1), x -> x <> part), x -> least(x, part) * parts + greatest(x, part))")
    member = own.join(large, "root", "left").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))
    member = member.select("row", "text", "root", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(tags)).alias("tag"))

    def confirm(table: pa.Table) -> pa.Table:
        sets = [np.unique(shingle_hashes(t.as_py().encode("utf-8", "surrogatepass"), SHINGLE)) for t in table.column("text")]
        edges = confirmed(table.column("row").to_numpy(), sets)
        return pa.table({"src": pa.array([a for a, _ in edges], pa.int64()), "dst": pa.array([b for _, b in edges], pa.int64())})

    edges = scratch.save(member.repartition("root", "tag").groupBy("root", "tag").applyInArrow(confirm, "src long, dst long"))
    roots = connected_components(spark, edges, scratch)
    scratch.drop(own)
    scratch.drop(edges)
    found = nodes.select("digest", "node").join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("component"))
    return marked.select("row", "digest").join(found, "digest").select("row", "component")


def drop_near_copies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, without those that are near copies of an earlier row, as near_copies() links them.

    Rows are numbered as they are written, so whatever ids they have, null and repeated ones included, of each group exactly one
    row stays, the first, and a text without copies always does.
    """
    scratch = Scratch(docs.sparkSession, "near-dedup")
    row = "__row"  # no column of docs: rows are told apart by their number alone
    while row in docs.columns:
        row += "_"
    numbered = scratch.save(docs.withColumn(row, F.monotonically_increasing_id()))
    copies = scratch.save(near_copies(numbered, row, text_col).where("component < row").select(F.col("row").alias(row)))
    return numbered.join(sent(copies), row, "left_anti").select(docs.columns)
