"""Packing of tokenized documents into sequences: dominance reduction, then best fit, planned on the counts of lengths."""

from __future__ import annotations

import base64
import json
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.llm.common import Scratch, local_frame, slices, texts_of, trim
from ledgerflow.llm.transducer import Splitter

#: Pieces of text whose ids a worker remembers.
KEPT_PIECES = 150_000
#: Rows of one length in a bucket, about; ranks are counted bucket by bucket.
BUCKET_ROWS = 500


class _Ids(dict):
    """A piece of text to its ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.encode(piece.encode("utf-8", "surrogatepass")), "<u4").tobytes()
        if len(piece) <= 40:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class ByteTokenizer:
    """Ids of texts by a byte-level BPE vocabulary, as the tokenizers library gives them, piece by piece with a memory."""

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken

        self.path = public_tokenizers.path(f"{name}.json")
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as file:  # the same vocabulary as ranks
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.ids = _Ids(tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._encode_single_piece)
        with open(self.path, "rb") as file:
            self.special = [t["content"] for t in json.load(file)["added_tokens"]]
        self.splitter = Splitter(joined=True)

    @cached_property
    def whole(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers; texts with special strings go to the library itself."""
        joined = "\n".join(texts) + "\n"
        ends = np.cumsum([len(t) + 1 for t in texts])
        starts, stops = self.splitter.split(joined, ends - 1)
        found = list(map(self.ids.__getitem__, [joined[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]))
        cuts = np.searchsorted(starts, ends).tolist()
        out = [b"".join(found[a:b]) for a, b in zip([0, *cuts], cuts, strict=False)]
        for i, t in enumerate(texts):
            if any(s in t for s in self.special):
                out[i] = np.array(self.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        return out


@cache
def tokenizer_of(name: str) -> ByteTokenizer:
    return ByteTokenizer(name)


def pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k", end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and end_id, cut only where longer than capacity.

    All pieces but the first are capacity long. A null text is empty and gives the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = tokenizer_of(tokenizer), np.array([end_id], "<u4").tobytes()
        for ids, texts in slices(batches):
            rows = []
            for doc, data in zip(ids, tokens.encode([t.decode("utf-8", "replace") for t in texts]), strict=True):
                data += end
                n = len(data) // 4
                at, size, k = 0, (n - 1) % capacity + 1, 0
                while at < n:
                    rows.append((doc, k, at, size, zlib.crc32(data[4 * at : 4 * (at + size)])))
                    at, size, k = at + size, capacity, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        trim()

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass
class Plan:
    """Sequences by pattern: (how many sequences, {length: pieces of it in each})."""

    capacity: int
    patterns: list[tuple[int, dict[int, int]]] = field(default_factory=list)

    @property
    def sequences(self) -> int:
        return sum(n for n, _ in self.patterns)


def _reduce(counts: dict[int, int], capacity: int, plan: Plan) -> None:
    """Fixes, for the longest piece first, a set that dominates every other set the piece could share a sequence with.

    With r the room beside the piece and k the longest piece left that fits: nothing fits, and it stays alone; k fills r
    exactly; or no two left fit in r together, and k is the best of the single ones; or no three fit and no two together
    are longer than k. Whatever else could stand beside the piece may then be exchanged for k, with no more sequences. All pieces of
    a length are fixed at one time.
    """
    sizes = sorted(counts)

    def least(n: int) -> int:
        """Sum of the n shortest pieces left, besides the one at hand."""
        total = 0
        for s in sizes:
            take = min(n, counts[s])
            total, n = total + take * s, n - take
            if not n:
                return total
        return 1 << 60

    def best_two(room: int) -> int:
        """The largest sum of two pieces left that is within room."""
        best, lo, hi = 0, 0, len(sizes) - 1
        while lo <= hi:
            both = sizes[lo] + sizes[hi]
            if both > room:
                hi -= 1
            else:
                if lo < hi or counts[sizes[lo]] > 1:
                    best = max(best, both)
                lo += 1
        return best

    for size in sorted(counts, reverse=True):
        while counts.get(size):
            room = capacity - size
            counts[size] -= 1  # the piece at hand
            if not counts[size]:
                sizes.remove(size)
            place = bisect_left(sizes, room + 1)
            k = sizes[place - 1] if place else None
            if k is None:
                many, pattern = 1 + counts[size], {size: 1}
            elif k == room or least(2) > room or (least(3) > room and best_two(room) <= k):
                # as long as k lasts, every piece of this length meets the same case: what is left only shrinks
                pattern = {size: 2} if k == size else {size: 1, k: 1}
                many = 1 + (counts[size] - 1) // 2 if k == size else min(1 + counts[size], counts[k])
            else:
                if not counts[size]:
                    sizes.insert(bisect_left(sizes, size), size)
                counts[size] += 1
                break
            plan.patterns.append((many, pattern))
            counts[size] += 1
            if size not in sizes:
                sizes.insert(bisect_left(sizes, size), size)
            for s, each in pattern.items():
                counts[s] -= many * each
                if not counts[s]:
                    sizes.remove(s)


def _best_fit(counts: dict[int, int], capacity: int, plan: Plan) -> None:
    """Longest first, each piece into the fullest sequence that has room for it, else into a new one; by the number alike."""
    rooms: dict[int, list[tuple[int, dict[int, int]]]] = {}
    order: list[int] = []

    def put(room: int, n: int, pattern: dict[int, int]) -> None:
        if room not in rooms:
            rooms[room] = []
            order.insert(bisect_left(order, room), room)
        rooms[room].append((n, pattern))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            place = bisect_left(order, size)
            if place < len(order):
                room = order[place]
                n, pattern = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    order.pop(place)
                take = min(n, left)
                if n > take:
                    put(room, n - take, pattern)
                put(room - size, take, pattern | {size: pattern.get(size, 0) + 1})
                left -= take
            else:
                each = min(capacity // size, left)
                n = left // each
                put(capacity - each * size, n, {size: each})
                left -= n * each
    for entries in rooms.values():
        plan.patterns += entries


def plan_packing(counts: dict[int, int], capacity: int) -> Plan:
    """Patterns that place counts[length] pieces of each length, 1 to capacity; both tables have at most capacity lengths."""
    plan, counts = Plan(capacity), {s: n for s, n in counts.items() if n}
    if full := counts.pop(capacity, 0):
        plan.patterns.append((full, {capacity: 1}))
    _reduce(counts, capacity, plan)
    _best_fit({s: n for s, n in counts.items() if n}, capacity, plan)
    return plan


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k", end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    Every row of docs is a document, repeated ids included; a null or empty text gives one piece, the end id. An empty
    table gives none. The plan needs only how many pieces there are of each length, so what reaches the driver is
    at most capacity counts, whatever the input. Each piece's rank among those of its length, counted in hashed buckets of
    about BUCKET_ROWS, tells its place in the plan; a length that a third of all documents share is many buckets, also
    where the documents have no id or the same one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    cut = scratch.save(pieces(docs, tokenizer, end_id, capacity, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    totals = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_packing(totals, capacity)
    slots, first, used = [], 0, dict.fromkeys(totals, 0)
    for many, pattern in plan.patterns:
        offset = 0
        for size, each in sorted(pattern.items(), reverse=True):
            slots.append((size, used[size], used[size] + many * each, first, each, offset))
            used[size] += many * each
            offset += each * size
        first += many
    names = "length lo hi first each base".split()
    table = local_frame(spark, {n: [slot[i] for slot in slots] for i, n in enumerate(names)}, ", ".join(f"{n} long" for n in names))
    parts = local_frame(spark, {"length": list(totals), "buckets": [-(-n // BUCKET_ROWS) for n in totals.values()]}, "length long, buckets long")
    cut = cut.join(F.broadcast(parts), "length").withColumn("bucket", F.pmod(F.xxhash64("row"), F.col("buckets")))  # capacity rows at most
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    start = cut.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row")) - 1
    ranked = cut.withColumn("rank", rank).join(start, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    # at most a few thousand rows: a pattern for each step of a plan over capacity lengths
    placed = ranked.join(F.broadcast(table) if len(slots) < 100_000 else table, (ranked.length == table.length) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    step = F.col("rank") - F.col("lo")
    return placed.select(
        "doc_id", "piece", "start", ranked.length, "ids_crc32", (F.col("first") + F.floor(step / F.col("each"))).alias("sequence_id"), (F.col("base") + step % F.col("each") * ranked.length).alias("offset")
    )
