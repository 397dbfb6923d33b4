"""Scalar rules as column expressions; all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a frame's header and of the file's metadata, frame alignment, retry delays, waits.
HEADER_BYTES, METADATA_BYTES, ALIGNMENT = 80, 64, 8
BACKOFF_MS, BACKOFF_DOUBLINGS = 100, 5


def flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(bit) != 0


def padding(size: Column) -> Column:
    return F.pmod(F.lit(ALIGNMENT) - size % ALIGNMENT, F.lit(ALIGNMENT))


def frame_size(size: Column) -> Column:
    return F.lit(HEADER_BYTES) + size + padding(size)


def millis(nanos: Column) -> Column:
    return F.call_function("div", nanos, F.lit(1_000_000))


def seconds(nanos: Column) -> Column:
    return F.call_function("div", nanos, F.lit(1_000_000_000))


def primary_of_view(view: Column, nodes: int) -> Column:
    return F.pmod(view, F.lit(nodes))


def backoff_ms(attempt: Column) -> Column:
    """The delay doubles with each attempt, five times at most."""
    return (F.lit(BACKOFF_MS) * F.pow(F.lit(2.0), F.least(attempt, F.lit(BACKOFF_DOUBLINGS)))).cast("long")


def redirect_target(hint: Column, current: Column, nodes: int) -> Column:
    """The hinted leader, else the node after the current one; an unknown current one is node 0."""
    return F.coalesce(hint, F.pmod(F.coalesce(current, F.lit(0)) + 1, F.lit(nodes)))


def is_overload(message: Column) -> Column:
    return F.coalesce(F.contains(message, F.lit("System Overloaded")), F.lit(False))


def effect_id(client: Column, sequence: Column, sub_index: Column) -> Column:
    """A digest that identifies an effect, as hex."""
    return F.sha2(F.concat_ws("/", client.cast("string"), sequence.cast("string"), sub_index.cast("string")), 256)


def short_id(digest: Column) -> Column:
    return F.lower(F.substring(digest, 1, 16))


def saturating_add(a: Column, b: Column) -> Column:
    """The sum, at most the largest unsigned 64-bit number."""
    return F.least((a.cast("decimal(20,0)") + b.cast("decimal(20,0)")), F.lit((1 << 64) - 1).cast("decimal(21,0)")).cast("decimal(20,0)")


def snapshot_name(index: Column) -> Column:
    return F.format_string("snapshot_%020d.snap", index)


def snapshot_index(name: Column) -> Column:
    """The index in a snapshot's file name, null for any other name."""
    digits = F.regexp_extract(name, r"(?:^|/)snapshot_(\d{20})\.snap$", 1)
    return F.when(digits != "", digits.cast("long"))


def session_class(sequence: Column, highest: Column) -> Column:
    """new, duplicate or stale against the highest sequence number seen before from the client; zero repeats as new while it is the highest."""
    fresh = highest.isNull() | (sequence > highest) | ((sequence == 0) & (highest == 0))
    return F.when(fresh, "new").when(sequence == highest, "duplicate").otherwise("stale")
