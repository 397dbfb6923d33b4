"""Log scans, pages, frames, appends and compaction. A null committed index means that nothing is committed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions import scalar
from ledgerflow.operators.ordered import prefix

#: Entries of a page, largest payload.
PAGE, MAX_PAYLOAD = 100, 64 << 20


def committed_rows(log: DataFrame, committed: int | None) -> DataFrame:
    return log.where(F.lit(False)) if committed is None else log.where(F.col("index") <= committed)


def range_scan(log: DataFrame, start: int, end: int, committed: int | None, base: int = 0, uncommitted: bool = False) -> DataFrame:
    """Entries start..end, both inclusive, the end clamped to the committed index unless uncommitted ones are asked for.

    A start before base is truncated history and raises; the bounds are literals and reach the files' statistics.
    """
    if start < base:
        raise IndexError(f"index {start} is truncated: the log begins at {base}")
    if not uncommitted:
        if committed is None:
            return log.where(F.lit(False))
        end = min(end, committed)
    return log.where(F.col("index").between(start, end))


def read_class(index: Column, base: int, committed: int | None) -> Column:
    """What a read of index would meet, checked in this order."""
    state = F.when(index < base, "truncated")
    return state.otherwise("nothing_committed") if committed is None else state.when(index > committed, "uncommitted").otherwise("readable")


def length(log: DataFrame, committed: int | None) -> int:
    """Entries ever committed, those compacted away included."""
    return 0 if committed is None else committed + 1


def pages(log: DataFrame, first: int, committed: int, size: int = PAGE) -> DataFrame:
    """(page, first_index, last_index, entries, has_more) of the committed entries from first on."""
    rows = log.where(F.col("index").between(first, committed)).groupBy(F.call_function("div", F.col("index") - first, F.lit(size)).alias("page"))
    rows = rows.agg(F.min("index").alias("first_index"), F.max("index").alias("last_index"), F.count("*").alias("entries"))
    return rows.withColumn("has_more", F.col("last_index") < committed)


def page(log: DataFrame, first: int, committed: int, size: int = PAGE) -> tuple[DataFrame, bool]:
    """One page from first on, and whether there is more."""
    return range_scan(log, first, min(first + size - 1, committed), committed), first + size - 1 < committed


def frames(log: DataFrame, size: Column) -> DataFrame:
    """(index, payload_size, padding, frame_size, offset) of the entries in a file that begins with its metadata."""
    rows = log.select("index", size.cast("long").alias("payload_size"))
    rows = rows.withColumn("padding", scalar.padding(F.col("payload_size"))).withColumn("frame_size", scalar.frame_size(F.col("payload_size")))
    rows = prefix(rows, "index", F.col("frame_size"), "before", inclusive=False)
    return rows.select("index", "payload_size", "padding", "frame_size", (F.col("before") + scalar.METADATA_BYTES).alias("offset"))


def project_event(log: DataFrame) -> DataFrame:
    """Entries as events: flags as booleans, the payload as it is."""
    f = F.col("flags")
    return log.select("index", "view_id", "stream_id", "timestamp_ns", scalar.flag(f, 1).alias("tombstone"), scalar.flag(f, 2).alias("checkpoint"), scalar.flag(f, 4).alias("config_change"), "schema_version", "payload")


def append(log: DataFrame, batch: DataFrame, order: str, timestamp_ns: int, view_id: int) -> DataFrame:
    """log with the rows of batch (stream_id, flags, payload, and the column order) behind it, with the next indexes and one timestamp.

    All or nothing: an empty payload, or one above MAX_PAYLOAD, fails the batch. order is an integer column; ranks are counted by its buckets.
    """
    checked = F.when(F.length("payload").between(1, MAX_PAYLOAD), F.col("payload")).otherwise(F.raise_error(F.lit("payload is empty or too large")))
    begin = log.agg(F.coalesce(F.max("index") + 1, F.lit(0))).first()[0]
    ranked = prefix(batch, order, F.lit(1), "rank")
    rows = ranked.select((F.col("rank") + F.lit(begin - 1)).cast("long").alias("index"), F.lit(view_id).cast("long").alias("view_id"), "stream_id", F.lit(timestamp_ns).cast("long").alias("timestamp_ns"), "flags", F.lit(1).alias("schema_version"), checked.alias("payload"))
    return log.unionByName(rows, allowMissingColumns=True)


def compact(log: DataFrame, base: int) -> DataFrame:
    """The log from base on; base may lie past its end. Write it to a new place, then move readers there."""
    return log.where(F.col("index") >= base)
