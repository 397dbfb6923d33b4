"""Protocol messages as rows: the index they speak of, commits, view changes, gaps that catch-up fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.operators.ordered import prefix
from ledgerflow.operators.quorum import range_past


def message_index(kind: Column, index: Column, entries: Column) -> Column:
    """The last index a message speaks of, null for control messages; an empty batch speaks of its first."""
    batch = index + F.greatest(F.coalesce(entries, F.lit(0)) - 1, F.lit(0))
    return F.when(kind.isin("Prepare", "PrepareOk", "CatchUpRequest"), index).when(kind == "PrepareBatch", batch).when((kind == "CatchUpResponse") & (entries > 0), batch)


def commits(messages: DataFrame, order: str, commit_index: str, last_log_index: int | None) -> DataFrame:
    """messages with committed: the largest commit index so far, no further than the local log; null as long as none has come.

    A null commit index says that nothing is committed, which isn't index 0.
    """
    if last_log_index is None:
        return messages.withColumn("committed", F.lit(None).cast("long"))
    clamped = F.when(F.col(commit_index).isNotNull(), F.least(F.col(commit_index), F.lit(last_log_index)))
    return prefix(messages, order, clamped, "committed", "max")


def start_views(messages: DataFrame, order: str, view: str, fence: int = 0) -> DataFrame:
    """messages with adopted: the view is strictly newer than every one before it, and no older than the durable fence."""
    rows = prefix(messages, order, F.col(view), "current", "max", inclusive=False)
    return rows.withColumn("adopted", (F.col(view) >= fence) & (F.col(view) > F.coalesce("current", F.lit(-1))))


def fill_gaps(received: DataFrame, caught_up: DataFrame, start: int = 0) -> DataFrame:
    """(index, source) of the contiguous run from start in received and caught_up (index): received entries come first, each index once."""
    rows = received.select("index", F.lit("received").alias("source")).unionByName(caught_up.select("index", F.lit("caught_up").alias("source")))
    firsts = rows.where(F.col("index") >= start).groupBy("index").agg(F.max("source").alias("source"))  # received sorts last
    gap = range_past(rows, start).join(firsts, "index", "left_anti").agg(F.min("index")).first()[0]
    return firsts.where(F.col("index") < gap).select("index", "source")


def wanted(received: DataFrame, start: int, known: int, page: int = 100) -> DataFrame:
    """(from_index, to_index) of the requests that would fetch what is missing of start..known, page by page."""
    every = received.sparkSession.range(start, known + 1).withColumnRenamed("id", "index")
    missing = every.join(received.select("index").distinct(), "index", "left_anti")
    pages = missing.groupBy(F.call_function("div", F.col("index") - start, F.lit(page).cast("long")).alias("page"))
    return pages.agg(F.min("index").alias("from_index"), F.max("index").alias("to_index")).select("from_index", "to_index")
