"""Integrity of a log: chains, gaps, views, and where a recovery would end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.operators.ordered import carried_fold, prefix

#: Checks of an entry in the order in which the first failing one counts.
CHECKS = ("zero_header", "bad_header_checksum", "index_break", "chain_break", "view_regression", "payload_too_large", "bad_payload_hash")
#: What ends a scan for good, whatever follows.
FATAL = {"index_break": "MonotonicityViolation", "chain_break": "BrokenChain", "view_regression": "ViewRegression", "payload_too_large": "PayloadTooLarge"}

GENESIS = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def chain_hash(prev_hash: Column, index: Column, payload: Column) -> Column:
    """The native chain's hash of an entry, from the hash stored in it: rows are verified independently of each other."""
    return F.sha2(F.concat(prev_hash, payload, index.cast("string")), 256)


def build_chain(log: DataFrame) -> DataFrame:
    """(stream_id, index, payload, prev_hash, chain_hash): each stream's chain, built in order. Only sinks and fixtures need this."""
    from hashlib import sha256

    def step(prev: str, index: int, payload: str, stream: int):
        own = sha256(f"{prev}{payload}{index}".encode()).hexdigest()
        return own, (prev, own)

    return carried_fold(log, "stream_id", ["index"], ["index", "payload", "stream_id"], step, lambda: GENESIS, "index long, payload string, stream_id long, prev_hash string, chain_hash string")


def chain_violations(chained: DataFrame) -> DataFrame:
    """(stream_id, index, violation): entries whose hash isn't that of their content, or whose successor holds another hash.

    Adjacency within a stream is by position; a window by stream and a self-contained hash need one shuffle.
    """
    order = Window.partitionBy("stream_id").orderBy("index")
    rows = chained.withColumn("expected", F.coalesce(F.lag("chain_hash").over(order), F.lit(GENESIS)))
    kind = F.when(F.col("prev_hash") != F.col("expected"), "broken_link").when(F.col("chain_hash") != chain_hash(F.col("prev_hash"), F.col("index"), F.col("payload")), "content_changed")
    return rows.select("stream_id", "index", kind.alias("violation")).where("violation is not null")


def link_violations(log: DataFrame, own_hash: str = "chain_hash") -> DataFrame:
    """(index): entries of one unbroken log whose prev_hash isn't the hash of the entry before; a self-join, as one window over a log is one task."""
    before = log.select((F.col("index") + 1).alias("index"), F.col(own_hash).alias("expected"))
    return log.join(before, "index").where(F.col("prev_hash") != F.col("expected")).select("index")


def missing_indexes(present: DataFrame, first: int, last: int) -> DataFrame:
    """(index) of first..last that present (index) lacks."""
    return present.sparkSession.range(first, last + 1).withColumnRenamed("id", "index").join(present.select("index").distinct(), "index", "left_anti")


def regressions(rows: DataFrame, order: str, view: str) -> DataFrame:
    """(order, view, highest): rows whose view is lower than the highest before them."""
    out = prefix(rows.select(order, view), order, F.col(view), "highest", "max", inclusive=False)
    return out.where(F.col(view) < F.col("highest"))


def recovery_outcome(checked: DataFrame, by: str) -> DataFrame:
    """(by, entries, failed_index, failure, last_valid, outcome) for every log in checked (by, index, position, failure).

    failure is the first failing check of an entry or null. The scan ends at the first entry that fails. Fatal checks keep their class;
    a zero header is a hole if a valid entry follows, else the end; a torn entry is corruption if a valid one follows, else cut off.
    """
    failed = F.col("failure").isNotNull()
    seen = checked.groupBy(by).agg(
        F.count("*").alias("entries"),
        F.min(F.when(failed, F.struct("position", "index", "failure"))).alias("first"),
        F.max(F.when(~failed, F.col("position"))).alias("last_good"),
    )
    last = checked.join(seen.select(by, "first", "last_good", "entries"), by).groupBy(by).agg(
        F.first("entries").alias("entries"),
        F.first("first").alias("first"),
        F.first("last_good").alias("last_good"),
        F.max(F.when(F.col("first").isNull() | (F.col("position") < F.col("first.position")), F.col("index"))).alias("last_valid"),
    )
    follows = F.coalesce(F.col("last_good") > F.col("first.position"), F.lit(False))
    outcome = F.when(F.col("first").isNull(), "Clean")
    for check, name in FATAL.items():
        outcome = outcome.when(F.col("first.failure") == check, name)
    outcome = outcome.when(F.col("first.failure") == "zero_header", F.when(follows, "ZeroHole").otherwise(F.when(F.col("last_valid").isNull(), "CleanEmpty").otherwise("Clean")))
    outcome = outcome.otherwise(F.when(follows, "MidLogCorruption").otherwise("Truncated"))
    return last.select(by, "entries", F.col("first.index").alias("failed_index"), F.col("first.failure").alias("failure"), "last_valid", outcome.alias("outcome"))


def manifest_check(manifest: DataFrame, log_view: int | None, log_index: int | None) -> DataFrame:
    """The one-row manifest with verdict: behind_log, ahead_of_log or ok. The view must not be behind; the index may be one ahead."""
    next_index = 0 if log_index is None else log_index + 1
    verdict = F.when(F.lit(log_view is not None) & (F.col("highest_view") < F.lit(log_view or 0)), "behind_log").when(F.col("last_log_index") > next_index, "ahead_of_log").otherwise("ok")
    return manifest.withColumn("verdict", verdict)
