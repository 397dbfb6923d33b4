"""The outbox: effects, acknowledgements, delivery order, leases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.operators.ordered import prefix

#: Effects of a cycle, how long one may be in flight.
PER_CYCLE, TIMEOUT_MS = 100, 30_000


def status(effects: DataFrame, acks: DataFrame, key: list[str]) -> DataFrame:
    """(key, created_at, status, acked_at): of effects (key, index) the latest creation counts, and an ack (key, index) only if it comes after that.

    A new creation makes an acknowledged effect pending again; acks without an effect do nothing.
    """
    latest = effects.groupBy(*key).agg(F.max("index").alias("created_at"))
    rows = latest.join(acks.select(*key, F.col("index").alias("ack_index")), key, "left")
    rows = rows.groupBy(*key, "created_at").agg(F.min(F.when(F.col("ack_index") > F.col("created_at"), F.col("ack_index"))).alias("acked_at"))
    return rows.withColumn("status", F.when(F.col("acked_at").isNull(), "Pending").otherwise("Acknowledged"))


def pending(outbox: DataFrame) -> DataFrame:
    return outbox.where("status = 'Pending'")


def next_cycle(outbox: DataFrame, key: list[str], limit: int = PER_CYCLE, in_flight: DataFrame | None = None) -> DataFrame:
    """The next pending effects to run, oldest first, without those in flight."""
    rows = pending(outbox)
    if in_flight is not None:
        rows = rows.join(in_flight, key, "left_anti")
    return rows.orderBy("created_at", *key).limit(limit)


def cycles(outbox: DataFrame, order: str, limit: int = PER_CYCLE) -> DataFrame:
    """The pending effects with the cycle (from 0) in which each is run, limit a cycle in the order of an integer column; ranks go by its buckets."""
    rows = prefix(pending(outbox), order, F.lit(1), "ahead", inclusive=False)
    return rows.withColumn("cycle", F.floor(F.coalesce("ahead", F.lit(0)) / F.lit(limit)).cast("long")).drop("ahead")


def counters(outbox: DataFrame) -> DataFrame:
    """One row (executed, acknowledged): effects handed to an executor, and those whose acknowledgement came back."""
    return outbox.agg(F.count("*").alias("executed"), F.count_if(F.col("status") == "Acknowledged").alias("acknowledged"))


def timed_out(in_flight: DataFrame, now_ms: int, timeout_ms: int = TIMEOUT_MS) -> DataFrame:
    """Effects (started_ms) that have been in flight for longer than timeout_ms and are to be run again."""
    return in_flight.where(F.lit(now_ms) - F.col("started_ms") > timeout_ms)


def compacted(outbox: DataFrame, before: int) -> DataFrame:
    """The outbox without acknowledged effects created before an index."""
    return outbox.where((F.col("status") == "Pending") | (F.col("created_at") >= before))


def counts(outbox: DataFrame) -> DataFrame:
    return outbox.agg(F.count("*").alias("effects"), F.count_if(F.col("status") == "Pending").alias("pending"))


def leases(tokens: DataFrame, order: str, token: str) -> DataFrame:
    """tokens with fence (the largest token so far) and valid: the holder's token is the fence."""
    return prefix(tokens, order, F.col(token), "fence", "max").withColumn("valid", F.col(token) == F.col("fence"))
