"""Client sessions: duplicates, admission, fair order, micro-batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions.scalar import session_class
from ledgerflow.operators.ordered import carried_fold, prefix

#: Requests in flight, entries that replication may lag, bytes and time of a batch.
MAX_INFLIGHT, MAX_GAP = 5_000, 10_000
BATCH_BYTES, BATCH_DELAY_MS = 65_536, 5


def classify(requests: DataFrame) -> DataFrame:
    """requests (arrival, client_id, sequence_number) with class: new, duplicate or stale, and highest: the largest number before.

    Stale and duplicate rows never raise the largest number, so it is a running maximum over all earlier rows of the client, taken in
    buckets of arrivals: a client with a third of all requests is many tasks.
    """
    rows = prefix(requests, "arrival", F.col("sequence_number"), "highest", "max", inclusive=False, by=("client_id",))
    return rows.withColumn("class", session_class(F.col("sequence_number"), F.col("highest")))


def admit(requests: DataFrame, is_primary: Column, inflight_change: Column, gap: Column, max_inflight: int = MAX_INFLIGHT, max_gap: int = MAX_GAP) -> DataFrame:
    """classify() with in_flight (before the row) and decision, the first that holds: not_primary, duplicate, stale, overloaded, accepted."""
    rows = prefix(classify(requests), "arrival", inflight_change, "in_flight", inclusive=False)
    busy = (F.col("in_flight") >= max_inflight) | (gap >= max_gap)
    decision = F.when(~is_primary, "not_primary").when(F.col("class") != "new", F.col("class")).when(busy, "overloaded").otherwise("accepted")
    return rows.withColumn("decision", decision)


def fair_order(requests: DataFrame) -> DataFrame:
    """(arrival, client_id, round, slot): one request of each client per round, clients by first arrival, slots from 0.

    Places in a client's queue, in a round, and of the rounds are all counted in buckets: no task sees all rows of a client or a round.
    """
    rows = prefix(requests.select("arrival", "client_id"), "arrival", F.lit(1), "earlier", inclusive=False, by=("client_id",))
    firsts = requests.groupBy("client_id").agg(F.min("arrival").alias("first_arrival"))
    rows = rows.join(firsts, "client_id").select("arrival", "client_id", (F.col("earlier") + 1).cast("int").alias("round"), "first_arrival")
    starts = prefix(rows.groupBy("round").agg(F.count("*").alias("n")), "round", F.col("n"), "start", inclusive=False)
    rows = prefix(rows, "first_arrival", F.lit(1), "ahead", inclusive=False, by=("round",))
    return rows.join(starts.select("round", "start"), "round").select("arrival", "client_id", "round", (F.col("start") + F.col("ahead")).cast("long").alias("slot"))


def batches(requests: DataFrame, key: str, time: str, size: str, order: str, max_bytes: int = BATCH_BYTES, max_delay: int = BATCH_DELAY_MS) -> DataFrame:
    """(order, key, batch, batch_bytes): a batch closes with the request that brings it to max_bytes, or before one that comes max_delay after its first."""

    def step(state, _, number, at, n):
        batch, first, held = state
        if held and at - first >= max_delay:
            batch, held = batch + 1, 0
        first = at if not held else first
        held += n
        result = (batch, held)
        return ((batch + 1, None, 0) if held >= max_bytes else (batch, first, held)), result

    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, {time} {kinds[time]}, {size} {kinds[size]}, batch long, batch_bytes long"
    folded = carried_fold(requests, key, [order], [key, order, time, size], step, lambda: (0, None, 0), schema)
    return folded.select(order, key, "batch", "batch_bytes")


def next_sequence(requests: DataFrame) -> DataFrame:
    """(client_id, last_sequence) of every client; unknown clients are absent and count as 0."""
    return requests.groupBy("client_id").agg(F.max("sequence_number").alias("last_sequence"))


def numbered(payloads: DataFrame) -> DataFrame:
    """payloads (client_id, arrival) with sequence_number from 1 for each client."""
    return prefix(payloads, "arrival", F.lit(1), "sequence_number", by=("client_id",)).withColumn("sequence_number", F.col("sequence_number").cast("long"))
