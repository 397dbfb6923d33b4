"""Snapshots: which one to recover from, whether it fits the log, state at an index, what to keep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.operators import ledger
from ledgerflow.operators.ordered import prefix

#: Fixed value: entries between snapshots.
INTERVAL = 1_000


def due(last_applied: int | None, last_snapshot: int | None, interval: int = INTERVAL) -> bool:
    """Whether a snapshot is due: interval entries since the last one, or since the log began."""
    if last_applied is None:
        return False
    return (last_applied + 1 if last_snapshot is None else last_applied - last_snapshot) >= interval


def latest_valid(snapshots: DataFrame, at: int | None = None) -> DataFrame:
    """The one valid snapshot with the largest last_included_index, up to at; corrupt ones are passed over. No row if there is none."""
    rows = snapshots.where("valid")
    if at is not None:
        rows = rows.where(F.col("last_included_index") <= at)
    best = rows.agg(F.max_by(F.struct(*rows.columns), "last_included_index").alias("s")).where("s is not null")
    return best.select("s.*")


def as_of(targets: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(target, snapshot_index, replay_from, to_replay) for each target index: the latest valid snapshot at or before it, null if none."""
    marks = snapshots.where("valid").select(F.col("last_included_index").alias("at"), F.lit(None).cast("long").alias("target"))
    rows = marks.unionByName(targets.select(F.col("target").alias("at"), "target"))
    found = prefix(rows, "at", F.when(F.col("target").isNull(), F.col("at")), "own", "max").where("target is not null").select("target", F.col("own").alias("earlier"))
    same = snapshots.where("valid").select(F.col("last_included_index").alias("target"), F.lit(True).alias("hit")).distinct()
    found = found.join(same, "target", "left").select("target", F.when(F.col("hit"), F.col("target")).otherwise(F.col("earlier")).alias("snapshot_index"))
    return found.select("target", "snapshot_index", (F.coalesce("snapshot_index", F.lit(-1)) + 1).alias("replay_from"), (F.col("target") - F.coalesce("snapshot_index", F.lit(-1))).alias("to_replay"))


def bridge(log: DataFrame, snapshot: dict | None, committed: int | None) -> str:
    """Whether a snapshot {last_included_index, chain_hash} and log (index, prev_hash) fit: ok, LogBehindSnapshot, LogGap or ChainBridgeMismatch.

    The first entry after the snapshot must hold the snapshot's chain hash; a log that ends with the snapshot needs no bridge.
    """
    if snapshot is None:
        return "ok"
    at = snapshot["last_included_index"]
    if committed is None or committed < at:
        return "LogBehindSnapshot"
    if committed == at:
        return "ok"
    entry = log.where(F.col("index") == at + 1).select("prev_hash").first()
    if entry is None:
        return "LogGap"
    return "ok" if entry["prev_hash"] == snapshot["chain_hash"] else "ChainBridgeMismatch"


def bridges(log: DataFrame, snapshots: DataFrame, committed: int | None) -> DataFrame:
    """snapshots (last_included_index, chain_hash) with verdict, as bridge() gives it for each: one join with the log, for the entries right after them."""
    at = F.col("last_included_index")
    after = log.select((F.col("index") - 1).alias("last_included_index"), "prev_hash", F.lit(True).alias("there"))
    behind = F.lit(True) if committed is None else at > committed
    verdict = F.when(behind, "LogBehindSnapshot").when(at == F.lit(committed), "ok").when(F.col("there").isNull(), "LogGap")
    verdict = verdict.when(F.col("prev_hash").eqNullSafe(F.col("chain_hash")), "ok").otherwise("ChainBridgeMismatch")
    return snapshots.join(after, "last_included_index", "left").withColumn("verdict", verdict).drop("prev_hash", "there")


def due_since(points: DataFrame, interval: int = INTERVAL) -> DataFrame:
    """as_of()'s rows with due: interval entries or more are to be replayed."""
    return points.withColumn("due", F.col("to_replay") >= interval)


def state_at(operations: DataFrame, at: int, snapshot: DataFrame | None = None, snapshot_index: int = -1, user: str = "user_id") -> DataFrame:
    """(user, balance) after index at: a snapshot's balances (user, balance) at snapshot_index, and only the operations after it."""
    suffix = operations.where((F.col("index") > snapshot_index) & (F.col("index") <= at))
    return ledger.balances(ledger.outcomes(suffix, snapshot, user), user).select(user, "balance")


def superseded(snapshots: DataFrame) -> DataFrame:
    """Snapshots that may go once the latest is written."""
    last = snapshots.agg(F.max("last_included_index").alias("last_included_index"))
    return snapshots.join(F.broadcast(last), "last_included_index", "left_anti")
