"""Applications of one's own: state by key, folded in log order, with rejections and effects."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.operators.ordered import carried_fold


class Rejected(Exception):
    """Raised by apply: the event changes nothing, and the log goes on."""


@dataclass(frozen=True)
class Context:
    """What an event may depend on besides the state: its place, its view, its time, and bytes that are the same on every replay."""

    index: int
    view_id: int
    time_ns: int
    seed: bytes


class Application(Protocol):
    """Pure functions: the same state, event and context always give the same result. A state must not be changed in place."""

    def genesis(self) -> Any: ...

    def apply(self, state: Any, payload: Any, context: Context) -> tuple[Any, list[str]]: ...

    def snapshot(self, state: Any) -> str: ...

    def restore(self, text: str) -> Any: ...

    def query(self, state: Any, request: str) -> str: ...


def seed(prev_hash: bytes | None, index: int) -> bytes:
    """32 bytes from the hash before an entry and its index."""
    return hashlib.sha256((prev_hash or b"") + index.to_bytes(8, "little")).digest()


def run(app: Application, events: DataFrame, key: str, opening: DataFrame | None = None) -> DataFrame:
    """(key, index, status Applied|Rejected, effects, state) for events (key, index, view_id, timestamp_ns, prev_hash, payload).

    opening (key, index, state) holds snapshots: a key begins from its own, and events at or before its index are skipped.
    Any other exception of apply fails the job, as a halted log would: nothing is applied in part.
    """
    columns = [key, "index", "view_id", "timestamp_ns", "prev_hash", "payload"]
    rows = events.select(*columns, F.lit(None).cast("string").alias("opening"))
    if opening is not None:
        nulls = [F.lit(None).cast(events.schema[c].dataType).alias(c) for c in columns[2:]]
        rows = rows.unionByName(opening.select(key, F.lit(-1).cast("long").alias("index"), *nulls, F.to_json(F.struct("index", "state")).alias("opening")))

    def step(held, who, index, view_id, time_ns, prev_hash, payload, snapshot):
        import json

        state, after = held
        if snapshot is not None:
            kept = json.loads(snapshot)
            state = app.restore(kept["state"])
            return (state, kept["index"]), ("Opening", [], kept["state"])
        if index <= after:
            return held, ("Skipped", [], None)
        try:
            state, effects = app.apply(state, payload, Context(index, view_id, time_ns, seed(prev_hash, index)))
        except Rejected as why:
            return held, ("Rejected", [str(why)], app.snapshot(state))
        return (state, after), ("Applied", list(effects), app.snapshot(state))

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*columns, "opening"]) + ", status string, effects array<string>, state string"
    done = carried_fold(rows, key, ["index"], [*columns, "opening"], step, lambda: (app.genesis(), -1), schema)
    return done.where(F.col("status").isin("Applied", "Rejected")).select(key, "index", "status", "effects", "state")


def states(results: DataFrame, key: str) -> DataFrame:
    """(key, index, state): a snapshot of every key after its last applied event."""
    done = results.where("status = 'Applied'")
    return done.groupBy(key).agg(F.max("index").alias("index"), F.max_by("state", "index").alias("state"))


def ask(app: Application, held: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """(key, request, answer) of requests (key, request) to the states held (key, state); keys without one are asked about the genesis state.

    Answers come from snapshots and change nothing.
    """
    rows = requests.select(key, "request").join(held.select(key, "state"), key, "left")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches):
        for b in batches:
            states_of, asked = b.column(2).to_pylist(), b.column(1).to_pylist()
            answers = [app.query(app.genesis() if s is None else app.restore(s), r) for s, r in zip(states_of, asked, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(answers, pa.string())], names=[key, "request", "answer"])

    return rows.mapInArrow(run, f"{key} {kinds[key]}, request string, answer string")
