"""Schemas of the tables that the operators read and write."""

from __future__ import annotations

from pyspark.sql import types as T

#: Amounts are unsigned 64-bit numbers: no Spark integer holds them.
AMOUNT = T.DecimalType(20, 0)
AMOUNT_MAX = (1 << 64) - 1


def _struct(text: str) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in ((p.split()[0], _TYPES[p.split()[1]]) for p in text.split(", "))])


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "binary": T.BinaryType(), "boolean": T.BooleanType(), "amount": AMOUNT, "timestamp": T.TimestampType()}

LOG = _struct("index long, view_id long, stream_id long, prev_hash binary, payload_hash binary, timestamp_ns long, flags int, schema_version int, payload binary")
LEDGER_EVENT = _struct("index long, kind string, user string, amount amount, to string, subject string, client_id long, sequence_number long, effect_id binary")
BALANCES = _struct("user string, balance amount")
REQUESTS = _struct("arrival long, client_id long, sequence_number long, payload binary")
ACKS = _struct("index long, node_id int")
VIEW_CHANGE = _struct("view long, node_id int, commit_index long, last_log_index long, last_log_hash binary")
MESSAGES = _struct("ts timestamp, from_node int, to_node int, kind string, view long, index long, commit_index long")
HISTORY = _struct("idx long, client_id long, sequence_number long, op string, user string, amount amount, result string, balance amount, log_index long")
MANIFEST = _struct("highest_view long, voted_for_view long, voted_for_node int, last_log_index long, last_log_view long")
SNAPSHOTS = _struct("last_included_index long, last_included_term long, chain_hash binary, schema_version int, valid boolean")
