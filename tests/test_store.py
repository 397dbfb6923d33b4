"""Snapshots, recovery, manifests, and applications of one's own."""

from __future__ import annotations

import shutil

import pytest

from ledgerflow.operators import application, ledger, snapshots
from ledgerflow.sources import store

OPS = "user_id string, index long, kind string, amount long"


def setup(spark, folder, marks=(2, 5)):
    ops = spark.createDataFrame([("A", i, "deposit", 100) for i in range(10)], OPS)
    log = spark.createDataFrame([(i, bytes([i])) for i in range(10)], "index long, prev_hash binary")
    none = spark.createDataFrame([], "effect_id string")
    for at in marks:
        store.write_snapshot(folder, at, snapshots.state_at(ops, at), none, none, bytes([at + 1]), 1)
    return ops, log


def test_recovery_uses_the_latest_valid_snapshot(spark, tmp_path):
    folder = str(tmp_path)
    ops, log = setup(spark, folder)
    verdict, at, state = store.recover(spark, folder, ops, log, 9)
    assert (verdict, at, [tuple(r) for r in state.collect()]) == ("ok", 5, [("A", 1000)])
    shutil.rmtree(f"{folder}/last_included_index=5/balances")
    verdict, at, state = store.recover(spark, folder, ops, log, 9)
    assert (verdict, at, [tuple(r) for r in state.collect()]) == ("ok", 2, [("A", 1000)])
    assert store.recover(spark, folder, ops, log, 1)[0] == "LogBehindSnapshot"
    assert store.recover(spark, folder, ops, log.where("index > 4"), 9)[0] == "LogGap"


def test_mismatched_chain(spark, tmp_path):
    ops, log = setup(spark, str(tmp_path), (2,))
    store.write_snapshot(str(tmp_path), 2, snapshots.state_at(ops, 2), ops.limit(0), ops.limit(0), b"wrong", 1)
    assert store.recover(spark, str(tmp_path), ops, log, 9)[0] == "ChainBridgeMismatch"


def test_manifest(spark, tmp_path):
    store.write_manifest(spark, str(tmp_path / "m"), highest_view=3, last_log_index=7, last_log_view=2)
    assert tuple(store.read_manifest(spark, str(tmp_path / "m")).first()) == (3, None, None, 7, 2)


def counter():
    """Made in a function, so that workers get the class itself and needn't import this module."""

    class Counter:
        """Counts to a limit; tells when it is even."""

        def genesis(self):
            return 0

        def apply(self, state, payload, context):
            if payload == "poison":
                raise ValueError("poison")
            if state + int(payload) > 10:
                raise application.Rejected("too much")
            state += int(payload)
            return state, [f"even {context.index}"] if state % 2 == 0 else []

        def snapshot(self, state):
            return str(state)

        def restore(self, text):
            return int(text)

    return Counter()


def events(spark, rows):
    return spark.createDataFrame([(k, i, 0, i * 10, b"h", p) for k, i, p in rows], "k string, index long, view_id long, timestamp_ns long, prev_hash binary, payload string")


def test_application(spark):
    rows = [("a", 0, "3"), ("b", 1, "9"), ("a", 2, "5"), ("b", 3, "4"), ("a", 4, "1"), ("b", 5, "1")]
    done = application.run(counter(), events(spark, rows), "k")
    got = sorted((r["index"], r.status, tuple(r.effects), r.state) for r in done.collect())
    assert got == [(0, "Applied", (), "3"), (1, "Applied", (), "9"), (2, "Applied", ("even 2",), "8"), (3, "Rejected", ("too much",), "9"), (4, "Applied", (), "9"), (5, "Applied", ("even 5",), "10")]
    early = application.states(application.run(counter(), events(spark, rows[:3]), "k"), "k")
    again = application.states(application.run(counter(), events(spark, rows), "k", early), "k")
    assert sorted(tuple(r) for r in again.collect()) == sorted(tuple(r) for r in application.states(done, "k").collect())
    with pytest.raises(Exception, match="poison"):
        application.run(counter(), events(spark, [*rows, ("a", 6, "poison")]), "k").collect()
    assert application.seed(b"x", 1) == application.seed(b"x", 1) != application.seed(b"x", 2)


def test_state_equals_replay_from_genesis(spark):
    ops = spark.createDataFrame([("A", 0, "deposit", 5), ("A", 1, "withdraw", 9), ("B", 2, "deposit", 7), ("A", 3, "withdraw", 5)], OPS)
    whole = sorted(tuple(r) for r in ledger.balances(ledger.outcomes(ops)).select("user_id", "balance").collect())
    for kept in range(4):
        assert sorted(tuple(r) for r in snapshots.state_at(ops, 3, snapshots.state_at(ops, kept), kept).collect()) == whole


def test_damaged_snapshots_are_passed_over(spark, tmp_path):
    folder = str(tmp_path)
    ops, log = setup(spark, folder, (2, 5, 7))
    spark.createDataFrame([("x",)], "effect_id string").write.mode("append").parquet(f"{folder}/last_included_index=7/outbox")
    assert store.recover(spark, folder, ops, log, 9)[:2] == ("ok", 5)
    none = spark.createDataFrame([], "effect_id string")
    store.write_snapshot(folder, 8, snapshots.state_at(ops, 8), none, none, bytes([9]), 1, version=99)
    assert store.recover(spark, folder, ops, log, 9)[:2] == ("ok", 5)


def test_manifest_updates(spark, tmp_path):
    at = str(tmp_path / "m")
    store.write_manifest(spark, at, highest_view=3, last_log_index=7, last_log_view=2)
    store.record_vote(spark, at, 4, 1)
    store.record_vote(spark, at, 4, 1)
    with pytest.raises(ValueError, match="no vote"):
        store.record_vote(spark, at, 4, 2)
    with pytest.raises(ValueError, match="no vote"):
        store.record_vote(spark, at, 3, 1)
    assert tuple(store.read_manifest(spark, at).first()) == (4, 4, 1, 7, 2)
    store.advance_view(spark, at, 6)
    assert tuple(store.read_manifest(spark, at).first()) == (6, None, None, 7, 2)
    with pytest.raises(ValueError, match="isn't above"):
        store.advance_view(spark, at, 6)
    assert store.recover_manifest(spark, at, 6, 7)["highest_view"] == 6
    with pytest.raises(RuntimeError, match="manifest"):
        store.recover_manifest(spark, at, 7, 7)
    rows = spark.read.parquet(at).withColumn("highest_view", rows_plus()).collect()
    spark.createDataFrame(rows, spark.read.parquet(at).schema).write.mode("overwrite").parquet(at + "2")
    with pytest.raises(Exception, match="checksum"):
        store.read_manifest(spark, at + "2").collect()


def rows_plus():
    from pyspark.sql import functions as F

    return F.col("highest_view") + 1
