"""Small fixtures with known results, and folds against plain Python."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import history, integrity, ledger, log, messages, outbox, quorum, sessions, snapshots
from ledgerflow.operators.ordered import prefix
from ledgerflow.schema import AMOUNT_MAX

OPS = "user_id string, index long, kind string, amount decimal(20,0)"


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_order_rejection_and_poison(spark):
    ops = spark.createDataFrame([("A", 0, "deposit", 100), ("A", 1, "withdraw", 1000), ("A", 2, "withdraw", 50), ("A", 4, "deposit", 10)], "user_id string, index long, kind string, amount long")
    poison = spark.createDataFrame([(3,)], "index long")
    applied = ledger.outcomes(ledger.before_poison(ops, poison))
    assert [(r["index"], r.accepted, r.balance) for r in applied.orderBy("index").collect()] == [(0, True, 100), (1, False, 100), (2, True, 50)]
    assert ledger.halted_at(poison) == 3
    assert got(ledger.balances(applied)) == [("A", 50, 2, 1)]


def test_zero_withdrawal_saturation_and_lookup(spark):
    from decimal import Decimal

    ops = spark.createDataFrame([("A", 0, "withdraw", Decimal(0)), ("B", 1, "withdraw", Decimal(1)), ("C", 2, "deposit", Decimal(AMOUNT_MAX)), ("C", 3, "deposit", Decimal(5))], OPS)
    accounts = ledger.balances(ledger.outcomes(ops))
    assert got(accounts.select("user_id", "balance")) == [("A", 0), ("C", AMOUNT_MAX)]
    users = spark.createDataFrame([("B",), ("C",)], "user_id string")
    assert got(ledger.lookup(accounts, users)) == [("B", 0), ("C", AMOUNT_MAX)]


def test_fold_against_python(spark):
    rng = random.Random(4)
    rows = [(f"u{min(rng.randrange(8), 3)}", i, rng.choice(["deposit", "withdraw"]), rng.randrange(50)) for i in range(3000)]
    state, expected = {}, []
    for user, i, kind, amount in rows:
        balance = state.get(user, 0)
        fits = kind == "deposit" or amount <= balance
        state[user] = balance + (amount if kind == "deposit" else -amount) * fits
        expected.append((user, i, kind, amount, fits, state[user]))
    ops = spark.createDataFrame(rows, "user_id string, index long, kind string, amount long").repartition(7)
    assert got(ledger.outcomes(ops)) == sorted(expected, key=repr)
    for at, kept in ((1999, 1000), (0, -1), (2999, 2999)):
        snapshot = snapshots.state_at(ops, kept) if kept >= 0 else None
        assert got(snapshots.state_at(ops, at, snapshot, kept)) == got(snapshots.state_at(ops, at))


def test_empty_tables(spark):
    ops = spark.createDataFrame([], "user_id string, index long, kind string, amount long")
    assert got(ledger.balances(ledger.outcomes(ops))) == []
    acks = spark.createDataFrame([], "index long, node_id int")
    assert quorum.committable(acks, 2) is None
    assert got(quorum.committed_prefix(acks, [1])) == [(1, 0, None)]
    assert got(sessions.fair_order(spark.createDataFrame([], "arrival long, client_id long"))) == []


def test_prefix_against_python(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.randrange(-5, 9)) for g in (1, 2) for i in rng.sample(range(1000), 200)]
    df = prefix(spark.createDataFrame(rows, "g long, i long, v long"), "i", F.col("v"), "s", width=37, by=("g",))
    for g, i, v, s in got(df.select("g", "i", "v", "s")):
        assert s == sum(x for a, j, x in rows if a == g and j <= i)
    df = prefix(spark.createDataFrame(rows, "g long, i long, v long"), "i", F.col("v"), "s", "max", False, 50, ("g",))
    for g, i, _, s in got(df.select("g", "i", "v", "s")):
        assert s == max((x for a, j, x in rows if a == g and j < i), default=None)


def test_log_reads(spark):
    entries = spark.createDataFrame([(i, bytes([i])) for i in range(6)], "index long, payload binary")
    assert log.range_scan(entries, 0, 100, 2).count() == 3
    assert log.range_scan(entries, 0, 100, None).count() == 0
    assert log.range_scan(entries, 3, 100, 2, uncommitted=True).count() == 3
    with pytest.raises(IndexError):
        log.range_scan(entries, 0, 5, 5, base=2)
    assert log.length(entries, None) == 0 and log.length(entries, 0) == 1
    one, more = log.page(entries, 0, 5, 4)
    assert one.count() == 4 and more
    assert log.compact(entries, 9).count() == 0


def test_append(spark):
    entries = spark.createDataFrame([(0, 1, 0, 5, 0, 1, b"x")], "index long, view_id long, stream_id long, timestamp_ns long, flags int, schema_version int, payload binary")
    batch = spark.createDataFrame([(7, 0, b"b", 2), (7, 0, b"a", 1)], "stream_id long, flags int, payload binary, turn int")
    assert [(r["index"], bytes(r.payload)) for r in log.append(entries, batch, "turn", 9, 2).orderBy("index").collect()] == [(0, b"x"), (1, b"a"), (2, b"b")]
    with pytest.raises(Exception, match="empty or too large"):
        log.append(entries, batch.withColumn("payload", F.lit(b"")), "turn", 9, 2).collect()


def test_recovery_outcomes(spark):
    def outcome(failures):
        rows = [("s", i, i, f) for i, f in enumerate(failures)]
        return got(integrity.recovery_outcome(spark.createDataFrame(rows, "s string, index long, position long, failure string"), "s"))[0][4:]

    assert outcome([None] * 5) == (4, "Clean")
    assert outcome([None] * 5 + ["bad_header_checksum"]) == (4, "Truncated")
    assert outcome([None] * 5 + ["bad_header_checksum"] + [None] * 4) == (4, "MidLogCorruption")
    assert outcome([None] * 3 + ["chain_break", None]) == (2, "BrokenChain")
    assert outcome([None] * 5 + ["zero_header", None]) == (4, "ZeroHole")
    assert outcome([None] * 4 + ["bad_payload_hash"]) == (3, "Truncated")
    assert outcome(["zero_header"]) == (None, "CleanEmpty")


def test_quorum(spark):
    votes = spark.createDataFrame([(0, 0), (1, 0), (2, 0)], "index long, node_id int")
    add = lambda df, i: df.union(spark.createDataFrame([(i, 1)], "index long, node_id int"))
    votes = add(votes, 2)
    assert quorum.committable(votes, 2) is None
    votes = add(votes, 0)
    assert quorum.committable(votes, 2) == 0
    votes = add(votes, 1)
    assert quorum.committable(votes, 2) == 2 and quorum.committable(votes, 2, 2) == 2
    assert quorum.quorum_size(3) == 2 and quorum.quorum_size(1) == 1
    with pytest.raises(ValueError):
        quorum.quorum_size(65)


def test_sessions(spark):
    rows = spark.createDataFrame([(0, 1, 1), (1, 1, 1), (2, 1, 2), (3, 1, 0), (4, 2, 0), (5, 2, 0), (6, 2, 5), (7, 2, 0)], "arrival long, client_id long, sequence_number long")
    classes = [r["class"] for r in sessions.classify(rows).orderBy("arrival").collect()]
    assert classes == ["new", "duplicate", "new", "stale", "new", "new", "new", "stale"]


def test_fair_share(spark):
    rows = spark.createDataFrame([(i, 1 if i < 100 else 2) for i in range(110)], "arrival long, client_id long")
    slots = [r.client_id for r in sessions.fair_order(rows).orderBy("slot").collect()]
    assert slots == [1, 2] * 10 + [1] * 90


def test_burst_is_limited(spark):
    rows = spark.createDataFrame([(i, i, 1) for i in range(500)], "arrival long, client_id long, sequence_number long")
    out = sessions.admit(rows, F.lit(True), F.when(F.col("arrival") < 50, 1).otherwise(0), F.lit(0), max_inflight=50)
    assert got(out.groupBy("decision").count()) == [("accepted", 50), ("overloaded", 450)]


def test_batches(spark):
    rows = spark.createDataFrame([(i, "k", t, n) for i, (t, n) in enumerate([(0, 40), (1, 40), (2, 10), (9, 10), (10, 100)])], "i long, key string, t long, n long")
    out = got(sessions.batches(rows, "key", "t", "n", "i", max_bytes=80, max_delay=5).select("i", "batch", "batch_bytes"))
    assert out == [(0, 0, 40), (1, 0, 80), (2, 1, 10), (3, 2, 10), (4, 2, 110)]


def test_fences(spark):
    views = spark.createDataFrame([(0, 10), (1, 11), (2, 9)], "t long, view long")
    assert [r.accepted for r in quorum.view_fence(views, "t", "view").orderBy("t").collect()] == [True, True, False]
    ballots = spark.createDataFrame([(0, 10, 1, 0), (0, 10, 1, 1), (0, 10, 2, 2), (0, 11, 2, 3)], "voter int, view int, candidate int, time int")
    assert [r.accepted for r in quorum.vote_fence(ballots).orderBy("time").collect()] == [True, True, False, True]
    leases = spark.createDataFrame([(0, 0), (1, 1), (2, 0), (3, 1)], "t long, token long")
    assert [r.valid for r in outbox.leases(leases, "t", "token").orderBy("t").collect()] == [True, True, False, True]


def test_outbox(spark):
    effects = spark.createDataFrame([("a", 0), ("b", 1), ("c", 5), ("a", 9)], "id string, index long")
    acks = spark.createDataFrame([("a", 3), ("b", 4), ("b", 6), ("c", 2), ("x", 1)], "id string, index long")
    box = outbox.status(effects, acks, ["id"])
    assert got(box) == [("a", 9, None, "Pending"), ("b", 1, 4, "Acknowledged"), ("c", 5, None, "Pending")]
    assert [r.id for r in outbox.next_cycle(box, ["id"]).collect()] == ["c", "a"]
    assert got(outbox.compacted(box, 2).select("id")) == [("a",), ("c",)]
    assert got(outbox.counts(box)) == [(3, 2)]
    flights = spark.createDataFrame([("a", 0), ("b", 20_000)], "id string, started_ms long")
    assert got(outbox.timed_out(flights, 40_000).select("id")) == [("a",)]


def test_snapshots(spark):
    assert [snapshots.due(a, s, 5) for a, s in ((4, None), (8, 4), (9, 4), (None, None))] == [True, False, True, False]
    kept = spark.createDataFrame([(2, True), (5, False)], "last_included_index long, valid boolean")
    assert [r.last_included_index for r in snapshots.latest_valid(kept).collect()] == [2]
    assert snapshots.latest_valid(kept, 1).count() == 0
    targets = spark.createDataFrame([(1,), (2,), (9,)], "target long")
    assert got(snapshots.as_of(targets, kept)) == [(1, None, 0, 2), (2, 2, 3, 0), (9, 2, 3, 7)]
    entries = spark.createDataFrame([(3, b"h"), (4, b"i")], "index long, prev_hash binary")
    at = lambda i, h=b"h": {"last_included_index": i, "chain_hash": h}
    assert snapshots.bridge(entries, at(2), 4) == "ok"
    assert snapshots.bridge(entries, at(2, b"x"), 4) == "ChainBridgeMismatch"
    assert snapshots.bridge(entries, at(10), 4) == "LogBehindSnapshot"
    assert snapshots.bridge(entries, at(1), 4) == "LogGap"
    assert snapshots.bridge(entries, at(4), 4) == "ok" and snapshots.bridge(entries, None, None) == "ok"
    assert got(snapshots.superseded(kept).select("last_included_index")) == [(2,)]


def test_history(spark):
    schema = "idx long, client_id long, sequence_number long, user_id string, op string, amount long, result string, balance long"
    rows = spark.createDataFrame([(0, 1, 1, "A", "deposit", 100, "Success", None), (1, 1, 2, "A", "deposit", 50, "Success", 150), (2, 1, 3, "A", "withdraw", 30, "Success", 120), (3, 1, 1, "A", "deposit", 0, "Success", 110), (4, 1, 4, "A", "withdraw", 9, "Failure", 105)], schema)
    assert got(history.stats(rows)) == [(5, 4, 1, 0, 150, 30)]
    assert history.conserved(rows, 120) and not history.conserved(rows, 50)
    assert got(history.duplicate_executions(rows).select("client_id", "sequence_number", "idx", "first_idx")) == [(1, 1, 3, 0)]
    # 150 to 120 is explained by the withdrawal; 120 to 110 too, as both ends of the interval count; 110 to 105 isn't
    assert got(history.time_travel(rows)) == [("A", 3, 4, 110, 105)]


def test_in_order(spark):
    rows = spark.createDataFrame([(0, 0), (1, 2), (2, 1), (3, 1), (4, 9)], "arrival long, index long")
    assert [r["class"] for r in quorum.admit_in_order(rows).orderBy("arrival").collect()] == ["appended", "appended", "appended", "duplicate", "early"]


def test_manifest(spark):
    one = spark.createDataFrame([(3, None, None, 7, 3)], "highest_view long, voted_for_view long, voted_for_node int, last_log_index long, last_log_view long")
    verdict = lambda view, index: integrity.manifest_check(one, view, index).first()["verdict"]
    assert (verdict(4, 7), verdict(3, 5), verdict(3, 6), verdict(None, 7)) == ("behind_log", "ahead_of_log", "ok", "ok")


def test_messages(spark):
    rows = spark.createDataFrame([(0, None), (1, 0), (2, 9), (3, 4)], "t long, c long")
    assert [r.committed for r in messages.commits(rows, "t", "c", 6).orderBy("t").collect()] == [None, 0, 6, 6]
    assert [r.committed for r in messages.commits(rows, "t", "c", None).collect()] == [None] * 4
    views = spark.createDataFrame([(0, 2), (1, 5), (2, 5), (3, 4), (4, 6)], "t long, v long")
    assert [r.adopted for r in messages.start_views(views, "t", "v", 3).orderBy("t").collect()] == [False, True, False, False, True]
    one = lambda *x: spark.createDataFrame([(i,) for i in x], "index long")
    assert got(messages.fill_gaps(one(0, 1, 4), one(1, 2, 3, 7))) == [(0, "received"), (1, "received"), (2, "caught_up"), (3, "caught_up"), (4, "received")]
    assert got(messages.wanted(one(0, 1, 5), 0, 6, 3)) == [(2, 2), (3, 4), (6, 6)]


def test_amounts_are_unsigned_64_bit(spark):
    top = (1 << 64) - 1
    rows = [("a", 0, "deposit", 5), ("a", 1, "deposit", top), ("a", 2, "withdraw", top), ("a", 3, "withdraw", 1)]
    done = ledger.outcomes(spark.createDataFrame([(u, i, k, Decimal(n)) for u, i, k, n in rows], "user_id string, index long, kind string, amount decimal(20,0)"))
    assert [(r["index"], r.accepted, int(r.balance)) for r in done.orderBy("index").collect()] == [(0, True, 5), (1, True, top), (2, True, 0), (3, False, 0)]
    longs = spark.createDataFrame([("a", i, "deposit", 1 << 62) for i in range(5)], "user_id string, index long, kind string, amount long")
    assert [int(r.balance) for r in ledger.outcomes(longs).orderBy("index").collect()] == [1 << 62, 2 << 62, 3 << 62, top, top]
    opening = spark.createDataFrame([("a", Decimal(top))], "user_id string, balance decimal(20,0)")
    assert [int(r.balance) for r in ledger.balances(ledger.outcomes(longs.limit(0), opening)).collect()] == [top]
