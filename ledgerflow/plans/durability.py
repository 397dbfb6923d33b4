"""Further queries over the test tables: amounts at their bound, streams, snapshots on disk, manifests, delivery, applications. Each has DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.functions import scalar
from ledgerflow.operators import application, history, ledger, log, outbox, quorum, sessions, snapshots
from ledgerflow.plans import mapping
from ledgerflow.plans.catalogue import BALANCES, EFFECTS, FOLD, HISTORY, OPS, VOTES, outbox_status, query
from ledgerflow.plans.mapping import table
from ledgerflow.schema import AMOUNT
from ledgerflow.sources import store
from ledgerflow.streaming import ledger as stream

#: What turns the tables' cents into amounts that reach the largest unsigned 64-bit number within a few deposits.
SCALE = 10**14
BIG_OPS = OPS.format("").replace("round(value * 100)::BIGINT", f"(round(value * 100)::BIGINT)::HUGEINT * {SCALE}")
BIG_FOLD = FOLD.replace("f.balance + o.amount", "least(f.balance + o.amount, 18446744073709551615::HUGEINT)")


@query(f"WITH RECURSIVE {BIG_OPS}, {BIG_FOLD} SELECT user_id, idx AS index, amount::VARCHAR AS amount, accepted, balance::VARCHAR AS balance FROM fold")
def ledger_saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = (F.col("amount").cast(AMOUNT) * F.lit(SCALE).cast("decimal(15,0)")).cast(AMOUNT)
    rows = ledger.outcomes(mapping.operations(spark, sf_dir).withColumn("amount", amount))
    return rows.select("user_id", "index", F.col("amount").cast("string").alias("amount"), "accepted", F.col("balance").cast("string").alias("balance"))


@query("""WITH a AS (SELECT l_orderkey % 4 AS log, l_orderkey // 4 AS index, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS turn FROM lineitem),
f AS (SELECT DISTINCT log, index FROM a), c AS (SELECT DISTINCT log, 0 AS i FROM a UNION SELECT log, index + 1 FROM f),
g AS (SELECT log, min(i) AS gap FROM c WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.log = c.log AND f.index = c.i) GROUP BY log)
SELECT log, index, 'duplicate' AS class FROM a WHERE turn > 1 UNION ALL SELECT log, index, 'appended' FROM f JOIN g USING (log) WHERE index < gap""")
def stream_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{sf_dir}/lineitem.parquet"
    rows = stream.files(spark, at, spark.read.parquet(at).schema)
    key = F.col("l_orderkey")
    rows = rows.select((key % 4).alias("log"), (key * 16 + F.col("l_linenumber")).alias("arrival"), mapping.div(key, 4).alias("index"))
    out = stream.shared_folder(spark, "admission")
    stream.drain(stream.admission(rows), lambda batch, k: batch.write.mode("overwrite").parquet(f"{out}/batch={k}"), "append")
    return spark.read.schema("log long, index long, class string").parquet(f"{out}/*")


LATE_POISON = "(SELECT min(event_id) FROM events WHERE event_type = 'error' AND event_id % 1000 = 613 OR event_id = (SELECT max(event_id) * 4 // 5 FROM events))"


@query(f"WITH RECURSIVE {OPS.format(f' AND event_id < {LATE_POISON}')}, {FOLD} {BALANCES}")
def stream_poison_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, last = F.col("event_id"), mapping.last_index(spark, sf_dir)
    poison = ((F.col("event_type") == "error") & (i % 1000 == 613)) | (i == last * 4 // 5)
    return mapping.plain(stream.balances_until_poison(spark, f"{sf_dir}/events.parquet", poison))


@query(f"WITH RECURSIVE {OPS.format(' AND event_id <= (SELECT max(event_id) - 100 FROM events)')}, {FOLD}, b AS ({BALANCES}) SELECT user_id, balance, 'ok' AS verdict, (SELECT max(event_id) // 4 FROM events) AS snapshot_index FROM b")
def snapshot_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots at a quarter and a half of the log; the second is damaged after it was written, so recovery goes back to the first."""
    ops, last = mapping.operations(spark, sf_dir), mapping.last_index(spark, sf_dir)
    entries = mapping.log(spark, sf_dir).select("index", F.unhex(F.sha2((F.col("index") - 1).cast("string"), 256)).alias("prev_hash"))
    folder, effects, requests = stream.shared_folder(spark, "snapshots"), outbox_status(spark, sf_dir), mapping.requests(spark, sf_dir)
    for at in (last // 4, last // 2):
        chain = entries.where(F.col("index") == at + 1).first()["prev_hash"]
        store.write_snapshot(folder, at, snapshots.state_at(ops, at), effects.where(F.col("created_at") <= at), sessions.next_sequence(requests.where(F.col("arrival") <= at)), bytes(chain), 1)
    spark.range(1).write.mode("append").parquet(f"{folder}/last_included_index={last // 2}/balances")
    verdict, at, state = store.recover(spark, folder, ops, entries, last - 100)
    return mapping.plain(state).withColumn("verdict", F.lit(verdict)).withColumn("snapshot_index", F.lit(at).cast("long"))


@query("""WITH m AS (SELECT max(event_id) - 250 AS c FROM events), s AS (SELECT event_id AS i FROM events WHERE event_id % 50 = 49)
SELECT i AS last_included_index, CASE WHEN i > c THEN 'LogBehindSnapshot' WHEN i = c THEN 'ok' WHEN (i + 1) % 700 = 0 THEN 'LogGap' WHEN i % 150 = 149 THEN 'ChainBridgeMismatch' ELSE 'ok' END AS verdict FROM s, m""")
def bridge_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("index")
    digest = lambda n: F.sha2(n.cast("string"), 256)
    entries = mapping.log(spark, sf_dir).select("index").where(i % 700 != 0).withColumn("prev_hash", digest(i - 1))
    taken = mapping.log(spark, sf_dir).where(i % 50 == 49).select(i.alias("last_included_index"), F.when(i % 150 == 149, "forged").otherwise(digest(i)).alias("chain_hash"))
    return snapshots.bridges(entries, taken, mapping.last_index(spark, sf_dir) - 250).select("last_included_index", "verdict")


@query("""WITH s AS (SELECT event_id AS i FROM events WHERE event_id % 700 = 699), t AS (SELECT event_id AS target FROM events WHERE event_id % 53 = 0),
p AS (SELECT target, (SELECT max(i) FROM s WHERE i <= target) AS snapshot_index FROM t) SELECT target, snapshot_index, target - coalesce(snapshot_index, -1) >= 500 AS due FROM p""")
def snapshot_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, e = F.col("event_id"), table(spark, sf_dir, "events")
    taken = e.where(i % 700 == 699).select(i.alias("last_included_index"), F.lit(True).alias("valid"))
    return snapshots.due_since(snapshots.as_of(e.where(i % 53 == 0).select(i.alias("target")), taken), 500).select("target", "snapshot_index", "due")


@query("SELECT event_id AS last_included_index FROM events WHERE event_id % 300 = 299 AND event_id < (SELECT max(event_id) FROM events WHERE event_id % 300 = 299)")
def snapshot_superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return snapshots.superseded(table(spark, sf_dir, "events").where(i % 300 == 299).select(i.alias("last_included_index")))


@query("SELECT max(event_id) AS last_included_index, true AS valid FROM events WHERE event_id % 300 = 299 AND event_id % 900 <> 899 AND event_id <= (SELECT max(event_id) // 2 FROM events)")
def snapshot_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    taken = table(spark, sf_dir, "events").where(i % 300 == 299).select(i.alias("last_included_index"), (i % 900 != 899).alias("valid"))
    return snapshots.latest_valid(taken, mapping.last_index(spark, sf_dir) // 2)


@query(f"WITH {EFFECTS}, p AS (SELECT *, row_number() OVER (ORDER BY created_at) - 1 AS n FROM outbox WHERE status = 'Pending') SELECT user_id, k, created_at, n // 100 AS cycle FROM p")
def outbox_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outbox.cycles(outbox_status(spark, sf_dir), "created_at").select("user_id", "k", "created_at", "cycle")


@query(f"WITH {EFFECTS} SELECT count(*) AS executed, count(*) FILTER (status = 'Acknowledged') AS acknowledged FROM outbox")
def effect_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outbox.counters(outbox_status(spark, sf_dir))


@query("""WITH f AS (SELECT event_id AS effect_id, epoch_us(ts) // 1000 AS started_ms FROM events WHERE event_type = 'error')
SELECT effect_id, started_ms FROM f WHERE (SELECT max(epoch_us(ts) // 1000) FROM events) - started_ms > 86400000""")
def effect_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mapping.log(spark, sf_dir).select("index", scalar.millis(F.col("timestamp_ns")).alias("started_ms"))
    now = rows.agg(F.max("started_ms")).first()[0]
    errors = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("event_id").alias("index"))
    return outbox.timed_out(rows.join(errors, "index").withColumnRenamed("index", "effect_id"), now, 86_400_000)


@query(f"WITH {EFFECTS} SELECT user_id || '/' || k AS effect_id FROM outbox WHERE status = 'Pending'")
def outbox_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything pending, in cycles of 1,000 under a valid lease; an executor stands in that runs what it is given."""
    rows = outbox.pending(outbox_status(spark, sf_dir)).withColumn("effect_id", F.concat_ws("/", "user_id", "k"))
    return stream.deliver_all(rows, stream.shared_folder(spark, "delivered"), lambda effects: effects, ["created_at"], 1_000)


@query("""WITH b AS (SELECT c_nationkey::BIGINT AS voter, c_custkey % 10 AS view, c_custkey % 5 AS candidate, c_custkey AS t FROM customer), h AS (SELECT voter, max(view) AS highest_view FROM b GROUP BY voter)
SELECT h.voter, highest_view, arg_min(candidate, t) AS voted_for FROM h JOIN b ON b.voter = h.voter AND b.view = highest_view GROUP BY ALL""")
def manifest_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quorum.manifests(mapping.ballots(spark, sf_dir))


@query(f"WITH RECURSIVE {OPS.format('')}, {FOLD}, b AS ({BALANCES}), t AS (SELECT (sum(amount) FILTER (accepted AND kind = 'deposit'))::BIGINT AS deposits, (sum(amount) FILTER (accepted AND kind = 'withdraw'))::BIGINT AS withdrawals FROM fold) SELECT deposits, withdrawals, (SELECT sum(balance)::BIGINT FROM b) AS final_total, deposits - withdrawals = (SELECT sum(balance) FROM b) AS conserved FROM t")
def history_conserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = ledger.outcomes(mapping.operations(spark, sf_dir))
    records = mapping.history(done).where("idx < 1000000000")  # without the records that the mapping repeats
    return history.conservation(records, mapping.plain(ledger.balances(done)))


@query(f"WITH RECURSIVE {OPS.format('')}, {FOLD}, {HISTORY} SELECT user_id AS client_id, seq AS sequence_number, max(idx) AS idx, arg_max(op, idx) AS op, arg_max(result, idx) AS result FROM history GROUP BY ALL")
def history_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.lookup(mapping.history(ledger.outcomes(mapping.operations(spark, sf_dir))))


@query("""WITH s AS (SELECT s_nationkey::BIGINT AS cluster, max((floor(s_acctbal) % 97)::BIGINT) AS appended, max(CASE WHEN s_suppkey % 3 = 0 THEN (floor(s_acctbal) % 89)::BIGINT END) AS committed FROM supplier GROUP BY 1)
SELECT *, greatest(0, coalesce(appended, 0) - coalesce(committed, 0)) AS gap FROM s""")
def replication_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    floor = F.floor("s_acctbal")
    return quorum.replication_gaps(table(spark, sf_dir, "supplier"), F.col("s_nationkey").cast("long"), (floor % 97).cast("long"), F.when(F.col("s_suppkey") % 3 == 0, (floor % 89).cast("long")))


@query("""WITH a AS (SELECT l_orderkey AS index, l_suppkey % 5 AS node FROM lineitem UNION SELECT o_orderkey, 7 FROM orders) SELECT index, count(*) AS votes, count(*) >= 3 AS has_quorum FROM a GROUP BY index""")
def local_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("index"))
    return quorum.votes(quorum.with_local_votes(mapping.acks(spark, sf_dir), written, 7), 3)


@query(f"""WITH {VOTES}, g AS (SELECT min(range) AS gap FROM range((SELECT max(idx) + 2 FROM votes)) WHERE range NOT IN (SELECT idx FROM votes WHERE votes >= 1))
SELECT idx AS index, votes FROM votes, g WHERE idx >= gap""")
def votes_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    acks = mapping.acks(spark, sf_dir)
    return quorum.votes(quorum.uncommitted_votes(acks, quorum.committable(acks, 1)), 1).select("index", "votes")


@query("SELECT user_id AS client_id, event_id AS arrival, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence_number FROM events")
def sequence_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.numbered(mapping.requests(spark, sf_dir).select("client_id", "arrival"))


@query("SELECT event_id AS index, event_id % 7 = 0 AS overloaded FROM events")
def overload_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("System Overloaded: "), "props")).when(F.col("event_id") % 7 != 1, F.col("event_type"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("index"), scalar.is_overload(message).alias("overloaded"))


@query("SELECT max(event_id) - 249 AS entries, count(*) FILTER (event_id >= 120 AND event_id <= (SELECT max(event_id) - 250 FROM events)) AS readable FROM events")
def log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, committed = mapping.log(spark, sf_dir), mapping.last_index(spark, sf_dir) - 250
    kept = log.committed_rows(log.compact(rows, 120), committed)
    return kept.agg(F.lit(log.length(rows, committed)).cast("long").alias("entries"), F.count("*").alias("readable"))


@query("""SELECT event_id AS index, event_id // 1000 AS view_id, epoch_us(ts) * 1000 AS timestamp_ns, props AS payload FROM events
UNION ALL SELECT (SELECT max(event_id) FROM events) + row_number() OVER (ORDER BY o_orderkey), 9, 7000, o_orderpriority FROM orders WHERE o_orderkey % 3 = 0""")
def log_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 3 == 0)
    batch = o.select("o_orderkey", F.col("o_custkey").alias("stream_id"), F.lit(0).alias("flags"), F.col("o_orderpriority").alias("payload"))
    return log.append(mapping.log(spark, sf_dir), batch, "o_orderkey", 7_000, 9).select("index", "view_id", "timestamp_ns", "payload")


class Quota:
    """An application: amounts add up to a limit at most, what would pass it is rejected; every full thousand is an effect."""

    LIMIT = 40_000

    def genesis(self) -> int:
        return 0

    def apply(self, state: int, payload: str, context: application.Context) -> tuple[int, list[str]]:
        after = state + int(payload)
        if after > self.LIMIT:
            raise application.Rejected("over the limit")
        return after, [f"{after // 1000} at {context.index}"] if after // 1000 > state // 1000 else []

    def snapshot(self, state: int) -> str:
        return str(state)

    def restore(self, text: str) -> int:
        return int(text)

    def query(self, state: int, request: str) -> str:
        return str(self.LIMIT - state) if request == "room" else str(state)


QUOTA = """r AS (SELECT user_id, event_id AS idx, abs(round(value * 100))::BIGINT AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
q AS (SELECT user_id, rn, idx, CASE WHEN n > 40000 THEN 0 ELSE n END AS state, 0::BIGINT AS earlier, n > 40000 AS rejected FROM r WHERE rn = 1
    UNION ALL SELECT r.user_id, r.rn, r.idx, CASE WHEN q.state + n > 40000 THEN q.state ELSE q.state + n END, q.state, q.state + n > 40000 FROM q JOIN r ON r.user_id = q.user_id AND r.rn = q.rn + 1)"""


def _quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.abs(F.round(F.col("value") * 100)).cast("long").cast("string")
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("index"), F.lit(0).cast("long").alias("view_id"), F.lit(0).cast("long").alias("timestamp_ns"), F.lit(b"").alias("prev_hash"), cents.alias("payload"))
    return application.run(Quota(), e, "user_id")


@query(f"""WITH RECURSIVE {QUOTA} SELECT user_id, idx AS index, CASE WHEN rejected THEN 'Rejected' ELSE 'Applied' END AS status, state::VARCHAR AS state,
    CASE WHEN rejected THEN 'over the limit' WHEN state // 1000 > earlier // 1000 THEN (state // 1000) || ' at ' || idx ELSE '' END AS effects FROM q""")
def application_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quota(spark, sf_dir).select("user_id", "index", "status", "state", F.array_join("effects", ",").alias("effects"))


@query(f"WITH RECURSIVE {QUOTA}, s AS (SELECT user_id, arg_max(state, idx) FILTER (NOT rejected) AS state FROM q GROUP BY user_id) SELECT c_custkey AS user_id, (40000 - coalesce(state, 0))::VARCHAR AS room FROM customer LEFT JOIN s ON user_id = c_custkey")
def application_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("room").alias("request"))
    return application.ask(Quota(), application.states(_quota(spark, sf_dir), "user_id"), asked, "user_id").select("user_id", F.col("answer").alias("room"))
