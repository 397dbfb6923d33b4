"""The queries over the test tables, each with the DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerflow.functions import scalar
from ledgerflow.operators import history, integrity, ledger, log, messages, outbox, quorum, sessions, snapshots
from ledgerflow.plans import mapping
from ledgerflow.plans.mapping import table
from ledgerflow.streaming import ledger as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Common parts of the SQL.
OPS = """ops AS (SELECT user_id, event_id AS idx, CASE WHEN event_type = 'purchase' THEN 'withdraw' ELSE 'deposit' END AS kind, round(value * 100)::BIGINT AS amount,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events WHERE event_type IN ('signup', 'click', 'purchase'){0})"""
FOLD = """fold AS (SELECT user_id, rn, idx, kind, amount, kind = 'deposit' OR amount <= 0 AS accepted, CASE WHEN kind = 'deposit' THEN amount WHEN amount <= 0 THEN -amount ELSE 0 END AS balance FROM ops WHERE rn = 1
    UNION ALL SELECT o.user_id, o.rn, o.idx, o.kind, o.amount, o.kind = 'deposit' OR o.amount <= f.balance,
        CASE WHEN o.kind = 'deposit' THEN f.balance + o.amount WHEN o.amount <= f.balance THEN f.balance - o.amount ELSE f.balance END
    FROM fold f JOIN ops o ON o.user_id = f.user_id AND o.rn = f.rn + 1)"""
BALANCES = "SELECT user_id, arg_max(balance, idx) AS balance, count(*) FILTER (accepted) AS applied, count(*) FILTER (NOT accepted) AS rejected FROM fold GROUP BY user_id HAVING count(*) FILTER (accepted) > 0"
EFFECTS = """e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, event_id FROM events WHERE event_type = 'error'),
a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, event_id FROM events WHERE event_type = 'view'),
outbox AS (SELECT e.user_id, e.k, e.event_id AS created_at, CASE WHEN a.event_id > e.event_id THEN a.event_id END AS acked_at, CASE WHEN a.event_id > e.event_id THEN 'Acknowledged' ELSE 'Pending' END AS status
    FROM e LEFT JOIN a ON a.user_id = e.user_id AND a.k = e.k)"""
VOTES = "votes AS (SELECT l_orderkey AS idx, count(DISTINCT l_suppkey % 5) AS votes FROM lineitem GROUP BY 1)"
HISTORY = """one AS (SELECT user_id, idx, idx AS seq, kind AS op, amount, CASE WHEN accepted THEN 'Success' ELSE 'Failure' END AS result, CASE WHEN idx % 3 = 0 THEN balance - (CASE WHEN idx % 97 = 0 THEN 100000 ELSE 0 END) END AS balance FROM fold),
history AS (SELECT * FROM one UNION ALL SELECT user_id, idx + 1000000000, seq, op, amount, result, NULL FROM one WHERE idx % 101 = 0)"""


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT event_id AS index, event_id // 1000 AS view_id, user_id AS stream_id, epoch_us(ts) * 1000 AS timestamp_ns, (event_id % 8)::INTEGER AS flags, props AS payload FROM events WHERE event_id BETWEEN 100 AND least((SELECT max(event_id) FROM events), (SELECT max(event_id) FROM events) - 250)")
def log_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = mapping.last_index(spark, sf_dir)
    return log.range_scan(mapping.log(spark, sf_dir), 100, last, last - 250).drop("schema_version")


@query("WITH c AS (SELECT max(event_id) - 250 AS c FROM events) SELECT (event_id - 50) // 100 AS page, min(event_id) AS first_index, max(event_id) AS last_index, count(*) AS entries, max(event_id) < any_value(c) AS has_more FROM events, c WHERE event_id BETWEEN 50 AND c GROUP BY 1")
def log_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.pages(mapping.log(spark, sf_dir), 50, mapping.last_index(spark, sf_dir) - 250)


@query("WITH f AS (SELECT event_id AS index, length(props)::BIGINT AS payload_size, ((8 - length(props) % 8) % 8)::BIGINT AS padding FROM events) SELECT index, payload_size, padding, 80 + payload_size + padding AS frame_size, (64 + coalesce(sum(80 + payload_size + padding) OVER (ORDER BY index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS \"offset\" FROM f")
def log_frame_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.frames(mapping.log(spark, sf_dir), F.octet_length("payload"))


@query("SELECT event_id AS index, CASE WHEN event_id < 120 THEN 'truncated' WHEN event_id > (SELECT max(event_id) FROM events) - 250 THEN 'uncommitted' ELSE 'readable' END AS class FROM events")
def log_visibility_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    committed = mapping.last_index(spark, sf_dir) - 250
    return mapping.log(spark, sf_dir).select("index", log.read_class(F.col("index"), 120, committed).alias("class"))


@query("SELECT event_id AS index, event_id & 1 <> 0 AS tombstone, event_id & 2 <> 0 AS checkpoint, event_id & 4 <> 0 AS config_change FROM events")
def event_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.project_event(mapping.log(spark, sf_dir)).select("index", "tombstone", "checkpoint", "config_change")


@query("SELECT event_id AS index, epoch_us(ts) * 1000 AS nanos, epoch_us(ts) * 1000 // 1000000 AS millis, epoch_us(ts) * 1000 // 1000000000 AS seconds FROM events")
def block_time_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("timestamp_ns")
    return mapping.log(spark, sf_dir).select("index", t.alias("nanos"), scalar.millis(t).alias("millis"), scalar.seconds(t).alias("seconds"))


@query("""WITH RECURSIVE rows AS (SELECT user_id, event_id, props, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
chain AS (SELECT user_id, rn, event_id, props, sha256('') AS prev, sha256(sha256('') || props || event_id) AS own FROM rows WHERE rn = 1
    UNION ALL SELECT r.user_id, r.rn, r.event_id, r.props, c.own, sha256(c.own || r.props || r.event_id) FROM chain c JOIN rows r ON r.user_id = c.user_id AND r.rn = c.rn + 1),
hurt AS (SELECT user_id, rn, event_id, CASE WHEN event_id % 97 = 0 THEN props || 'x' ELSE props END AS props, CASE WHEN event_id % 89 = 0 THEN sha256('forged') ELSE prev END AS prev, own FROM chain),
seen AS (SELECT *, coalesce(lag(own) OVER (PARTITION BY user_id ORDER BY event_id), sha256('')) AS expected FROM hurt)
SELECT user_id AS stream_id, event_id AS index, CASE WHEN prev <> expected THEN 'broken_link' ELSE 'content_changed' END AS violation FROM seen WHERE prev <> expected OR own <> sha256(prev || props || event_id)""")
def chain_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    chained = integrity.build_chain(mapping.log(spark, sf_dir))
    hurt = chained.withColumn("payload", F.when(F.col("index") % 97 == 0, F.concat("payload", F.lit("x"))).otherwise(F.col("payload")))
    hurt = hurt.withColumn("prev_hash", F.when(F.col("index") % 89 == 0, F.sha2(F.lit("forged"), 256)).otherwise(F.col("prev_hash")))
    return integrity.chain_violations(hurt)


@query("SELECT r.range AS index FROM range((SELECT max(l_orderkey) + 1 FROM lineitem)) r WHERE r.range NOT IN (SELECT l_orderkey FROM lineitem)")
def index_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = mapping.acks(spark, sf_dir)
    return integrity.missing_indexes(present, 0, present.agg(F.max("index")).first()[0])


@query('WITH r AS (SELECT o_orderkey AS "time", o_custkey AS view, max(o_custkey) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest FROM orders) SELECT * FROM r WHERE view < highest')
def view_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("time"), F.col("o_custkey").alias("view"))
    return integrity.regressions(rows, "time", "view")


@query("""WITH c AS (SELECT user_id AS stream_id, event_id AS index, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p,
    CASE WHEN event_id % 211 = 5 THEN 'zero_header' WHEN event_id % 223 = 7 THEN 'bad_header_checksum' WHEN event_id % 239 = 19 THEN 'index_break' WHEN event_id % 227 = 11 THEN 'chain_break' WHEN event_id % 229 = 13 THEN 'view_regression' WHEN event_id % 233 = 17 THEN 'bad_payload_hash' END AS failure FROM events),
f AS (SELECT stream_id, count(*) AS entries, min(p) FILTER (failure IS NOT NULL) AS fp, max(p) FILTER (failure IS NULL) AS good FROM c GROUP BY 1),
s AS (SELECT f.*, (SELECT index FROM c WHERE c.stream_id = f.stream_id AND c.p = fp) AS failed_index, (SELECT failure FROM c WHERE c.stream_id = f.stream_id AND c.p = fp) AS failure, (SELECT max(index) FROM c WHERE c.stream_id = f.stream_id AND (fp IS NULL OR c.p < fp)) AS last_valid FROM f)
SELECT stream_id, entries, failed_index, failure, last_valid, CASE WHEN failure IS NULL THEN 'Clean' WHEN failure = 'index_break' THEN 'MonotonicityViolation' WHEN failure = 'chain_break' THEN 'BrokenChain' WHEN failure = 'view_regression' THEN 'ViewRegression'
    WHEN failure = 'zero_header' THEN CASE WHEN coalesce(good > fp, false) THEN 'ZeroHole' WHEN last_valid IS NULL THEN 'CleanEmpty' ELSE 'Clean' END WHEN coalesce(good > fp, false) THEN 'MidLogCorruption' ELSE 'Truncated' END AS outcome FROM s""")
def recovery_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("index")
    failure = F.when(i % 211 == 5, "zero_header").when(i % 223 == 7, "bad_header_checksum").when(i % 239 == 19, "index_break").when(i % 227 == 11, "chain_break").when(i % 229 == 13, "view_regression").when(i % 233 == 17, "bad_payload_hash")
    position = F.row_number().over(Window.partitionBy("stream_id").orderBy("index"))
    return integrity.recovery_outcome(mapping.log(spark, sf_dir).select("stream_id", "index", position.alias("position"), failure.alias("failure")), "stream_id")


@query(f"WITH RECURSIVE {OPS.format('')}, {FOLD} {BALANCES}")
def ledger_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.plain(ledger.balances(ledger.outcomes(mapping.operations(spark, sf_dir))))


@query(f"WITH RECURSIVE {OPS.format('')}, {FOLD} SELECT user_id, idx AS index, amount, balance FROM fold WHERE NOT accepted")
def ledger_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.plain(ledger.outcomes(mapping.operations(spark, sf_dir)).where("not accepted")).select("user_id", "index", "amount", "balance")


POISON = "(SELECT min(event_id) FROM events WHERE event_type = 'error' AND event_id >= 0.6 * (SELECT max(event_id) FROM events))"


@query(f"WITH RECURSIVE {OPS.format(f' AND event_id < {POISON}')}, {FOLD} {BALANCES}")
def ledger_poison_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = mapping.last_index(spark, sf_dir)
    poison = table(spark, sf_dir, "events").where((F.col("event_type") == "error") & (F.col("event_id") >= 0.6 * last)).select(F.col("event_id").alias("index"))
    return mapping.plain(ledger.balances(ledger.outcomes(ledger.before_poison(mapping.operations(spark, sf_dir), poison))))


@query(f"WITH RECURSIVE {OPS.format('')}, {FOLD}, b AS ({BALANCES}) SELECT c_custkey AS user_id, coalesce(balance, 0)::BIGINT AS balance FROM customer LEFT JOIN b ON user_id = c_custkey")
def balance_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return ledger.lookup(ledger_balances(spark, sf_dir), users)


@query(f"WITH RECURSIVE {OPS.format(' AND event_id <= (SELECT max(event_id) // 2 FROM events)')}, {FOLD}, b AS ({BALANCES}) SELECT user_id, balance FROM b")
def ledger_state_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops, at = mapping.operations(spark, sf_dir), mapping.last_index(spark, sf_dir) // 2
    kept = at // 300 * 300
    snapshot = snapshots.state_at(ops, kept)
    return mapping.plain(snapshots.state_at(ops, at, snapshot, kept))


REQUESTS = "r AS (SELECT event_id AS arrival, user_id AS client_id, (props->>'$.k')::BIGINT AS sequence_number FROM events), d AS (SELECT *, max(sequence_number) OVER (PARTITION BY client_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest FROM r), c AS (SELECT *, CASE WHEN highest IS NULL OR sequence_number > highest OR (sequence_number = 0 AND highest = 0) THEN 'new' WHEN sequence_number = highest THEN 'duplicate' ELSE 'stale' END AS class FROM d)"


@query(f"WITH {REQUESTS} SELECT * FROM c")
def session_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.classify(mapping.requests(spark, sf_dir))


@query("""WITH r AS (SELECT o_orderkey AS arrival, o_custkey AS client_id, o_orderkey % 50 AS sequence_number, o_orderstatus FROM orders),
d AS (SELECT *, max(sequence_number) OVER (PARTITION BY client_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest, coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS in_flight FROM r),
c AS (SELECT *, CASE WHEN highest IS NULL OR sequence_number > highest OR (sequence_number = 0 AND highest = 0) THEN 'new' WHEN sequence_number = highest THEN 'duplicate' ELSE 'stale' END AS class FROM d)
SELECT arrival, client_id, in_flight, CASE WHEN arrival % 97 = 0 THEN 'not_primary' WHEN class <> 'new' THEN class WHEN in_flight >= 100 OR arrival % 1000 >= 990 THEN 'overloaded' ELSE 'accepted' END AS decision FROM c""")
def admission_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("arrival"), F.col("o_custkey").alias("client_id"), (F.col("o_orderkey") % 50).alias("sequence_number"), "o_orderstatus")
    change = F.when(F.col("o_orderstatus") == "F", -1).otherwise(1)
    rows = sessions.admit(o, F.col("arrival") % 97 != 0, change, F.when(F.col("arrival") % 1000 >= 990, 10_000).otherwise(0), max_inflight=100)
    return rows.select("arrival", "client_id", F.col("in_flight").cast("long").alias("in_flight"), "decision")


@query("WITH r AS (SELECT event_id AS arrival, user_id AS client_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id))::INTEGER AS round, min(event_id) OVER (PARTITION BY user_id) AS f FROM events) SELECT arrival, client_id, round, row_number() OVER (ORDER BY round, f) - 1 AS slot FROM r")
def fair_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.fair_order(mapping.requests(spark, sf_dir))


@query("""WITH RECURSIVE r AS (SELECT user_id, event_id, length(props) * 4096 AS n, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
b AS (SELECT user_id, rn, event_id, 0::BIGINT AS batch, t AS first, n::BIGINT AS held FROM r WHERE rn = 1
    UNION ALL SELECT r.user_id, r.rn, r.event_id, CASE WHEN b.held >= 65536 OR r.t - b.first >= 18000000000 THEN b.batch + 1 ELSE b.batch END,
        CASE WHEN b.held >= 65536 OR r.t - b.first >= 18000000000 THEN r.t ELSE b.first END, CASE WHEN b.held >= 65536 OR r.t - b.first >= 18000000000 THEN r.n ELSE b.held + r.n END FROM b JOIN r ON r.user_id = b.user_id AND r.rn = b.rn + 1)
SELECT event_id AS index, user_id AS stream_id, batch, held AS batch_bytes FROM b""")
def batch_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mapping.log(spark, sf_dir).select("index", "stream_id", div_us(F.col("timestamp_ns")).alias("t"), (F.octet_length("payload") * 4096).cast("long").alias("n"))
    return sessions.batches(rows, "stream_id", "t", "n", "index", max_delay=5 * 3_600_000_000)


def div_us(nanos):
    return mapping.div(nanos, 1000)


@query("SELECT o_orderkey AS index, coalesce(votes, 0)::BIGINT AS votes, coalesce(votes, 0) >= 3 AS has_quorum FROM orders LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_suppkey % 5) AS votes FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def quorum_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("index"))
    return quorum.votes(mapping.acks(spark, sf_dir), quorum.quorum_size(5), expected)


PREFIX = f"WITH {VOTES}, r AS (SELECT range AS idx FROM range((SELECT max(idx) + 2 FROM votes))), v AS (SELECT r.idx, coalesce(votes, 0) AS votes FROM r LEFT JOIN votes USING (idx)), q AS (SELECT unnest([1, 2, 3])::INTEGER AS quorum), p AS (SELECT quorum, min(idx) AS first_gap FROM q JOIN v ON votes < quorum GROUP BY 1)"


@query(f"{PREFIX} SELECT quorum, first_gap, CASE WHEN first_gap > 0 THEN first_gap - 1 END AS committable FROM p")
def committable_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quorum.committed_prefix(mapping.acks(spark, sf_dir), [1, 2, 3])


@query(f"{PREFIX} SELECT o_orderkey AS index, o_custkey AS client_id FROM orders, p WHERE quorum = 1 AND o_orderkey < first_gap")
def pending_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    committed = quorum.committable(mapping.acks(spark, sf_dir), 1)
    pending = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("index"), F.col("o_custkey").alias("client_id"))
    return log.committed_rows(pending, committed)


@query("""WITH s AS (SELECT s_nationkey::BIGINT AS view, s_suppkey AS node_id, (floor(s_acctbal) % 7)::BIGINT AS li, sha256(s_suppkey::VARCHAR) AS lh, (floor(s_acctbal) % 5)::BIGINT AS ci FROM supplier)
SELECT view, n_name AS name, view % 5 AS primary, count(*) AS voters, count(*) >= 3 AS has_quorum, arg_max(node_id, (li, lh)) AS leader, max(li) AS last_log_index, max(ci) AS commit_index FROM s JOIN nation ON n_nationkey = view GROUP BY view, n_name""")
def leader_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("view"), F.col("n_name").alias("name"))
    return quorum.leaders(mapping.view_changes(spark, sf_dir), 5, 3).join(names, "view").select("view", "name", "primary", "voters", "has_quorum", "leader", "last_log_index", "commit_index")


@query('SELECT c_nationkey::BIGINT AS voter, c_custkey % 10 AS view, c_custkey % 5 AS candidate, c_custkey AS "time", c_custkey % 5 = first_value(c_custkey % 5) OVER (PARTITION BY c_nationkey, c_custkey % 10 ORDER BY c_custkey) AS accepted FROM customer')
def vote_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quorum.vote_fence(mapping.ballots(spark, sf_dir))


@query("SELECT s_nationkey::BIGINT AS cluster, count(*) AS live_nodes, min((floor(s_acctbal) % 3)::BIGINT) AS lowest, max((floor(s_acctbal) % 3)::BIGINT) AS highest, min(floor(s_acctbal) % 3) = max(floor(s_acctbal) % 3) AS in_sync FROM supplier WHERE s_acctbal > 0 GROUP BY 1")
def cluster_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quorum.cluster_sync(table(spark, sf_dir, "supplier"), F.col("s_nationkey").cast("long"), (F.floor("s_acctbal") % 3).cast("long"), F.col("s_acctbal") > 0)


@query(f"WITH {EFFECTS} SELECT * FROM outbox")
def outbox_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outbox.status(mapping.effects(spark, sf_dir), mapping.effect_acks(spark, sf_dir), ["user_id", "k"])


@query(f"WITH {EFFECTS} SELECT * FROM outbox WHERE status = 'Pending' ORDER BY created_at, user_id, k LIMIT 100")
def outbox_pending_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outbox.next_cycle(outbox_status(spark, sf_dir), ["user_id", "k"])


@query(f"WITH {EFFECTS} SELECT * FROM outbox WHERE status = 'Pending' OR created_at >= (SELECT max(event_id) // 2 FROM events)")
def outbox_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outbox.compacted(outbox_status(spark, sf_dir), mapping.last_index(spark, sf_dir) // 2)


@query('SELECT o_orderkey AS "time", o_custkey AS token, max(o_custkey) OVER (ORDER BY o_orderkey) AS fence, o_custkey = max(o_custkey) OVER (ORDER BY o_orderkey) AS valid FROM orders')
def fencing_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("time"), F.col("o_custkey").alias("token"))
    return outbox.leases(rows, "time", "token")


@query("""WITH s AS (SELECT event_id AS i FROM events WHERE event_id % 100 = 99 AND event_id % 300 <> 299), t AS (SELECT event_id AS target FROM events WHERE event_id % 37 = 0)
SELECT target, (SELECT max(i) FROM s WHERE i <= target) AS snapshot_index, coalesce((SELECT max(i) FROM s WHERE i <= target), -1) + 1 AS replay_from, target - coalesce((SELECT max(i) FROM s WHERE i <= target), -1) AS to_replay FROM t""")
def snapshot_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    e = table(spark, sf_dir, "events")
    taken = e.where(i % 100 == 99).select(i.alias("last_included_index"), (i % 300 != 299).alias("valid"))
    return snapshots.as_of(e.where(i % 37 == 0).select(i.alias("target")), taken)


@query(f"WITH RECURSIVE {OPS.format('')}, {FOLD}, {HISTORY} SELECT count(*) AS operations, count(*) FILTER (result = 'Success') AS succeeded, count(*) FILTER (result = 'Failure') AS failed, 0::BIGINT AS pending, (sum(amount) FILTER (result = 'Success' AND op = 'deposit'))::BIGINT AS deposits, (sum(amount) FILTER (result = 'Success' AND op = 'withdraw'))::BIGINT AS withdrawals FROM history")
def history_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.stats(mapping.history(ledger.outcomes(mapping.operations(spark, sf_dir))))


@query(f"WITH RECURSIVE {OPS.format('')}, {FOLD}, {HISTORY}, s AS (SELECT user_id AS client_id, seq AS sequence_number, idx, min(idx) OVER (PARTITION BY user_id, seq) AS first_idx FROM history WHERE result = 'Success') SELECT * FROM s WHERE idx > first_idx")
def history_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.duplicate_executions(mapping.history(ledger.outcomes(mapping.operations(spark, sf_dir))))


@query(f"""WITH RECURSIVE {OPS.format('')}, {FOLD}, {HISTORY}, o AS (SELECT user_id, idx, balance, lag(idx) OVER w AS previous_idx, lag(balance) OVER w AS previous_balance FROM history WHERE balance IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY idx))
SELECT user_id, previous_idx, idx, previous_balance, balance FROM o WHERE balance < previous_balance AND NOT EXISTS (SELECT 1 FROM history h WHERE h.user_id = o.user_id AND h.op = 'withdraw' AND h.result = 'Success' AND h.idx BETWEEN o.previous_idx AND o.idx)""")
def history_time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.time_travel(mapping.history(ledger.outcomes(mapping.operations(spark, sf_dir))))


@query("SELECT conv_id, turn, (100 * pow(2, least(turn, 5)))::BIGINT AS backoff_ms, CASE WHEN turn % 2 = 0 THEN conv_id % 5 ELSE (coalesce(CASE WHEN turn % 3 = 0 THEN conv_id % 5 END, 0) + 1) % 5 END AS target FROM conversations")
def client_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    turn, node = F.col("turn"), F.col("conv_id") % 5
    target = scalar.redirect_target(F.when(turn % 2 == 0, node), F.when(turn % 3 == 0, node), 5)
    return c.select("conv_id", "turn", scalar.backoff_ms(turn).alias("backoff_ms"), target.alias("target"))


@query("WITH g AS (SELECT event_id AS index, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (ORDER BY event_id) AS silent_ms FROM events) SELECT index, silent_ms FROM g WHERE silent_ms >= 1000")
def election_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats = mapping.log(spark, sf_dir).select("index", scalar.millis(F.col("timestamp_ns")).alias("at"))
    return stream.silences(beats)


@query("SELECT event_id AS index, sha256(user_id || '/' || event_id || '/0') AS effect_id, substr(sha256(user_id || '/' || event_id || '/0'), 1, 16) AS short_id FROM events WHERE event_type = 'error'")
def effect_id_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    digest = scalar.effect_id(F.col("user_id"), F.col("event_id"), F.lit(0))
    return e.select(F.col("event_id").alias("index"), digest.alias("effect_id"), scalar.short_id(digest).alias("short_id"))


@query(f"WITH RECURSIVE {OPS.format('')}, {FOLD} {BALANCES}")
def stream_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.plain(stream.balances(spark, f"{sf_dir}/events.parquet"))


@query("""WITH a AS (SELECT l_orderkey AS index, min(l_orderkey * 16 + l_linenumber) AS first FROM lineitem GROUP BY 1), g AS (SELECT min(range) AS gap FROM range((SELECT max(index) + 2 FROM a)) WHERE range NOT IN (SELECT index FROM a))
SELECT l_orderkey * 16 + l_linenumber AS arrival, l_orderkey AS index, CASE WHEN l_orderkey * 16 + l_linenumber <> first THEN 'duplicate' WHEN l_orderkey < gap THEN 'appended' ELSE 'early' END AS class FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) JOIN a ON index = l_orderkey, g""")
def admit_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("arrival"), F.col("l_orderkey").alias("index")).distinct()
    return quorum.admit_in_order(rows)


@query("SELECT min(voter) AS voter, view, count(*) AS votes FROM (SELECT DISTINCT c_nationkey::BIGINT AS voter, c_custkey % 10 AS view FROM customer) GROUP BY view")
def view_change_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mapping.ballots(spark, sf_dir).select("voter", "view").distinct()
    return rows.groupBy("view").agg(F.min("voter").alias("voter"), F.count("*").alias("votes"))


@query('WITH r AS (SELECT o_orderkey AS "time", o_custkey AS view, max(o_custkey) OVER (ORDER BY o_orderkey) AS highest FROM orders) SELECT *, view >= highest AS accepted FROM r')
def view_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("time"), F.col("o_custkey").alias("view"))
    return quorum.view_fence(rows, "time", "view")


@query("SELECT event_id AS index, props AS payload FROM events WHERE event_id >= (SELECT max(event_id) // 2 + 1 FROM events)")
def log_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.compact(mapping.log(spark, sf_dir), mapping.last_index(spark, sf_dir) // 2 + 1).select("index", "payload")


@query(f"WITH {EFFECTS} SELECT count(*) AS effects, count(*) FILTER (status = 'Pending') AS pending FROM outbox")
def outbox_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outbox.counts(outbox_status(spark, sf_dir))


@query("SELECT event_id // 500 AS batch, count(*) AS entries, event_id // 500 = 0 AND count(*) = max(event_id) - min(event_id) + 1 AND min(event_id) = 0 AS admitted FROM events GROUP BY 1")
def batch_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mapping.log(spark, sf_dir).select(mapping.div(F.col("index"), 500).alias("batch"), "index")
    return quorum.batch_admission(rows, 0)


@query("SELECT event_id AS index, 'snapshot_' || lpad(event_id::VARCHAR, 20, '0') || '.snap' AS name, event_id AS parsed FROM events WHERE event_id % 1000 = 999")
def snapshot_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mapping.log(spark, sf_dir).where(F.col("index") % 1000 == 999).select("index", scalar.snapshot_name(F.col("index")).alias("name"))
    return rows.withColumn("parsed", scalar.snapshot_index(F.col("name")))


@query("""WITH m AS (SELECT event_id, CASE event_type WHEN 'signup' THEN 'Prepare' WHEN 'click' THEN 'PrepareBatch' WHEN 'purchase' THEN 'PrepareOk' WHEN 'view' THEN 'Commit' ELSE 'CatchUpResponse' END AS kind, (props->>'$.k')::BIGINT % 4 AS n FROM events)
SELECT event_id, kind, CASE WHEN kind IN ('Prepare', 'PrepareOk') THEN event_id WHEN kind = 'PrepareBatch' THEN event_id + greatest(n - 1, 0) WHEN kind = 'CatchUpResponse' AND n > 0 THEN event_id + n - 1 END AS index FROM m""")
def message_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    kind = F.when(t == "signup", "Prepare").when(t == "click", "PrepareBatch").when(t == "purchase", "PrepareOk").when(t == "view", "Commit").otherwise("CatchUpResponse")
    m = table(spark, sf_dir, "events").select("event_id", kind.alias("kind"), (F.get_json_object("props", "$.k").cast("long") % 4).alias("n"))
    return m.select("event_id", "kind", messages.message_index(F.col("kind"), F.col("event_id"), F.col("n")).alias("index"))


@query("""WITH m AS (SELECT o_orderkey AS "time", CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS commit_index FROM orders)
SELECT *, max(least(commit_index, CASE WHEN commit_index IS NOT NULL THEN 1000 END)) OVER (ORDER BY "time") AS committed FROM m""")
def commit_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("time"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("commit_index"))
    return messages.commits(m, "time", "commit_index", 1000)


@query('WITH m AS (SELECT o_orderkey AS "time", o_custkey AS view, max(o_custkey) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS current FROM orders) SELECT *, view >= 20 AND view > coalesce(current, -1) AS adopted FROM m')
def start_view_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("time"), F.col("o_custkey").alias("view"))
    return messages.start_views(rows, "time", "view", 20)


@query("""WITH f AS (SELECT event_id AS index, CASE WHEN event_id % 10 <> 3 THEN 'received' ELSE 'caught_up' END AS source FROM events WHERE event_id % 10 <> 3 OR event_id < 0.7 * (SELECT max(event_id) FROM events)),
g AS (SELECT min(range) AS gap FROM range((SELECT max(index) + 2 FROM f)) WHERE range NOT IN (SELECT index FROM f)) SELECT index, source FROM f, g WHERE index < gap""")
def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mapping.log(spark, sf_dir).select("index")
    i = F.col("index")
    return messages.fill_gaps(rows.where(i % 10 != 3), rows.where((i % 10 == 3) & (i < 0.7 * mapping.last_index(spark, sf_dir))))


@query("SELECT min(r.range) AS from_index, max(r.range) AS to_index FROM range((SELECT max(l_orderkey) + 1 FROM lineitem)) r WHERE r.range NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY r.range // 100")
def catch_up_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    received = mapping.acks(spark, sf_dir)
    return messages.wanted(received, 0, received.agg(F.max("index")).first()[0])
