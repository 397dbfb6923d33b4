"""Votes, quorums, the committed prefix, leaders and fences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.operators.ordered import prefix

#: Fixed value: nodes of a cluster, at most.
MAX_NODES = 64


def quorum_size(nodes: int) -> int:
    if not 1 <= nodes <= MAX_NODES:
        raise ValueError(f"a cluster has 1 to {MAX_NODES} nodes")
    return nodes // 2 + 1


def with_local_votes(acks: DataFrame, written: DataFrame, primary: int) -> DataFrame:
    """acks and a vote of the primary for every index (index) that it wrote."""
    return acks.select("index", "node_id").unionByName(written.select("index", F.lit(primary).cast(acks.schema["node_id"].dataType).alias("node_id")))


def votes(acks: DataFrame, quorum: int, expected: DataFrame | None = None) -> DataFrame:
    """(index, votes, has_quorum): distinct nodes by index as a bit set, which combines before the shuffle; expected indexes without acks have 0."""
    bits = acks.groupBy("index").agg(F.bit_or(F.expr("shiftleft(1L, cast(node_id as int))")).alias("nodes"))
    rows = bits if expected is None else expected.select("index").distinct().join(bits, "index", "left")
    n = F.coalesce(F.bit_count("nodes"), F.lit(0)).cast("long")
    return rows.select("index", n.alias("votes"), (n >= quorum).alias("has_quorum"))


def committable(acks: DataFrame, quorum: int, committed: int | None = None) -> int | None:
    """The last index up to which every index after committed has a quorum; committed if the next one lacks it; null if none has."""
    counted = votes(acks, quorum).where("has_quorum")
    first = 0 if committed is None else committed + 1
    top = counted.agg(F.max("index")).first()[0]
    if top is None or top < first:
        return committed
    gap = acks.sparkSession.range(first, top + 2).withColumnRenamed("id", "index").join(counted, "index", "left_anti").agg(F.min("index")).first()[0]
    return committed if gap == first else gap - 1


def range_past(indexes: DataFrame, start: int) -> DataFrame:
    """(index) of start..max + 1, as a distributed range; start alone if indexes has none from there on."""
    top = indexes.agg(F.max("index")).first()[0]
    return indexes.sparkSession.range(start, max(start, -1 if top is None else top + 1) + 1).withColumnRenamed("id", "index")


def committed_prefix(acks: DataFrame, quorums: list[int]) -> DataFrame:
    """(quorum, first_gap, committable) from index 0 for each size; committable is null where index 0 lacks it.

    The first index of 0..max + 1 whose votes are too few is a conditional minimum, no window over the log; the largest index is found first.
    """
    counted = votes(acks, 1)
    every = range_past(acks, 0)
    rows = every.join(counted, "index", "left").select("index", F.coalesce("votes", F.lit(0)).alias("votes"))
    gaps = rows.agg(*[F.min(F.when(F.col("votes") < q, F.col("index"))).alias(f"g{q}") for q in quorums])
    out = gaps.select(F.explode(F.array(*[F.struct(F.lit(q).alias("quorum"), F.col(f"g{q}").alias("first_gap")) for q in quorums])).alias("r")).select("r.*")
    return out.withColumn("committable", F.when(F.col("first_gap") > 0, F.col("first_gap") - 1))


def uncommitted_votes(acks: DataFrame, committed: int | None) -> DataFrame:
    return acks if committed is None else acks.where(F.col("index") > committed)


def leaders(messages: DataFrame, nodes: int, quorum: int) -> DataFrame:
    """(view, primary, voters, has_quorum, leader, last_log_index, commit_index) of view_change messages; a node's first message in a view counts.

    The leader has the largest (last_log_index, last_log_hash).
    """
    rows = messages.groupBy("view", "node_id").agg(F.min_by(F.struct("last_log_index", "last_log_hash", "commit_index"), "arrival").alias("m"))
    best = F.max(F.struct(F.col("m.last_log_index"), F.col("m.last_log_hash"), F.col("node_id")))
    out = rows.groupBy("view").agg(F.count("*").alias("voters"), best.alias("best"), F.max("m.commit_index").alias("commit_index"))
    return out.select("view", F.pmod("view", F.lit(nodes)).alias("primary"), "voters", (F.col("voters") >= quorum).alias("has_quorum"), F.col("best.node_id").alias("leader"), F.col("best.last_log_index").alias("last_log_index"), "commit_index")


def vote_fence(ballots: DataFrame) -> DataFrame:
    """ballots (voter, view, candidate, time) with accepted: a voter keeps, in a view, to the candidate of its first vote."""
    first = ballots.groupBy("voter", "view").agg(F.min_by("candidate", "time").alias("first"))
    return ballots.join(first, ["voter", "view"]).withColumn("accepted", F.col("candidate") == F.col("first")).drop("first")


def view_fence(messages: DataFrame, order: str, view: str) -> DataFrame:
    """messages with highest (view up to and with the row) and accepted: the view isn't lower than any before."""
    rows = prefix(messages, order, F.col(view), "highest", "max")
    return rows.withColumn("accepted", F.col(view) >= F.col("highest"))


def cluster_sync(states: DataFrame, cluster: Column, committed: Column, alive: Column) -> DataFrame:
    """(cluster, live_nodes, lowest, highest, in_sync): all live nodes have committed, and the same."""
    rows = states.where(alive).select(cluster.alias("cluster"), committed.alias("c"))
    out = rows.groupBy("cluster").agg(F.count("*").alias("live_nodes"), F.count("c").alias("known"), F.min("c").alias("lowest"), F.max("c").alias("highest"))
    return out.select("cluster", "live_nodes", "lowest", "highest", F.coalesce((F.col("lowest") == F.col("highest")) & (F.col("known") == F.col("live_nodes")), F.lit(False)).alias("in_sync"))


def replication_gap(appended: int | None, committed: int | None) -> int:
    return max(0, (0 if appended is None else appended) - (0 if committed is None else committed))


def admit_in_order(arrivals: DataFrame, start: int = 0) -> DataFrame:
    """arrivals (arrival, index) with class: the batch view of in-order admission from index start.

    appended: first arrival of an index in the contiguous run from start; duplicate: a later one; early: beyond the first gap, still buffered.
    """
    firsts = arrivals.where(F.col("index") >= start).groupBy("index").agg(F.min("arrival").alias("first"))
    every = range_past(arrivals, start)
    gap = every.join(firsts, "index", "left_anti").agg(F.min("index")).first()[0]
    rows = arrivals.join(firsts, "index", "left")
    kind = F.when((F.col("index") < start) | (F.col("arrival") != F.col("first")), "duplicate").when(F.col("index") < gap, "appended").otherwise("early")
    return rows.select("arrival", "index", kind.alias("class"))


def batch_admission(entries: DataFrame, expected: int) -> DataFrame:
    """(batch, entries, admitted) of prepared batches (batch, index): whole and contiguous, beginning at the expected index."""
    rows = entries.groupBy("batch").agg(F.count("*").alias("entries"), F.count_distinct("index").alias("kinds"), F.min("index").alias("lo"), F.max("index").alias("hi"))
    fits = (F.col("lo") == expected) & (F.col("hi") - F.col("lo") + 1 == F.col("entries")) & (F.col("kinds") == F.col("entries"))
    return rows.select("batch", "entries", fits.alias("admitted"))


def manifests(ballots: DataFrame) -> DataFrame:
    """(voter, highest_view, voted_for) after ballots (voter, view, candidate, time): a higher view clears the vote, and in a view the first candidate stays.

    So what is left is the first candidate of the highest view: two combinable aggregates, no fold.
    """
    top = ballots.groupBy("voter", "view").agg(F.min_by("candidate", "time").alias("candidate"))
    best = top.groupBy("voter").agg(F.max(F.struct("view", "candidate")).alias("m"))
    return best.select("voter", F.col("m.view").alias("highest_view"), F.col("m.candidate").alias("voted_for"))


def replication_gaps(states: DataFrame, cluster: Column, appended: Column, committed: Column) -> DataFrame:
    """(cluster, appended, committed, gap): how far the committed index is behind the appended one, never below 0."""
    rows = states.groupBy(cluster.alias("cluster")).agg(F.max(appended).alias("appended"), F.max(committed).alias("committed"))
    return rows.withColumn("gap", F.greatest(F.lit(0), F.coalesce("appended", F.lit(0)) - F.coalesce("committed", F.lit(0))))
