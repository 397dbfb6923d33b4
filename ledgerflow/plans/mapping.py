"""The test tables as log, ledger, session, quorum, outbox and history tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.operators.ordered import prefix


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def div(a, b):
    return F.call_function("div", a, F.lit(b).cast("long"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("index"),
        div(F.col("event_id"), 1000).alias("view_id"),
        F.col("user_id").alias("stream_id"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("timestamp_ns"),
        (F.col("event_id") % 8).cast("int").alias("flags"),
        F.lit(1).alias("schema_version"),
        F.col("props").alias("payload"),
    )


def last_index(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, index, kind, amount in cents): signups and clicks are deposits, purchases withdrawals."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "click", "purchase"))
    kind = F.when(F.col("event_type") == "purchase", "withdraw").otherwise("deposit")
    return e.select("user_id", F.col("event_id").alias("index"), kind.alias("kind"), F.round(F.col("value") * 100).cast("long").alias("amount"))


def plain(accounts: DataFrame) -> DataFrame:
    """balance as a long: the tables' amounts are far below its bound."""
    return accounts.withColumn("balance", F.col("balance").cast("long"))


def _kth(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias("index"))
    return prefix(rows, "index", F.lit(1), "k", by=("user_id",)).select("user_id", F.col("k").cast("long").alias("k"), "index")


def effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, k, index): the k-th error of a user creates an effect."""
    return _kth(spark, sf_dir, "error")


def effect_acks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, k, index): the k-th view of a user acknowledges the effect."""
    return _kth(spark, sf_dir, "view")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("arrival"), F.col("user_id").alias("client_id"), F.get_json_object("props", "$.k").cast("long").alias("sequence_number"))


def acks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("index"), (F.col("l_suppkey") % 5).cast("int").alias("node_id"))


def view_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_nationkey").cast("long").alias("view"),
        F.col("s_suppkey").alias("node_id"),
        F.col("s_suppkey").alias("arrival"),
        (F.floor("s_acctbal") % 7).cast("long").alias("last_log_index"),
        F.sha2(F.col("s_suppkey").cast("string"), 256).alias("last_log_hash"),
        (F.floor("s_acctbal") % 5).cast("long").alias("commit_index"),
    )


def ballots(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_nationkey").cast("long").alias("voter"), (F.col("c_custkey") % 10).alias("view"), (F.col("c_custkey") % 5).alias("candidate"), F.col("c_custkey").alias("time"))


def history(outcomes: DataFrame) -> DataFrame:
    """(user_id, idx, client_id, sequence_number, op, amount, result, balance) from the fold's outcomes.

    Every third operation observes the balance; observations at indexes divisible by 97 are a thousand units low; operations at
    indexes divisible by 101 are recorded twice, the second time behind all.
    """
    outcomes = plain(outcomes)
    seen = F.when(F.col("index") % 3 == 0, F.col("balance") - F.when(F.col("index") % 97 == 0, 100_000).otherwise(0))
    rows = outcomes.select(
        "user_id", F.col("index").alias("idx"), F.col("user_id").alias("client_id"), F.col("index").alias("sequence_number"), F.col("kind").alias("op"), "amount",
        F.when(F.col("accepted"), "Success").otherwise("Failure").alias("result"), seen.alias("balance"),
    )
    again = rows.where(F.col("idx") % 101 == 0).withColumn("idx", F.col("idx") + 1_000_000_000).withColumn("balance", F.lit(None).cast("long"))
    return rows.unionByName(again)
