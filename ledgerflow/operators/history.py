"""Checks of recorded client histories: totals, duplicate executions, conservation, balances that go back in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.operators.ordered import prefix


def stats(history: DataFrame) -> DataFrame:
    """One row: operations by result, and the sums of successful deposits and withdrawals, duplicates included."""
    good = F.col("result") == "Success"
    total = lambda op: F.coalesce(F.sum(F.when(good & (F.col("op") == op), F.col("amount"))), F.lit(0))
    return history.agg(
        F.count("*").alias("operations"),
        F.count_if(good).alias("succeeded"),
        F.count_if(F.col("result") == "Failure").alias("failed"),
        F.count_if(F.col("result") == "Pending").alias("pending"),
        total("deposit").alias("deposits"),
        total("withdraw").alias("withdrawals"),
    )


def conserved(history: DataFrame, final_total: int, initial: int = 0) -> bool:
    """Whether initial + deposits - withdrawals is the final total."""
    row = stats(history).first()
    return initial + row["deposits"] - row["withdrawals"] == final_total


def conservation(history: DataFrame, accounts: DataFrame, initial: int = 0) -> DataFrame:
    """One row (deposits, withdrawals, final_total, conserved): what went in and out against the sum of balances in the end."""
    total = accounts.agg(F.coalesce(F.sum("balance"), F.lit(0)).alias("final_total"))
    rows = stats(history).select("deposits", "withdrawals").crossJoin(total)  # one row each
    return rows.withColumn("conserved", F.lit(initial) + F.col("deposits") - F.col("withdrawals") == F.col("final_total"))


def lookup(history: DataFrame) -> DataFrame:
    """The last record of every (client_id, sequence_number)."""
    return history.groupBy("client_id", "sequence_number").agg(F.max_by(F.struct("idx", "op", "result"), "idx").alias("r")).select("client_id", "sequence_number", "r.*")


def duplicate_executions(history: DataFrame) -> DataFrame:
    """(client_id, sequence_number, first_idx, idx): successes of a request after its first success, each against the first."""
    rows = history.where("result = 'Success'").select("client_id", "sequence_number", "idx")
    firsts = rows.groupBy("client_id", "sequence_number").agg(F.min("idx").alias("first_idx"))
    return rows.join(firsts, ["client_id", "sequence_number"]).where("idx > first_idx").select("client_id", "sequence_number", "idx", "first_idx")


def time_travel(history: DataFrame, user: str = "user_id") -> DataFrame:
    """(user, previous_idx, idx, previous_balance, balance): observations lower than the one before, with no withdrawal of the user in between.

    history (user, idx, op, result, balance) holds successful withdrawals and observed balances, idx unique for a user. Withdrawals
    up to each entry, and the observation before it, are running sums and maxima by buckets, so a user's entries are never one
    task's, and no pair of an observation with an entry is made but with the one before.
    """
    taken = F.when((F.col("op") == "withdraw") & (F.col("result") == "Success"), 1).otherwise(0)
    rows = prefix(history.select(user, "idx", "balance", taken.alias("one")), "idx", F.col("one"), "taken", by=(user,))
    seen = rows.where(F.col("balance").isNotNull())
    seen = prefix(seen, "idx", F.col("idx"), "previous_idx", "max", inclusive=False, by=(user,))
    before = seen.select(user, F.col("idx").alias("previous_idx"), F.col("balance").alias("previous_balance"), (F.col("taken") - F.col("one")).alias("taken_then"))
    odd = (F.col("balance") < F.col("previous_balance")) & (F.col("taken") - F.col("taken_then") == 0)
    return seen.join(before, [user, "previous_idx"]).where(odd).select(user, "previous_idx", "idx", "previous_balance", "balance")
