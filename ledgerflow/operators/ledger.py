"""Account state: deposits and withdrawals in log order, where a withdrawal above the balance is rejected and changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.operators.ordered import carried_fold
from ledgerflow.schema import AMOUNT, AMOUNT_MAX


def outcomes(operations: DataFrame, opening: DataFrame | None = None, user: str = "user_id") -> DataFrame:
    """(user, index, kind, amount, accepted, balance) for every operation (user, index, kind deposit|withdraw, amount >= 0).

    balance is the one after the operation, decimal(20,0) whatever integer type amounts have. opening (user, balance) holds balances to begin from, such as a snapshot's; users
    without one begin at 0. Deposits saturate at the largest unsigned 64-bit number. Rejection makes the fold non-associative, so a
    user's operations run in order, and users in parallel.
    """
    columns = [user, "index", "kind", "amount"]
    rows = operations.select(*columns)
    if opening is not None and rows.schema["amount"].dataType != AMOUNT:
        rows = rows.withColumn("amount", F.col("amount").cast(AMOUNT))
    if opening is not None:
        rows = rows.unionByName(opening.select(user, F.lit(-1).cast("long").alias("index"), F.lit("opening").alias("kind"), F.col("balance").cast(AMOUNT).alias("amount")))

    def step(balance, who, index, kind, amount):
        accepted = kind != "withdraw" or amount <= balance
        if accepted:
            balance = balance - int(amount) if kind == "withdraw" else min(balance + int(amount), AMOUNT_MAX)
        return balance, (accepted, balance)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + f", accepted boolean, balance {AMOUNT.simpleString()}"
    return carried_fold(rows, user, ["index"], columns, step, lambda: 0, schema)


def balances(results: DataFrame, user: str = "user_id") -> DataFrame:
    """(user, balance, applied, rejected) of users with an accepted operation or an opening balance."""
    real = F.col("kind") != "opening"
    out = results.groupBy(user).agg(
        F.max_by("balance", "index").alias("balance"),
        F.count_if(F.col("accepted") & real).alias("applied"),
        F.count_if(~F.col("accepted")).alias("rejected"),
        F.count_if("accepted").alias("__any"),
    )
    return out.where("__any > 0").drop("__any")


def before_poison(operations: DataFrame, poison: DataFrame) -> DataFrame:
    """The operations before the first poison event (index), of whatever user; all of them if there is none."""
    cut = poison.agg(F.min("index")).first()[0]
    return operations if cut is None else operations.where(F.col("index") < cut)


def halted_at(poison: DataFrame) -> int | None:
    return poison.agg(F.min("index")).first()[0]


def lookup(accounts: DataFrame, users: DataFrame, user: str = "user_id") -> DataFrame:
    """(user, balance) of the users asked for, 0 where unknown."""
    return users.join(accounts.select(user, "balance"), user, "left").select(user, F.coalesce("balance", F.lit(0)).alias("balance"))
