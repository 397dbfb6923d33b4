"""Snapshots and the manifest as Parquet, and recovery from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.operators import integrity, ledger, snapshots
from ledgerflow.schema import MANIFEST

STATE_VERSION = 2


#: What a snapshot consists of; a header is written last and makes it visible.
PARTS = ("balances", "outbox", "sessions")
HEADER = "last_included_index long, last_included_term long, chain_hash binary, schema_version int, rows long, mark long, own_mark long"


def _digest(rows: DataFrame):
    """Row count and an order-free hash of a table, whatever its columns."""
    mark = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(rows.columns)]) if rows.columns else F.lit(0)
    return rows.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(mark), F.lit(0)).alias("mark")).first()


def _kept(spark: SparkSession, at: str) -> tuple[int, int]:
    """Rows of all parts together, and their marks combined."""
    found = [_digest(spark.read.parquet(f"{at}/{name}")) for name in PARTS]
    rows, mark = 0, 0
    for k, part in enumerate(found):
        rows += part["rows"]
        mark ^= (part["mark"] + k) & ((1 << 63) - 1)
    return rows, mark


def _own_mark():
    """A hash of the header's other fields."""
    return F.xxhash64("last_included_index", "last_included_term", F.hex("chain_hash"), "schema_version", "rows", "mark")


def write_snapshot(folder: str, index: int, balances: DataFrame, outbox: DataFrame, sessions: DataFrame, chain_hash: bytes, term: int, version: int = STATE_VERSION) -> None:
    """State at index: balances, outbox and sessions, then a header with their digest and one of its own, which makes the snapshot visible."""
    spark, at = balances.sparkSession, f"{folder}/last_included_index={index}"
    for name, rows in zip(PARTS, (balances, outbox, sessions), strict=True):
        rows.write.mode("overwrite").parquet(f"{at}/{name}")
    header = [(index, term, chain_hash, version, *_kept(spark, at), 0)]
    spark.createDataFrame(header, HEADER).withColumn("own_mark", _own_mark()).coalesce(1).write.mode("overwrite").parquet(f"{folder}/headers/{index}")


def is_sound(spark: SparkSession, folder: str, index: int) -> bool:
    """Whether all parts of a snapshot are there and have the digest that its header names; reads the snapshot once."""
    header = spark.read.schema(HEADER).parquet(f"{folder}/headers/{index}").first()
    at = f"{folder}/last_included_index={index}"
    for name in PARTS:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/{name}")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return False
    return _kept(spark, at) == (header["rows"], header["mark"])


def read_headers(spark: SparkSession, folder: str) -> DataFrame:
    """The headers, with readable: the header has its own digest and a version that this code knows. What it stands for isn't read."""
    headers = spark.read.schema(HEADER).parquet(f"{folder}/headers/*")
    return headers.withColumn("readable", (F.col("own_mark") == _own_mark()) & F.col("schema_version").between(1, STATE_VERSION))


def latest_sound(spark: SparkSession, folder: str, at: int | None = None):
    """The header of the newest sound snapshot, up to index at; tried from the newest on, so that older ones are read only if it isn't. None if none is."""
    rows = read_headers(spark, folder).where("readable")
    rows = rows if at is None else rows.where(F.col("last_included_index") <= at)
    for row in rows.orderBy(F.desc("last_included_index")).collect():  # one row per snapshot that is kept
        if is_sound(spark, folder, row["last_included_index"]):
            return row
    return None


def read_state(spark: SparkSession, folder: str, index: int, name: str = "balances") -> DataFrame:
    return spark.read.parquet(f"{folder}/last_included_index={index}/{name}")


def recover(spark: SparkSession, folder: str, operations: DataFrame, log: DataFrame, committed: int | None) -> tuple[str, int | None, DataFrame | None]:
    """(verdict, snapshot index, balances) from the latest valid snapshot, if it fits the log, and the committed operations after it.

    Effects of replayed operations are not run again: they are in the outbox or acknowledged.
    """
    best = latest_sound(spark, folder)
    verdict = snapshots.bridge(log, best.asDict() if best else None, committed)
    if verdict != "ok":
        return verdict, best["last_included_index"], None
    at = -1 if committed is None else committed
    if best is None:
        return verdict, None, ledger.balances(ledger.outcomes(operations.where(F.col("index") <= at))).select("user_id", "balance")
    return verdict, best["last_included_index"], snapshots.state_at(operations, at, read_state(spark, folder, best["last_included_index"]), best["last_included_index"])


def _manifest_mark():
    return F.xxhash64(*[F.coalesce(F.col(f.name).cast("string"), F.lit("")) for f in MANIFEST])


def write_manifest(spark: SparkSession, path: str, **row) -> None:
    """The one-row table of the highest view, the vote in it and the end of the log (null: none), with a checksum."""
    made = spark.createDataFrame([tuple(row.get(f.name) for f in MANIFEST)], MANIFEST)
    made.withColumn("mark", _manifest_mark()).coalesce(1).write.mode("overwrite").parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's row. A checksum that differs, a vote for another view than the highest, or a vote without a node raises."""
    rows = spark.read.parquet(path)
    votes = F.col("voted_for_view").isNull() != F.col("voted_for_node").isNull()
    wrong = F.when(F.col("mark") != _manifest_mark(), "manifest checksum differs").when(votes | (F.col("voted_for_view") > F.col("highest_view")), "manifest holds an impossible vote")
    checked = F.when(wrong.isNotNull(), F.raise_error(wrong).cast("long")).otherwise(F.col("highest_view"))
    return rows.withColumn("highest_view", checked).select(*[f.name for f in MANIFEST])


def advance_view(spark: SparkSession, path: str, view: int) -> None:
    """Raises the manifest's view and clears the vote; a view that isn't higher raises ValueError."""
    row = read_manifest(spark, path).first().asDict()
    if view <= row["highest_view"]:
        raise ValueError(f"view {view} isn't above {row['highest_view']}")
    write_manifest(spark, path, **row | {"highest_view": view, "voted_for_view": None, "voted_for_node": None})


def record_vote(spark: SparkSession, path: str, view: int, node: int) -> None:
    """Keeps the vote for node in view, which becomes the highest; a lower view, or another node in the same view, raises ValueError."""
    row = read_manifest(spark, path).first().asDict()
    if view < row["highest_view"] or (row["voted_for_view"] == view and row["voted_for_node"] != node):
        raise ValueError(f"no vote for node {node} in view {view}")
    write_manifest(spark, path, **row | {"highest_view": view, "voted_for_view": view, "voted_for_node": node})


def recover_manifest(spark: SparkSession, path: str, log_view: int | None, log_index: int | None) -> dict:
    """The manifest's row, once it decodes and agrees with the end of the log; otherwise RuntimeError tells how it doesn't."""
    row = integrity.manifest_check(read_manifest(spark, path), log_view, log_index).first().asDict()
    if row.pop("verdict") != "ok":
        raise RuntimeError(f"manifest of view {row['highest_view']} and index {row['last_log_index']} against a log of view {log_view} and index {log_index}")
    return row
