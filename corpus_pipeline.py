"""From documents to packed sequences in stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerflow.llm.common import Scratch, read_table
from ledgerflow.llm.decontaminate import drop_contaminated
from ledgerflow.llm.near_copies import drop_near_copies
from ledgerflow.llm.packing import pack
from ledgerflow.llm.secret_scan import redact_secrets
from ledgerflow.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels of the documents given, rejects go (score >= 0.5).

    Null and empty texts get the bias's score; rows that repeat or have no id are judged one by one; without labels all stay.
    """
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that 5-word Jaccard similarities of 0.8 or more link one row stays, the first.

    Rows are decided by number, not by id: repeated and null ids lose no text of their own. Null and empty texts are copies of each other.
    """
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none; each row is judged for itself."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, rows that repeat too; secrets in their texts are masked, and a null text stays null."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences; a null or empty text is one piece, every row a document."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]

#: The stages learn, hash and tokenize, which SQL can't express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; a stage's table is removed once the next one's is written, the last one read by the result."""
    docs, scratch, earlier = read_table(spark, sf_dir, "documents"), Scratch(spark, "pipeline"), None
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
        if earlier is not None:
            scratch.drop(earlier)
        earlier = docs
    return STAGES[-1][1](spark, docs, sf_dir)
