"""Bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import fold_of, texts_of

#: Rows whose crc32(doc_id as text) modulo FOLDS is zero are held out: no label of theirs is learned.
FOLDS = 5


def known_labels(labels: DataFrame, label_col: str) -> DataFrame:
    """(doc_id, label int) of all labels that aren't held out; null labels and ids are left out, of several for an id the largest counts."""
    return labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & (fold_of("doc_id", FOLDS) != 0)).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, bound: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label int) of about bound labelled rows at most, none of them held out.

    The sample is those whose hashed id is below bound / (labelled rows), so it is the same however the tables
    are partitioned. The labels kept are at most about bound rows and are broadcast; documents are not shuffled.
    Null labels and ids are left out; of several labels for an id the largest counts.
    """
    known = known_labels(labels, label_col)
    share = min(1.0, bound / max(1, known.count()))
    scale = 1 << 30
    kept = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(scale)) < int(share * scale))
    return texts_of(docs, id_col, text_col).join(F.broadcast(kept), "doc_id")
