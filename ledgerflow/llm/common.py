"""Helpers that the operators share: reading, scratch tables and walking Arrow batches.

Every operator selects only the columns it names, so further columns, even with clashing names, do no harm.
A null text counts as the empty text.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python step holds as words at one time; one longer text is held alone.
SLICE_BYTES = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with nulls in text as the empty text."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def fold_of(column: str, modulus: int):
    """crc32 of the id as text, modulo modulus; a null id has the crc of the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where it is unset, a local session (as in tests) gets a folder of its own, a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("ledgerflow.scratch.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="ledgerflow-")
        spark.conf.set("ledgerflow.scratch.dir", root)
    return root.rstrip("/")


def trim() -> None:
    """Hands memory that a task has freed back to the system, as Spark keeps Python workers for later tasks of any operator."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if give_back:
        give_back(0)


def local_frame(spark: SparkSession, columns: dict[str, list], schema: str) -> DataFrame:
    """A small table from the driver's columns, by Arrow: no Python worker is started for it."""
    fields = [part.split() for part in schema.split(", ")]
    kinds = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32(), "string": pa.string()}
    return spark.createDataFrame(pa.table({n: pa.array(columns[n], kinds[t]) for n, t in fields}), schema)


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive any executor."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark, self.base, self.n = spark, f"{scratch_root(spark)}/{purpose}-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame) -> DataFrame:
        path, self.n = f"{self.base}/{self.n}", self.n + 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Removes a table that save() returned, once no lazy result reads it."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, texts as UTF-8 bytes) from batches of (id, text), cut so that a slice holds about limit bytes."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
        start = size = 0
        for i, text in enumerate(texts):
            if size and size + len(text) > limit:
                yield ids[start:i], texts[start:i]
                start, size = i, 0
            size += len(text)
        if start < len(ids):
            yield ids[start:], texts[start:]


def keep_rows(docs: DataFrame, keeps: Callable[[], Callable[[list[bytes]], list[bool]]], text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text is kept; nothing is shuffled.

    keeps is called once in each task and gives the function from texts (null: empty) to decisions. Rows that repeat, or have no id, are
    decided one by one.
    """
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = keeps()
        for batch in batches:
            texts = [t or b"" for t in batch.column(place).cast(pa.binary()).to_pylist()]
            mask, start, size = [], 0, 0
            for i, text in enumerate(texts):
                if size and size + len(text) > SLICE_BYTES:
                    mask += decide(texts[start:i])
                    start, size = i, 0
                size += len(text)
            yield batch.filter(pa.array(mask + decide(texts[start:]), pa.bool_()))
        trim()

    return docs.mapInArrow(run, docs.schema)
