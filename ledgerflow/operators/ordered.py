"""Ordered computations without one task for all rows: bucketed prefixes, ranks, and folds that carry state through sorted partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Width of a bucket of the order column.
WIDTH = 65_536


def prefix(df: DataFrame, order: str, value: Column, name: str, kind: str = "sum", inclusive: bool = True, width: int = WIDTH, by: tuple[str, ...] = ()) -> DataFrame:
    """df with the running sum or max of value in the order of an integer column, within the columns by.

    Rows are bucketed by order div width. A bucket's total is taken first; the window over all buckets sees one row for
    each, and the window over rows is partitioned by bucket. So no task sees more than width order values, or one row of
    each bucket. Null orders form a bucket of their own, before all others. inclusive=False leaves the row itself out.
    """
    add = {"sum": F.sum, "max": F.max}[kind]
    df = df.withColumn("__v", value).withColumn("__b", F.floor(F.col(order) / F.lit(width)).cast("long"))
    ahead = Window.partitionBy(*by).orderBy(F.col("__b").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*by, "__b").agg(add("__v").alias("__t")).withColumn("__before", add("__t").over(ahead))
    totals = totals.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__b").alias("__k"), "__before")
    same = F.col("__b").eqNullSafe(F.col("__k"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    within = Window.partitionBy(*by, "__b").orderBy(F.col(order).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    own = add("__v").over(within)
    df = df.withColumn("__own", own).join(totals, same, "left")
    both = F.coalesce("__own", F.lit(0)) + F.coalesce("__before", F.lit(0)) if kind == "sum" else F.greatest("__own", "__before")
    return df.withColumn(name, both).drop("__v", "__b", "__own", "__k", "__before", *[f"__{c}" for c in by])


def carried_fold(df: DataFrame, key: str, order: list[str], columns: list[str], step: Callable, fresh: Callable, schema: str) -> DataFrame:
    """An ordered fold by key that isn't associative: step(state, *row) gives (state, result) and emits a row for each input row.

    Keys are hashed to partitions and sorted there, which spills; rows then stream through Python batches, and the state of
    the key at hand is all that is kept. A key with very many rows takes time in proportion, no memory. schema
    names columns first, then the results.
    """
    fields = T.StructType.fromDDL(schema).fields
    names, kinds = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields[len(columns) :]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, begun = None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            given = [batch.column(c).to_pylist() for c in columns]
            keys, results = batch.column(key).to_pylist(), []
            for row in zip(keys, *given, strict=True):
                if not begun or row[0] != at:
                    at, state, begun = row[0], fresh(), True
                state, result = step(state, *row[1:])
                results.append(result)
            made = zip(*results, strict=True)
            arrays = [batch.column(c) for c in columns] + [pa.array(c, t) for c, t in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    used = df.select(*dict.fromkeys([key, *order, *columns]))
    return used.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
