"""Exact top-k inner products by aggregation of sorted lists without random access."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of the sorted lists that one task holds, and of the queries that it answers; rows of either, at most.
BLOCK_BYTES, QUERY_BYTES, BLOCK, QUERIES = 32 << 20, 16 << 20, 8_192, 32_768
#: Shares of the lists read by the end of each round; queries whose bounds are kept together.
DEPTHS, GROUP = (1 / 32, 1 / 8, 1 / 4, 1 / 2, 5 / 8, 3 / 4, 13 / 16, 7 / 8, 15 / 16, 1.0), 128
#: Below any score.
NOTHING = -(1 << 62)
#: Products up to this size are exact as doubles, which multiply faster than integers.
EXACT = 1 << 52


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v: array of floor(scale * x)), without vectors that are null or hold a null or non-finite component."""
    x = F.col(vector_col)
    fine = F.col(id_col).isNotNull() & x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return vectors.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))


class SortedLists:
    """One list per dimension: its block's components in ascending order, with the places of the vectors they belong to.

    A query reads each list from the end where its product with the entries is largest, a stretch further each round, and
    never looks a vector up. What it has read of a candidate gives its bounds: in place of an entry not yet read stands the
    list's far end for the lower bound and the list's next entry for the upper one. How far the lists are read is the same for
    all queries of a round, so what has been read from either end is one table for all of them.
    """

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        (self.n, self.d), self.ids = vectors.shape, ids
        self.order = np.argsort(vectors, axis=0, kind="stable").T.copy()  # a list's places, dimension by dimension
        self.values = np.take_along_axis(vectors.T, self.order, axis=1)
        self.rank = np.empty_like(self.order)  # where in a list a vector comes up
        np.put_along_axis(self.rank, self.order, np.arange(self.n)[None], axis=1)
        self.found = np.zeros(self.order.shape, vectors.dtype)  # what the lists have shown so far, by vector
        self.reads = 0  # entries that queries have read

    def read(self, depth: int, top: bool) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper bound) of every component after depth entries of every list from the top, or from the bottom."""
        v, n = self.values, self.n
        stretch = slice(n - depth, n) if top else slice(0, depth)
        np.put_along_axis(self.found, self.order[:, stretch], v[:, stretch], axis=1)
        shown = self.rank >= n - depth if top else self.rank < depth
        far, ahead = (v[:, :1], v[:, [n - 1 - min(depth, n - 1)]]) if top else (v[:, -1:], v[:, [min(depth, n - 1)]])
        return np.where(shown, self.found, far), np.where(shown, self.found, ahead)

    def resolve(self, query: np.ndarray, alive: np.ndarray, low: np.ndarray, depth: int) -> np.ndarray:
        """Lower bounds once the lists have been read to their ends for the candidates alive: their scores."""
        for rows, rest, far in ((query > 0, slice(0, self.n - depth), 0), (query < 0, slice(depth, self.n), -1)):
            lists = np.flatnonzero(rows)
            place, values = self.order[lists, rest], self.values[lists, rest]
            self.reads += place.size
            keep = alive[place]
            gain = (values - self.values[lists, far][:, None]) * query[lists][:, None]
            np.add.at(low, place[keep], gain[keep])
        return low

    def top(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """(query's id, id, score) of each query's k best by score, ties to the smaller id, without ids equal to its own.

        After a round, no candidate whose upper bound is below the k-th best lower bound can qualify, seen or not. Once few are left, the
        rest of the lists is read for them alone, in their order, which resolves the scores.
        """
        out, k = [], min(k, self.n)
        left = np.arange(len(queries))
        for depth in sorted({max(1, round(self.n * share)) for share in DEPTHS}):
            tables, waiting = [*self.read(depth, True), *self.read(depth, False)], []
            for at in range(0, len(left), GROUP):
                group = left[at : at + GROUP]
                up, down = np.maximum(queries[group], 0), np.minimum(queries[group], 0)
                low, high = up @ tables[0] + down @ tables[2], up @ tables[1] + down @ tables[3]
                itself = self.ids == own[group][:, None]
                low[itself] = high[itself] = NOTHING
                bound = np.partition(low, self.n - k, axis=1)[:, self.n - k]
                alive = (high >= bound[:, None]) & (high > NOTHING)
                few = (alive.sum(1) <= max(4 * k, self.n // 32)) | (depth == self.n)
                waiting.append(group[~few])
                for row in np.flatnonzero(few):
                    self.reads += depth * int((queries[group[row]] != 0).sum())
                    score = self.resolve(queries[group[row]], alive[row], low[row], depth)
                    found = np.flatnonzero(alive[row])
                    best = found[np.lexsort((self.ids[found], -score[found]))[:k]]
                    out += [(int(own[group[row]]), int(self.ids[i]), int(score[i])) for i in best]
            left = np.concatenate(waiting) if waiting else left[:0]
            if not len(left):
                break
        return out


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where is_query, its k largest integer inner products with other rows.

    Rows are dealt by hash to blocks of about block candidates and groups of about queries queries, fewer where vectors are long, so that a
    task holds BLOCK_BYTES and QUERY_BYTES at most; it sorts one block's lists and answers one group of queries from them. Results of a query from all blocks, k each, are ranked together. Fewer rows than k give all; ties go
    to the smaller vec_id; vectors of different lengths aren't compared. Rows that repeat an id are candidates each, but
    none for a query of their own id. Vectors that are null or hold a null, NaN or infinity take no part. An empty table
    gives none. Scores must fit a long. Each block is sent to every group of queries, and each query to every block: with
    queries a fixed share of the rows, reading grows with the square of their number, as any full search of theirs does.
    """
    rows = quantized(vectors, id_col, vector_col, scale)
    asks = quantized(vectors.where(is_query), id_col, vector_col, scale)
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    m = asks.count()
    block, queries = max(1, min(block, BLOCK_BYTES // (64 * max(1, width)))), max(1, min(queries, QUERY_BYTES // (8 * max(1, width))))
    blocks, groups = max(1, -(-n // block)), max(1, -(-m // queries))
    part = lambda of, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    left = rows.select(F.size("v").alias("d"), part(blocks, "block").alias("b"), every(groups).alias("g"), "vec_id", "v")
    right = asks.select(F.size("v").alias("d"), every(blocks).alias("b"), part(groups, "group").alias("g"), "vec_id", "v")

    def answer(block_rows: pd.DataFrame, query_rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block_rows) and len(query_rows):
            x, q = (np.array(rows["v"].tolist(), np.int64).reshape(len(rows), -1) for rows in (block_rows, query_rows))
            if x.shape[1] * float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) < EXACT:
                x, q = x.astype(np.float64), q.astype(np.float64)
            out = SortedLists(x, block_rows["vec_id"].to_numpy()).top(q, query_rows["vec_id"].to_numpy(), k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = left.groupBy("d", "b", "g").cogroup(right.groupBy("d", "b", "g")).applyInPandas(answer, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def exact_top_k_sql(step: int = 50, k: int = 5, scale: int = 256) -> str:
    """The same over the table embeddings, with ids divisible by step as queries, as DuckDB SQL."""
    return f"""
WITH fine AS (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
    FROM fine q JOIN fine c ON q.vec_id % {step} = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= {k}
"""
