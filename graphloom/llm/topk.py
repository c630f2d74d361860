"""Exact top-k inner products over an impact-ordered, score-at-a-time index.

Vectors become integers and are dealt into shards. A shard keeps posting lists of rows and values,
one for each component and level of quantised impact (the size of the value). For a block of queries
the levels are read in descending order; each posting adds its part to the accumulators of its row.
After a level, what a row can still gain is bounded by the norms of the query and of the row's unread
postings. Reading stops for a query only when these bounds prove that few rows can be among its k
best; those are then scored exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship

HITS = "query_id long, vec_id long, score long"


class Shard:
    """Impact-ordered postings of a shard's distinct rows."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, k: int, levels: int = 5):
        # of equal rows only the k + 1 smallest distinct ids (one may be the query's own), and of one
        # id only k copies, can be among k results of any query
        order = np.lexsort((ids, *values.T)) if len(ids) else np.array([], int)
        ids, values = ids[order], values[order]
        new = np.ones(len(ids), bool)
        new[1:] = (values[1:] != values[:-1]).any(1)
        fresh = new.copy()
        fresh[1:] |= ids[1:] != ids[:-1]
        at, nth = np.arange(len(ids)), np.cumsum(fresh)
        copy = at - np.maximum.accumulate(np.where(fresh, at, 0))
        keep = (nth - np.maximum.accumulate(np.where(new, nth, 0)) <= k) & (copy < k)
        self.ids, self.values = ids[keep], values[keep].astype(np.float64)
        size = np.abs(self.values)
        top = size.max(initial=1)
        # level j holds sizes in (top / 2**(j + 1), top / 2**j], the last one all that are smaller; zeros have no posting
        with np.errstate(divide="ignore"):
            level = np.minimum(np.floor(np.log2(top / size)), levels - 1)
        level[size == 0] = levels
        #: Levels in descending order: lists of (component, rows, values), and the norm of what is then unread of each row.
        self.levels: list[tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray]] = []
        for j in range(levels):
            lists = [(c, rows, self.values[rows, c]) for c in range(size.shape[1]) if len(rows := np.flatnonzero(level[:, c] == j))]
            left = np.where(level > j, self.values, 0.0)
            self.levels.append((lists, np.sqrt((left * left).sum(1))))

    def search(self, q_ids: np.ndarray, queries: np.ndarray, k: int, few: int = 512, block: int = 64) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query id, ids, scores) of a superset of each query's k best rows of this shard, rows of its own id left out."""
        for s in range(0, len(q_ids), block):
            yield from self._block(q_ids[s : s + block], queries[s : s + block].astype(np.float64), k, max(few, 2 * k))

    def _block(self, q_ids: np.ndarray, q: np.ndarray, k: int, few: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        n = len(self.ids)
        norms = np.sqrt((q * q).sum(1))
        other = self.ids[:, None] != q_ids  # rows of the query's own id are no results, so their bounds prove nothing
        acc = np.zeros((n, len(q_ids)))
        for at, (lists, rest) in enumerate(self.levels):
            for c, rows, values in lists:
                acc[rows] += values[:, None] * q[:, c]
            gain = rest[:, None] * (norms * (1 + 1e-12)) + 1e-6
            low = np.where(other, acc - gain, -math.inf).T.copy()  # a row for each query: partition() reads it in order
            floor = np.partition(low, n - k, axis=1)[:, n - k] if n > k else np.full(len(q_ids), -math.inf)
            possible = other & (acc + gain >= floor)
            done = possible.sum(0) <= few
            if at == len(self.levels) - 1:
                done[:] = True
            for j in np.flatnonzero(done).tolist():
                rows = np.flatnonzero(possible[:, j])
                yield int(q_ids[j]), self.ids[rows], np.rint(self.values[rows] @ q[j]).astype(np.int64)
            if done.all():
                return
            if done.any():  # kept row by row: selecting columns would turn the layout around
                q_ids, q, norms = q_ids[~done], q[~done], norms[~done]
                other, acc = np.ascontiguousarray(other[:, ~done]), np.ascontiguousarray(acc[:, ~done])


def top_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _group(k: int):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            width = max(rows["v"].map(len).max(), queries["v"].map(len).max())

            def matrix(values: pd.Series) -> np.ndarray:
                m = np.zeros((len(values), width))
                for i, v in enumerate(values):
                    m[i, : len(v)] = v
                return m

            shard = Shard(rows["vec_id"].to_numpy(np.int64), matrix(rows["v"]), k)
            for query, ids, scores in shard.search(queries["vec_id"].to_numpy(np.int64), matrix(queries["v"]), k):
                best = top_of(ids, scores, k)
                out.append(pd.DataFrame({"query_id": query, "vec_id": ids[best], "score": scores[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    return run


def vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): integer vectors; null vectors and those with a null or non-finite component take no part.

    Components whose integer would not stay below 2^22 in size raise an error: products of wider
    ones would not be exact.
    """
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    e = e.filter("vec_id is not null and e is not null")
    e = e.filter("forall(e, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    v = F.expr("transform(e, x -> floor(256 * x))")
    wide = F.exists(v, lambda x: F.abs(x) >= (1 << 22))
    return e.select("vec_id", F.when(wide, F.raise_error("a component is too large for exact scores")).otherwise(v).cast("array<int>").alias("v"))


def top_k(
    embeddings: DataFrame,
    is_query,
    k: int = 5,
    shard_values: int = 1 << 19,
    block_queries: int = 8_192,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every query, ties to the smaller vec_id.

    Rows meet queries in blocks: every shard of rows (about shard_values components) with every block
    of queries; a block's best of each shard are merged. Vectors of different lengths are padded with
    zeros. Repeated rows count as rows of their own, other than that a query never meets its vec_id;
    of several vectors under a query's vec_id the least, in the order of arrays, asks. Queries fewer
    than k other rows have get all; an empty table gives no rows.
    """
    spark = embeddings.sparkSession
    ship(spark)
    v = vectors(embeddings)
    queries = v.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    sizes = v.agg(F.sum(F.size("v")).alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    shards, blocks = max(1, -(-(sizes["n"] or 0) // shard_values)), max(1, -(-sizes["q"] // block_queries))
    # copies of a row part over shards too, so that no shard grows with them
    left = v.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    cell = (F.col("shard").cast("long"), F.col("block").cast("long"))
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(_group(k), HITS)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
