"""What both vector searches share: valid rows, even shards, query blocks, the final merge.

Candidates are dealt evenly over shards by a hash of their id, queries over blocks of bounded
size. Each (shard, block) pair is one task's work; every query meets every shard, which is the
stated query set against all rows, in blocks. A shard's rows are read as one group, whose size
its bound fixes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries of a block; rows of a shard are a parameter of each search.
QUERY_BLOCK = 4096


def valid_vectors(df: DataFrame, id_col: str, vector_col: str, *, allow_zero: bool) -> DataFrame:
    """vec_id and vec (array of double) of the rows that take part.

    Left out: null ids, null or empty vectors, vectors with null, NaN or infinite components and,
    unless ``allow_zero``, zero vectors.
    """
    vec = F.col("vec")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    keep = F.col("vec_id").isNotNull() & (F.size(vec) > 0) & F.coalesce(fine, F.lit(False))
    if not allow_zero:
        keep &= F.exists(vec, lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec")).where(keep)


def shard_of(n_shards: int):
    return F.pmod(F.xxhash64("vec_id"), F.lit(n_shards)).cast("int")


def matrix(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(ids ascending, vectors) of one group of one dimension; of rows that share an id the least vector counts."""
    vectors = np.stack(rows["vec"].to_numpy()).astype(np.float64)
    ids = rows["vec_id"].to_numpy(np.int64)
    order = np.lexsort((*vectors.T[::-1], ids))
    ids, vectors = ids[order], vectors[order]
    first = np.ones(len(ids), bool)
    first[1:] = ids[1:] != ids[:-1]
    return ids[first], vectors[first]


def blocks_of(queries: DataFrame, shards: DataFrame, n_blocks: int) -> DataFrame:
    """Each query once for each shard that has vectors of its dimension: (shard, dim, block, vec_id, vec)."""
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int")).withColumn("dim", F.size("vec"))
    present = shards.groupBy("dim").agg(F.collect_set("shard").alias("present"))
    return dealt.join(F.broadcast(present), "dim").select(F.explode("present").alias("shard"), "dim", "block", "vec_id", "vec")


def search(queries: DataFrame, shards: DataFrame, n_blocks: int, find: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``find(queries, shard rows)`` for each (shard, dimension, block)."""
    spread = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    keys = ["shard", "dim", "block"]

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return find(left, right)

    return blocks_of(queries, shards.select("shard", "dim").distinct(), n_blocks).groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInPandas(one, schema)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of all shards: query_id, rank, vec_id, score."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    if len(scores) > k and scores.dtype != object:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    if scores.dtype == object:  # whole numbers that a double does not hold
        return np.array(sorted(at, key=lambda i: (-scores[i], ids[i])), np.int64)[:k]
    return at[np.lexsort((ids[at], -scores[at]))][:k]
