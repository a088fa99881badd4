"""Exact top-k inner products behind multi-resolution segment statistics.

A vector is cut into segments; each keeps its mean and standard deviation. For two vectors the
squared distance within a segment of m components is at least
m * ((mean difference)^2 + (deviation difference)^2), and the sum over segments bounds the whole
squared distance from below, closer with finer segments. With |q|^2 + |x|^2 - 2 qx for that
distance the bound turns into an upper bound of the inner product. Each query block goes from
coarse to fine: candidates whose bound stays below the k-th best product found so far fall out,
and exact products are computed for the survivors alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import table
from tidewell.llm.vectors import QUERY_BLOCK, best, matrix, search, shard_of, top_rows, valid_vectors

SHARD_ROWS = 16_384
#: Numbers of segments, coarse to fine.
LEVELS = (4, 16)
_TOGETHER = 32
_FOUND = "query_id long, vec_id long, score long"


def segment_statistics(x: np.ndarray, n_segments: int) -> np.ndarray:
    """sqrt(m) * mean and sqrt(m) * deviation of each segment: their products add up to the bound."""
    parts = np.array_split(x, min(n_segments, x.shape[1]), axis=1)
    cols = [f(p, axis=1) * np.sqrt(p.shape[1]) for p in parts for f in (np.mean, np.std)]
    return np.stack(cols, axis=1)


def product_bounds(q: np.ndarray, x: np.ndarray, q_norm: np.ndarray, x_norm: np.ndarray) -> np.ndarray:
    """Upper bounds of inner products from the lower bounds of squared distances of statistics."""
    squares = (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :]
    distance = np.maximum(squares - 2 * q @ x.T, 0)
    return (q_norm[:, None] + x_norm[None, :] - distance) / 2


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: in double precision as long as sums stay below 2^53, else in integers
    of any length, of which those beyond a long become its ends."""
    most = q.shape[1] * np.abs(q).max(initial=0) * np.abs(x).max(initial=0)
    if most < 2**53:
        return q @ x.T
    whole = lambda m: np.array([[int(v) for v in row] for row in m], object).reshape(m.shape)
    return np.clip(whole(q) @ whole(x).T, -(2**63), 2**63 - 1)


def top_products(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, ids, products) of the k highest exact products of each query, its own id left out."""
    q_stats, x_stats = ([segment_statistics(v, n) for n in LEVELS] for v in (q, x))
    q_norm, x_norm = (q * q).sum(1), (x * x).sum(1)
    slack = 1e-9 * (q_norm.max(initial=1) + x_norm.max(initial=1))
    out = []
    for at in range(0, len(q), _TOGETHER):
        some = slice(at, at + _TOGETHER)
        alive = np.arange(len(x))
        floor = np.full(len(q[some]), -np.inf)
        own = q_ids[some][:, None] == ids[None, :]
        for level in range(len(LEVELS)):
            bound = product_bounds(q_stats[level][some], x_stats[level][alive], q_norm[some], x_norm[alive]) + slack
            bound[own[:, alive]] = -np.inf
            if len(alive) > 4 * k:  # exact products of the most promising raise the floor
                hopeful = np.unique(np.argpartition(-bound, 2 * k, axis=1)[:, : 2 * k])
                exact = products(q[some], x[alive[hopeful]]).astype(float)
                exact[own[:, alive[hopeful]]] = -np.inf
                floor = np.maximum(floor, np.partition(exact, exact.shape[1] - k, axis=1)[:, exact.shape[1] - k] - slack)
            alive = alive[(bound >= floor[:, None]).any(0)]
        for i, scores in enumerate(products(q[some], x[alive])):
            others = np.flatnonzero(~own[i, alive])
            top = others[top_rows(scores[others], ids[alive[others]], k)]
            out.append((np.full(len(top), q_ids[at + i]), ids[alive[top]], scores[top].astype(np.int64)))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))  # type: ignore[return-value]


def exact_top_k(df: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score for the k highest products of floor(64 * x) vectors.

    Rows whose vector is null, empty or holds a null or non-finite component, and rows without an
    id, take no part; zero vectors do. Only vectors of one dimension are compared. Ties go to the
    smaller id; fewer than k candidates are all returned; rows that repeat an id count once, with
    the least vector. Other columns are not read. Products are exact whatever the size of components;
    those beyond a long become its ends.
    """
    whole = lambda d: valid_vectors(d, id_col, vector_col, allow_zero=True).withColumn("vec", F.transform("vec", lambda v: F.floor(v * 64).cast("double")))
    rows, asked = whole(df), whole(queries)
    n_rows, n_asked = df.count(), queries.count()
    shards = rows.withColumn("shard", shard_of(max(1, -(-n_rows // shard_rows)))).withColumn("dim", F.size("vec"))

    def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        found = top_products(*matrix(left), *matrix(right), k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    return best(search(asked, shards, max(1, -(-n_asked // QUERY_BLOCK)), find, _FOUND), k)


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return exact_top_k(rows, rows.where("vec_id % 20 = 0"))


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_sum(list_transform(list_zip(q.e, x.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id % 20 = 0 AND x.vec_id <> q.vec_id AND len(q.e) = len(x.e)
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
