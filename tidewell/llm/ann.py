"""Approximate nearest neighbours: a robust-pruned directed graph in each shard.

Points enter the graph in batches. A greedy beam search on the graph so far proposes neighbours
for each point of a batch; pruning keeps the nearest one, drops those that lie ``ALPHA`` times
nearer to it than to the point, and goes on, so that diverse edges stay; each edge is also
entered backwards, with the same pruning where a list overflows. A second pass over all points
mends the edges of early ones. Queries walk each shard's graph by beam search from the point
nearest to the mean, and the hits are scored exactly.

For the largest inner product points are lifted by one component to the norm of the largest,
where the nearest point has the largest product. Equal vectors are one point of the graph with
all their ids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import stored, table
from tidewell.llm.vectors import QUERY_BLOCK, best, matrix, search, shard_of, valid_vectors

SHARD_ROWS = 8192
DEGREE, BEAM, ALPHA = 32, 64, 1.2
#: Width of the beam for queries, and points opened at a time.
QUERY_BEAM, OPEN = 128, 4
_FOUND = "query_id long, vec_id long, score double"


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(points, squared distances) of the beam of each query at its end, nearest first; -1 pads."""
    n_q = len(q)
    rows = np.arange(n_q)[:, None]
    points = np.full((n_q, width), -1)
    far = np.full((n_q, width), np.inf, np.float32)
    opened = np.zeros((n_q, width), bool)
    seen = np.zeros((n_q, len(x) + 1), bool)
    points[:, 0], far[:, 0] = start, ((q - x[start]) ** 2).sum(1)
    seen[:, start] = True
    q_norm, x_norm = (q * q).sum(1), (x * x).sum(1)
    while True:
        waiting = np.where(opened | (points < 0), np.inf, far)
        if not np.isfinite(waiting).any():
            return points, far
        at = np.argpartition(waiting, OPEN, axis=1)[:, :OPEN] if width > OPEN else np.argsort(waiting, axis=1)[:, :OPEN]
        valid = np.isfinite(np.take_along_axis(waiting, at, 1))
        opened[rows, at] |= valid
        new = np.where(valid[:, :, None], graph[np.where(valid, points[rows, at], 0)], -1).reshape(n_q, -1)
        new = np.sort(new, axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        new[seen[rows, new]] = -1
        seen[rows, new] = True
        seen[:, -1] = False
        which, place = np.nonzero(new >= 0)
        d = np.full(new.shape, np.inf, np.float32)
        hit = new[which, place]
        d[which, place] = q_norm[which] + x_norm[hit] - 2 * np.einsum("ij,ij->i", q[which], x[hit])
        points, far = np.concatenate([points, new], 1), np.concatenate([far, d], 1)
        opened = np.concatenate([opened, np.zeros(new.shape, bool)], 1)
        order = np.argsort(far, axis=1)[:, :width]
        points, far, opened = points[rows, order], far[rows, order], opened[rows, order]


def robust_prune(x: np.ndarray, at: np.ndarray, candidates: np.ndarray, alpha: float) -> np.ndarray:
    """DEGREE diverse neighbours of each point out of its candidates (-1 pads)."""
    candidates = np.sort(candidates, axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    candidates[candidates == at[:, None]] = -1
    c = x[candidates]
    d = ((c - x[at][:, None, :]) ** 2).sum(2)
    d[candidates < 0] = np.inf
    order = np.argsort(d, axis=1)
    rows = np.arange(len(at))
    candidates, d = candidates[rows[:, None], order], d[rows[:, None], order]
    c = c[rows[:, None], order]
    norms = (c * c).sum(2)
    between = norms[:, :, None] + norms[:, None, :] - 2 * c @ c.transpose(0, 2, 1)
    alive = np.isfinite(d)
    out = np.full((len(at), DEGREE), -1)
    for k in range(DEGREE):
        pick = alive.argmax(1)
        any_left = alive[rows, pick]
        if not any_left.any():
            break
        out[any_left, k] = candidates[rows, pick][any_left]
        alive[rows, pick] = False
        alive &= ~(alpha * between[rows, pick] <= d) | ~any_left[:, None]
    return out


def build_graph(x: np.ndarray, seed: int = 0) -> tuple[np.ndarray, int]:
    """(neighbours of each point, -1 padded; start point)."""
    n = len(x)
    graph = np.full((n, DEGREE), -1)
    start = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    for turn, alpha in ((0, 1.0), (1, ALPHA)):
        done = 1 if turn == 0 else 0
        while done < n:
            size = min(512, max(16, done)) if turn == 0 else 512
            at = order[done : done + size]
            done += size
            points, _ = beam_search(x, graph, start, x[at], BEAM)
            graph[at] = robust_prune(x, at, np.concatenate([points, graph[at]], 1), alpha)
            # the same edges backwards
            source, target = np.repeat(at, DEGREE), graph[at].ravel()
            source, target = source[target >= 0], target[target >= 0]
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            ends, first, count = np.unique(target, return_index=True, return_counts=True)
            wide = np.full((len(ends), int(count.max(initial=0))), -1)
            wide[np.repeat(np.arange(len(ends)), count), np.arange(len(target)) - np.repeat(first, count)] = source
            for part in range(0, len(ends), 512):
                some = ends[part : part + 512]
                joined = np.concatenate([graph[some], wide[part : part + 512]], 1)
                fits = (joined >= 0).sum(1) <= DEGREE
                packed = -np.sort(-joined[fits], axis=1)[:, :DEGREE]
                packed[:, 1:][packed[:, 1:] == packed[:, :-1]] = -1
                graph[some[fits]] = packed
                if not fits.all():
                    graph[some[~fits]] = robust_prune(x, some[~fits], joined[~fits], alpha)
    return graph, start


def lifted(x: np.ndarray, norm: float) -> np.ndarray:
    """Points with one more component, all of the same norm."""
    rest = np.sqrt(np.maximum(norm * norm - (x * x).sum(1), 0))
    return (np.column_stack([x, rest]) / norm).astype(np.float32)


def build_index(rows: pd.DataFrame, norm: float) -> pd.DataFrame:
    """One index row of one shard and dimension."""
    ids, vectors = matrix(rows)
    points, group = np.unique(vectors, axis=0, return_inverse=True)
    graph, start = build_graph(lifted(points, norm))
    return pd.DataFrame({
        "shard": rows["shard"].iloc[:1].to_numpy(), "dim": [points.shape[1]], "n": [len(points)], "start": [start],
        "ids": [ids.tobytes()], "group_of": [group.ravel().astype("<i8").tobytes()], "points": [points.tobytes()], "graph": [graph.astype("<i4").tobytes()],
    })


_INDEX = "shard int, dim int, n long, start long, ids binary, group_of binary, points binary, graph binary"


def search_index(q_ids: np.ndarray, q: np.ndarray, row: pd.Series, norm: float, k: int) -> pd.DataFrame:
    """The k nearest found for each query in one index row, scored in double precision."""
    n, dim = int(row["n"]), int(row["dim"])
    points = np.frombuffer(row["points"], np.float64).reshape(n, dim)
    graph = np.frombuffer(row["graph"], "<i4").reshape(n, DEGREE)
    ids, group = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["group_of"], "<i8")
    by_group = np.argsort(group, kind="stable")  # ids ascend within a group
    first = np.searchsorted(group[by_group], np.arange(n + 1))
    x = lifted(points, norm)
    out = []
    for at in range(0, len(q), 256):
        some = q[at : at + 256]
        flat = np.column_stack([some / np.sqrt((some * some).sum(1))[:, None], np.zeros(len(some))]).astype(np.float32)
        found, _ = beam_search(x, graph, int(row["start"]), flat, max(QUERY_BEAM, 2 * k))
        for i, near in enumerate(found):
            near = near[near >= 0]
            scores = np.einsum("ij,j->i", points[near], some[i])
            # of equal vectors the k + 1 smallest ids can be among the k best
            members = [ids[by_group[first[p] : min(first[p + 1], first[p] + k + 1)]] for p in near]
            who, score = np.concatenate(members), np.repeat(scores, [len(m) for m in members])
            score, who = score[who != q_ids[at + i]], who[who != q_ids[at + i]]
            top = np.lexsort((who, -score))[:k]
            out.append((np.full(len(top), q_ids[at + i]), who[top], score[top]))
    cols = [np.concatenate(c) for c in zip(*out, strict=True)]
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), cols, strict=True)))


def nearest(df: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the k largest inner products found.

    Rows whose vector is null, empty, zero or holds a null or non-finite component, and rows without
    an id, take no part. Only vectors of one dimension are compared. Ties go to the smaller id; fewer
    than k candidates are all returned; rows that repeat an id count once, with the least vector.
    Other columns are not read. The index is written to the shared folder before it is searched.
    """
    rows, asked = (valid_vectors(d, id_col, vector_col, allow_zero=False) for d in (df, queries))
    n_rows, n_asked = df.count(), queries.count()
    top = rows.agg(F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v)))).first()[0]
    norm = float(top or 1.0)
    dealt = rows.withColumn("shard", shard_of(max(1, -(-n_rows // shard_rows)))).withColumn("dim", F.size("vec"))
    index = stored(dealt.groupBy("shard", "dim").applyInPandas(lambda part: build_index(part, norm), _INDEX), "vector-graph")

    def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        return search_index(*matrix(left), right.iloc[0], norm, k)

    return best(search(asked, index, max(1, -(-n_asked // QUERY_BLOCK)), find, _FOUND), k)


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 20 = 0"))
