import math

import numpy as np
import pytest

from tidewell.llm import ann, exact_topk
from tidewell.llm.common import table

SCHEMA = "vec_id long, embedding array<double>, shard int, dim int, block int"


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rng = np.random.default_rng(5)
    common = rng.normal(size=8).tolist()
    rows = [(i, common if i % 3 == 0 else rng.normal(size=8).tolist()) for i in range(200)]
    rows += [(300, None), (301, []), (302, [None] * 8), (303, [math.nan] * 8), (304, [math.inf] * 8), (305, [0.0] * 8), (None, common), (20, common), (320, [1.0, 2.0])]
    return spark.createDataFrame([(*r, 0, 0, 0) for r in rows], SCHEMA)


def brute(rows, measure, k=20):
    kept = {}
    for i, v in rows:
        kept[i] = min(kept.get(i, v), v)
    out = {}
    for q, a in kept.items():
        if q % 20 == 0:
            scored = sorted((-measure(a, b), i) for i, b in kept.items() if i != q and len(a) == len(b))[:k]
            out.update({(q, r + 1): (i, -s) for r, (s, i) in enumerate(scored)})
    return out


def usable(df, *, zero):
    return [(r.vec_id, r.embedding) for r in df.collect() if r.vec_id is not None and r.embedding and all(x is not None and math.isfinite(x) for x in r.embedding) and (zero or any(r.embedding))]


def test_exact_search_on_odd_rows(odd_vectors):
    whole = lambda v: [math.floor(64 * x) for x in v]
    got = exact_topk.exact_top_k(odd_vectors, odd_vectors.where("vec_id % 20 = 0"), shard_rows=64).collect()
    want = brute([(i, whole(v)) for i, v in usable(odd_vectors, zero=True)], lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)))
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got} == want
    assert exact_topk.exact_top_k(odd_vectors.limit(0), odd_vectors.limit(0)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(1)
    q, x = np.floor(64 * rng.normal(size=(20, 30))), np.floor(64 * rng.normal(size=(50, 30)))
    for n in (1, 4, 16, 30):
        bound = exact_topk.product_bounds(exact_topk.segment_statistics(q, n), exact_topk.segment_statistics(x, n), (q * q).sum(1), (x * x).sum(1))
        assert (bound >= q @ x.T - 1e-6).all()


def test_products_beyond_double_precision():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(60, 6)) * 2**28)
    got = exact_topk.top_products(np.arange(5), x[:5], np.arange(60), x, 8)
    for i in range(5):
        scored = sorted((-sum(int(a) * int(b) for a, b in zip(x[i], x[j], strict=True)), j) for j in range(60) if j != i)[:8]
        assert [(-int(s), int(j)) for q, j, s in zip(*got, strict=True) if q == i] == scored


def test_graph_search_on_odd_rows(odd_vectors):
    got = ann.nearest(odd_vectors, odd_vectors.where("vec_id % 20 = 0"), shard_rows=128).collect()
    want = brute(usable(odd_vectors, zero=False), lambda a, b: float(np.dot(a, b)))
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got}
    assert set(found) == set(want)
    hits = sum(found[k][0] in {v[0] for j, v in want.items() if j[0] == k[0]} for k in found)
    assert hits >= 0.95 * len(want)
    assert ann.nearest(odd_vectors.limit(0), odd_vectors.limit(0)).count() == 0


def test_recall_of_the_graph(spark, sf_dir):
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in table(spark, sf_dir, "embeddings").collect()]
    ids, x = np.array([r[0] for r in rows]), np.stack([r[1] for r in rows])
    found = {}
    for r in ann.op6_ann(spark, sf_dir).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
        a, b = x[ids == r.query_id][0], x[ids == r.vec_id][0]
        assert abs(r.score - a @ b) < 1e-12
    recall = []
    for q, got in found.items():
        scores = x @ x[ids == q][0]
        scores[ids == q] = -np.inf
        recall.append(len(got & set(ids[np.argsort(-scores)[:20]].tolist())) / min(20, len(ids) - 1))
    assert np.mean(recall) >= 0.9


def test_pruning_keeps_diverse_edges():
    line = np.array([[0.0], [1.0], [1.1], [-1.0]], np.float32)
    kept = ann.robust_prune(line, np.array([0]), np.array([[1, 2, 3, -1]]), 1.2)[0]
    assert set(kept[kept >= 0].tolist()) == {1, 3}
