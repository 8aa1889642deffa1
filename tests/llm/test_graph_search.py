import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import graph_search
from driftline.llm.graph_search import nearest

ROWS = "vec_id long, embedding array<float>, score string"


def brute(rows, k, query):
    """Exact answers over distinct usable rows."""
    good = {(i, tuple(v)) for i, v, _ in rows if i is not None and v is not None and len(v)
            and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in good:
        if query(i):
            near = sorted((-float(np.dot(np.float64(v), np.float64(w))), j)
                          for j, w in good if j != i and len(w) == len(v))
            out[i] = [j for _, j in near[:k]]
    return out


def found(frame):
    out, ranks = {}, {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.vec_id)
        ranks.setdefault(r.query_id, []).append(r.rank)
    assert all(v == list(range(1, len(v) + 1)) for v in ranks.values())
    return out


def test_small_tables_equal_brute_force_with_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(1)
    vectors = rng.integers(-3, 4, size=(60, 4)).astype(float)
    rows = [(i, v.tolist(), None) for i, v in enumerate(vectors)]
    rows += [(100 + i, [1.0, 2.0, 0.0, 1.0], "copy") for i in range(80)]
    rows += [(200, None, None), (201, [], None), (202, [0.0] * 4, None), (None, [1.0] * 4, None),
             (203, [1.0, None, 2.0, 3.0], None), (204, [float("nan")] * 4, None),
             (205, [float("inf"), 1.0, 1.0, 1.0], None), (0, vectors[0].tolist(), "again"),
             (220, [1.0, 2.0], None), (221, [2.0, 1.0], None)]
    frame = spark.createDataFrame(rows, ROWS)
    got = nearest(frame, F.col("vec_id") % 20 == 0, k=7, shard_rows=30, block_rows=3)
    want = brute(rows, 7, lambda i: i % 20 == 0)
    assert found(got) == want
    for r in got.collect():
        assert r.vec_id != r.query_id


def test_recall_over_several_shards(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 32))
    vectors = (centres[rng.integers(0, 20, 3000)] + 0.6 * rng.normal(size=(3000, 32))).astype(
        np.float32)
    vectors[::3][:300] = vectors[0]  # a hot vector
    rows = [(i, v.tolist(), None) for i, v in enumerate(vectors)]
    got = found(nearest(spark.createDataFrame(rows, ROWS), F.col("vec_id") % 50 == 0,
                        shard_rows=1000))
    want = brute(rows, 20, lambda i: i % 50 == 0)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) > 0.95


@pytest.mark.parametrize("kind", ["clusters", "clusters of many lengths", "normal", "directions"])
def test_recall_in_one_shard_for_all_kinds_of_vectors(kind):
    """Production settings; full shards of 16,384 have the figures in the README."""
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(5000, 64))
    if "clusters" in kind:
        vectors = 0.5 * vectors + rng.normal(size=(60, 64))[rng.integers(0, 60, 5000)]
    if kind != "normal":
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    if "lengths" in kind:
        vectors *= rng.uniform(0.5, 2, size=(5000, 1))
    edges, start = graph_search.build_graph(vectors, 32, 64, 1.2)
    ids = np.arange(5000)
    asked = ids[::50]
    found = {i: set() for i in asked}
    for query, i, _ in graph_search.search_shard(
            vectors, edges, start, ids, np.arange(5001), vectors[asked], asked, 20, 160):
        found[query].add(i)
    scores = vectors[asked] @ vectors.T
    scores[np.arange(100), asked] = -np.inf
    want = np.argsort(-scores, axis=1)[:, :20]
    assert np.mean([len(found[q] & set(w.tolist())) / 20 for q, w in zip(asked, want)]) > 0.95


def test_many_query_blocks(spark):
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist(), None) for i, v in enumerate(rng.normal(size=(700, 8)))]
    got = found(nearest(spark.createDataFrame(rows, ROWS), F.col("vec_id") % 2 == 0, k=5,
                        shard_rows=200, block_rows=10))
    want = brute(rows, 5, lambda i: i % 2 == 0)
    assert got.keys() == want.keys()
    assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) > 0.98


def test_pruning_keeps_near_and_diverse_points():
    points = np.array([[0.0, 0], [1, 0], [1.1, 0], [0, 2], [0, -9]], np.float32)
    kept = graph_search.robust_prune(points, np.array([0]), np.array([[1, 2, 3, 4, 0, -1]]), 4, 1.2)
    assert kept.tolist() == [[1, 3, 4, -1]]


@pytest.mark.parametrize("rows,want", [([], {}), ([(0, [1.0], None)], {}),
                                       ([(0, [1.0], None), (1, [2.0], None)], {0: [1]})])
def test_few_rows(spark, rows, want):
    assert found(nearest(spark.createDataFrame(rows, ROWS), F.col("vec_id") % 20 == 0)) == want
