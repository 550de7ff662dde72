import numpy as np
import pytest
from pyspark.sql import types as T

from pagemill.llm import knn

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])


def brute(rows, k=10, every=100):
    good = [(i, v) for (i, _), v in zip(rows, knn.quantised([np.array(x, np.float32).tolist() if x is not None and None not in x else x for _, x in rows])) if i is not None and v is not None]
    out = []
    for q, qv in {i: v for i, v in good if i % every == 0}.items():
        scored = []
        for i, v in good:
            if i != q:
                n = min(len(v), len(qv))
                scored.append((-sum(int(a) * int(b) for a, b in zip(qv[:n], v[:n])), i))
        out += [(q, r + 1, i, max(-knn._LONG, min(knn._LONG, -s))) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def made(seed, n, clusters):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, 8)) * 5
    return [(i, (centres[i % clusters] + rng.normal(size=8) * 0.2).tolist()) for i in range(n)]


@pytest.mark.parametrize("pivots,chunk", [(None, None), (6, 40)])
def test_equals_brute_force(spark, pivots, chunk):
    rows = made(0, 900, 6) + [(1000 + i, [1.0] * 8) for i in range(500)]
    rows += [(2000, None), (2001, [1.0, None]), (2100, [float("nan")] * 8), (2101, [float("inf")] * 8), (2200, []), (2201, [3.0] * 3), (None, [1.0] * 8)]
    rows += [(300, rows[300][1]), (301, rows[301][1])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as x", "2 as cell", "'z' as key")
    got = sorted(tuple(r) for r in knn.top_k(df, pivots=pivots, chunk=chunk).collect())
    assert got == brute(rows)


def test_few_and_huge(spark):
    rows = [(0, [1e17, 1.0]), (1, [1e17, 2.0]), (2, [-1e30, 1.0])]
    got = sorted(tuple(r) for r in knn.top_k(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == brute(rows) and len(got) == 2
    assert knn.top_k(spark.createDataFrame([], SCHEMA)).count() == 0
    assert knn.top_k(spark.createDataFrame([(100, [1.0])], SCHEMA)).count() == 0


def test_copies_of_a_query_are_no_candidates(spark):
    rows = [(100, [10.0, 0.0])] * 11 + [(i, [0.001 * i, 9.0]) for i in range(1, 31)]
    got = sorted(tuple(r) for r in knn.top_k(spark.createDataFrame(rows, SCHEMA).repartition(3), pivots=2).collect())
    assert got == brute(rows) and len(got) == 10


def test_one_id_with_several_vectors_is_answered_by_the_best_of_all(spark):
    rows = [(100, [10.0, 0.0]), (100, [0.0, 9.0]), (100, [10.0, 0.0])] + [(i, [float(i % 5), float(i % 7)]) for i in range(1, 40)]
    got = sorted(tuple(r) for r in knn.top_k(spark.createDataFrame(rows, SCHEMA), pivots=3, chunk=7).collect())
    best = sorted((-(1024 * a * int(1024 * x) + 1024 * b * int(1024 * y)), i) for a, b in ((10, 0), (0, 9)) for i, (x, y) in rows[3:])[:10]
    assert got == [(100, r + 1, i, -s) for r, (s, i) in enumerate(best)]


def test_shuffled_rows_stay_in_proportion(spark):
    """20,000 vectors in several chunks: what moves is the vectors once, and queries and answers a row a chunk."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20000, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    out = knn.top_k(df, chunk=700)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in out.collect()}
    q = np.floor(1024 * x.astype(np.float64)).astype(np.int64)
    for i in range(0, 20000, 100):
        score = q @ q[i]
        score[i] = -(1 << 62)
        for r, j in enumerate(np.lexsort((np.arange(20000), -score))[:10], 1):
            assert got[i, r] == (j, score[j])
    cells = {j: {"n": 300, "queries": 3} for j in range(64)}
    first, several = knn._chunks(cells, rng.normal(size=(64, 3)), 700)
    assert (several == 1).all() and int(first.max()) + 1 <= 2 * 64 * 300 / 700
    n_chunks = -(-20000 // 700)
    assert 20000 + 2 * 200 * 2 * n_chunks <= 3 * 20000


def test_large_cells_have_chunks_of_their_own():
    cells = {0: {"n": 5}, 1: {"n": 2500}, 2: {"n": 6}, 3: {"n": 1}}
    first, several = knn._chunks(cells, np.array([[0], [1], [2], [3]]), 1000)
    assert several.tolist() == [1, 3, 1, 1] and first.tolist() == [0, 1, 4, 4]


def test_an_id_in_several_cells_counts_once():
    centres = np.array([[10000, 0], [9999, 1], [0, 9000]])
    cell = lambda q, of: {"n": 11, "radius": 10.0, "queries": q, "query_radius": 0.0, "query_norm": 10000.0, "near": [0.0] * len(of), "near_ids": of}
    needs = knn._needed([0], {0: cell(11, [100]), 1: cell(0, [100]), 2: cell(0, [1])}, centres, 1)
    assert needs[2] <= 10


def test_bounds_leave_far_cells_out():
    centres = np.array([[0, 9000], [9000, 0], [-9000, 0]])
    cell = lambda q: {"n": 50, "radius": 10.0, "queries": q, "query_radius": 5.0, "query_norm": 9005.0, "near": [1.0] * 11}
    needs = knn._needed([1], {0: cell(0), 1: cell(3), 2: cell(0)}, centres, 10)
    assert needs[1] == 0 and needs[0] > 10 and needs[2] > 10
