"""Stored vector tiles against all cosines."""

import numpy as np
import pytest

from corpusloom.operators.vector import vector_topk
from corpusloom.operators.vector_index import build_index, indexed_topk, open_index


def answers(df):
    return [(r.query_id, r["rank"], r.uri, round(r.score, 9)) for r in df.orderBy("query_id", "rank").collect()]


def frames(spark, vectors, queries):
    vec = spark.createDataFrame([(f"v{i % (len(vectors) - 50):05d}", v.tolist()) for i, v in enumerate(vectors)], "uri string, vector array<double>")
    return vec, spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(queries)], "query_id long, vector array<double>")


def test_clustered_vectors_leave_most_tiles_unread(spark, place):
    rng = np.random.default_rng(3)
    # A third of all vectors in one cluster, many copies of one vector, some zeros.
    middles = rng.normal(size=(40, 16))
    which = np.where(rng.random(3000) < 1 / 3, 0, rng.integers(0, 40, 3000))
    vectors = middles[which] + 0.05 * rng.normal(size=(3000, 16))
    vectors[100:160] = vectors[100]
    vectors[200:205] = 0
    queries = np.vstack([middles[:6] + 0.02 * rng.normal(size=(6, 16)), vectors[100], np.zeros(16), -middles[0]])
    vec, que = frames(spark, vectors, queries)
    build_index(vec, f"{place}/index", tile_vectors=40)
    index, opened = open_index(spark, f"{place}/index"), []
    assert answers(indexed_topk(index, que, 7, tile_queries=3, opened=opened)) == answers(vector_topk(que, vec, 7))
    read, possible = opened[0]
    assert read < possible / 2


def test_vectors_without_clusters_and_more_wanted_than_held(spark, place):
    rng = np.random.default_rng(4)
    vec, que = frames(spark, rng.normal(size=(300, 8)), rng.normal(size=(5, 8)))
    build_index(vec, f"{place}/index", tile_vectors=30)
    index = open_index(spark, f"{place}/index")
    for k in (3, 1000):
        assert answers(indexed_topk(index, que, k)) == answers(vector_topk(que, vec, k))


@pytest.mark.parametrize("empty", ["vectors", "queries"])
def test_nothing_to_search(spark, place, empty):
    rows = [("a", [1.0, 0.0]), ("b", None), ("c", [float("nan"), 1.0]), ("d", [])]
    vec = spark.createDataFrame(rows[1:] if empty == "vectors" else rows, "uri string, vector array<double>")
    que = spark.createDataFrame([(1, None if empty == "queries" else [1.0, 0.5])], "query_id long, vector array<double>")
    build_index(vec, f"{place}/index")
    assert indexed_topk(open_index(spark, f"{place}/index"), que, 3).count() == 0
