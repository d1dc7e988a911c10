"""Exact nearest vectors through cells against comparing everything, and how much the cells rule out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import search, vectorindex
from graphloom.operators.vectorindex import VectorIndex, fit_centroids


def clustered(spark, n=600, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim)) * 5
    rows = [(i, (centres[rng.integers(12)] + rng.normal(size=dim) * 0.3).astype(np.float32).tolist()) for i in range(n)]
    rows += [(10_000 + i, rows[0][1]) for i in range(60)]  # copies: ties beyond k
    return spark.createDataFrame([*rows, (99_999, None)], "id long, embedding array<float>").repartition(4)


def brute(spark, vectors, queries, k):
    out = set()
    for r in queries.collect():
        for place, x in enumerate(search.nearest(vectors.where("embedding is not null"), list(r["embedding"]), k).orderBy("distance", "id").collect(), 1):
            out.add((r["query"], place, x["id"], x["distance"]))
    return out


@pytest.mark.parametrize("k, cells", [(1, None), (7, 5), (25, 40)])
def test_equals_comparing_everything(spark, tmp_path, k, cells):
    vectors = clustered(spark)
    index = VectorIndex.build(vectors, str(tmp_path), cells)
    inside = vectors.where("id % 97 = 0 and embedding is not null").select(F.concat(F.lit("q"), "id").alias("query"), "embedding")
    far = spark.createDataFrame([("far", [100.0] * 8), ("zero", [0.0] * 8)], "query string, embedding array<float>")
    queries = inside.unionByName(far)
    got = {tuple(r) for r in index.search(queries, k).collect()}
    assert got == brute(spark, vectors, queries, k) and len(got) == queries.count() * k
    assert VectorIndex.exists(spark, str(tmp_path)) and not VectorIndex.exists(spark, str(tmp_path / "other"))


def test_most_vectors_are_ruled_out(spark, tmp_path):
    vectors = clustered(spark, 2000)
    queries = vectors.where("id % 50 = 0 and embedding is not null").select(F.col("id").alias("query"), "embedding")
    share = VectorIndex.build(vectors, str(tmp_path)).compared(queries, 5) / (queries.count() * (vectors.count() - 1))
    assert share < 0.1


def test_few_and_no_vectors(spark, tmp_path):
    vectors = clustered(spark)
    some = vectors.where("id < 3")
    queries = some.select(F.col("id").alias("query"), "embedding").unionByName(spark.createDataFrame([(77, None)], "query long, embedding array<float>"))
    got = VectorIndex.build(some, str(tmp_path / "a")).search(queries, 10).collect()
    assert len(got) == 9 and {r["place"] for r in got} == {1, 2, 3} and all(r["distance"] == 0 for r in got if r["query"] == r["id"])
    assert VectorIndex.build(vectors.limit(0), str(tmp_path / "b")).search(queries, 10).collect() == []


def test_small_parts_slots_and_tiles(spark, tmp_path, monkeypatch):
    for name, most in (("MOST_HELD", 40), ("MOST_ASKED", 4), ("TILE", 50)):
        monkeypatch.setattr(vectorindex, name, most)
    vectors = clustered(spark, 300)
    queries = vectors.where("id % 60 = 0 and embedding is not null").select(F.col("id").alias("query"), "embedding")
    got = {tuple(r) for r in VectorIndex.build(vectors, str(tmp_path), 3).search(queries, 7).collect()}
    assert got == brute(spark, vectors, queries, 7)


def test_pairs_by_matrices():
    """All of the k nearest, with their copies, few others, and distances summed in order."""
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(40, 16)) + 1000, rng.normal(size=(900, 16)) + 1000
    b[100:130] = b[7]
    b[200] = a[3]
    exact = np.sqrt(sum((a[:, None, x] - b[None, :, x]) ** 2 for x in range(16)))
    i, j, distance = vectorindex.near_pairs(a, b, np.zeros(40), np.zeros(900), np.full(40, np.inf), 5, 2e-6)
    assert (distance == exact[i, j]).all() and len(i) < 40 * 60
    for q in range(40):
        kth = np.sort(exact[q])[4]
        assert set(np.flatnonzero(exact[q] <= kth + 1e-6)) <= set(j[i == q])


def test_centroids():
    rng = np.random.default_rng(1)
    sample = np.concatenate([rng.normal(size=(50, 3)) + 20 * i for i in range(4)])
    centroids = fit_centroids(sample, 4)
    assert centroids.shape == (4, 3) and np.isfinite(centroids).all()
    assert len(fit_centroids(np.ones((9, 3)), 4)) == 1
