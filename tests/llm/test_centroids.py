"""Operator 13: centroid clustering."""

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import centroids, queries

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def rows(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_op13(spark):
    vectors = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert rows(queries.QUERIES["op13_centroids"](spark, SMALL)) == sorted(brute.clusters(vectors), key=str)


def test_edges(spark):
    """Missing and non-finite components, other lengths, missing and repeated keys, ties, few rows, clashing names."""
    rng = np.random.default_rng(2)
    grid = [(i, [float(x) for x in rng.integers(-1, 2, 64)]) for i in range(40)]
    odd = [
        (100, None), (101, []), (102, [0.5] * 63), (103, [0.5] * 63 + [None]), (104, [0.5] * 63 + [float("nan")]),
        (105, [0.5] * 63 + [float("-inf")]), (None, [0.25] * 64), (None, [0.25] * 64), (7, [0.25] * 64), (8, [-0.01] * 64),
    ]
    schema = "vec_id bigint, embedding array<float>"
    for table in (grid + odd, grid[:3], odd[:6], []):
        df = spark.createDataFrame(table, schema).selectExpr("*", "1 AS cluster", "2L AS distance", "'x' AS h", "3 AS __id")
        want = brute.clusters([(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in table])
        assert rows(centroids.cluster_vectors(df)) == sorted(want, key=str)


def test_too_large_components_fail(spark):
    df = spark.createDataFrame([(1, [1e30] * 64)], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster_vectors(df).collect()


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 12), st.integers(0, 60), st.integers(1, 3))
def test_orchard_is_exact_with_ties(seed, k, n, spread):
    rng = np.random.default_rng(seed)
    x, centers = rng.integers(-spread, spread + 1, (n, 3)), rng.integers(-spread, spread + 1, (k, 3))
    best, distance, compared = centroids.orchard(x, centers)
    every = ((x[:, None] - centers[None]) ** 2).sum(2)
    assert (best == every.argmin(1)).all() and (distance == every.min(1, initial=10**9)).all()
    assert n <= compared <= max(n * k, n)


def test_orchard_leaves_far_centroids_out():
    rng = np.random.default_rng(0)
    centers = rng.integers(0, 10_000, (32, 2))
    x = centers[rng.integers(0, 32, 500)] + rng.integers(-5, 6, (500, 2))
    assert centroids.orchard(x, centers)[2] < 500 * 32 / 2
