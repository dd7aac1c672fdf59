"""Shortest ways from landmarks against all ways by brute force, and what they leave on disk."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoflock.operators import reduce, ways
from sonoflock.plans.shared import shared_folder

GRAPH = "query_id long, snippet_id long, distance double"


def brute(n, edges):
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0)
    for a, b, w in edges:
        d[a, b] = d[b, a] = min(d[a, b], w)
    for k in range(n):
        d = np.minimum(d, d[:, [k]] + d[[k], :])
    return d


def test_ways_over_many_blocks_and_parts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    n = 60  # the last five points have no way to the others
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 55, 150), rng.integers(0, 55, 150), rng.integers(0, 9, 150), strict=True)]
    edges += [(a, a, 0.0) for a in range(n)] + [(57, 58, 2.0), (58, 57, 1.0)]
    d = brute(n, [e for e in edges if e[0] != e[1]])
    monkeypatch.setattr(ways, "GROUP", 3)
    monkeypatch.setattr(ways, "CHUNK", 5)
    landmarks = [1, 8, 20, 33, 40, 54, 57]
    graph = spark.createDataFrame([(1000 * a, 1000 * b, w) for a, b, w in edges], GRAPH)
    points = spark.range(n).select((F.col("id") * 1000).alias("snippet_id"))
    found = ways.shortest(graph, [1000 * x for x in landmarks], points, block=8)
    assert found.points.count() > 4 and len(found.parts) == 3
    got = {(r.landmark, r.snippet_id): r.d for r in found.rows().collect()}
    assert got == {(1000 * x, 1000 * y): d[x, y] for x in landmarks for y in range(n) if np.isfinite(d[x, y])}
    square = d[np.ix_(landmarks, landmarks)]
    assert np.array_equal(found.between(), np.where(np.isfinite(square), square, np.nan), equal_nan=True)
    pseudo, mean = rng.normal(size=(2, 7)), rng.normal(size=7)
    want = -0.5 * (np.where(np.isfinite(d), d, 99)[:, landmarks] ** 2 - mean) @ pseudo.T
    rows = {r.snippet_id: r.coordinates for r in found.placed(pseudo, mean, 99.0).collect()}
    assert len(rows) == n and np.allclose([rows[1000 * y] for y in range(n)], want)


def test_disk_does_not_follow_the_rounds(spark):
    folder = shared_folder(spark).removeprefix("file://")
    checkpoints = lambda: {d for top, dirs, _ in os.walk(folder) for d in dirs if d.startswith(("rdd-", "ways-"))}
    before = checkpoints()
    graph = spark.createDataFrame([(k, (k + 1) % 24, 1.0) for k in range(24)], GRAPH)
    got = reduce.geodesics(graph, spark.createDataFrame([(0,)], "snippet_id long"))
    assert len(checkpoints() - before) == 1  # the last round's alone, of 13
    assert {r.snippet_id: r.d for r in got.collect()} == {k: float(min(k, 24 - k)) for k in range(24)}


def test_vectors_that_no_landmark_reaches_are_placed(spark):
    shared_folder(spark)
    rows = spark.createDataFrame([(k, [float(k), 0.0]) for k in range(8)], "snippet_id long, vector array<double>")
    graph = spark.createDataFrame([(k, k + 1, 1.0) for k in (0, 1, 2, 4, 5, 6)], GRAPH)
    got = reduce.landmark_isomap(rows, n_landmarks=3, graph=graph, seed=1).collect()
    assert sorted(r.snippet_id for r in got) == list(range(8)) and all(np.isfinite(r.coordinates).all() for r in got)
    alone = reduce.landmark_isomap(rows, n_landmarks=2, n_components=1, graph=graph.where("query_id < 3"), seed=1).collect()
    assert sorted(r.snippet_id for r in alone) == list(range(8))


def test_a_graph_of_other_points_is_an_error(spark):
    shared_folder(spark)
    graph = spark.createDataFrame([(0, 1, 1.0), (1, 9, 1.0)], GRAPH)
    with pytest.raises(Exception, match="aren't among those given"):
        ways.shortest(graph, [0], spark.createDataFrame([(0,), (1,)], "snippet_id long"))
