"""Projections of vectors to few dimensions."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoflock.operators import ways
from sonoflock.operators.search import nearest

LEAST_EXPLAINED = 0.95
CAPS = {"pca": None, "umap": 100_000, "tsne": 50_000, "isomap": 15_000}


def available(n: int) -> list[tuple[str, bool | None]]:
    """P10: the platform's limits of size: whether each capped method is out of reach for n points."""
    return [(m, None if cap is None else n > cap) for m, cap in CAPS.items()]


def availability(counts: DataFrame) -> DataFrame:
    """P10 for a table of counts n: one row more for each method, and whether it is out of reach."""
    kinds = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(cap).cast("long").alias("cap")) for m, cap in CAPS.items()])
    each = counts.select("*", F.explode(kinds).alias("m"))
    return each.select(*counts.columns, "m.method", (F.col("n") > F.col("m.cap")).alias("unavailable"))


def moments(vectors: DataFrame, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, sum and sum of outer products; each task adds up its rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 + dim + dim * dim)
        for batch in batches:
            if len(batch):
                x = np.stack(batch["vector"].to_numpy()).astype(np.float64)
                total += np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
        yield pd.DataFrame({"k": np.arange(len(total)), "v": total})

    sums = vectors.select("vector").mapInPandas(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v"))
    out = np.zeros(1 + dim + dim * dim)
    for r in sums.collect():
        out[r.k] = r.v
    return int(out[0]), out[1 : dim + 1], out[dim + 1 :].reshape(dim, dim)


def pca(vectors: DataFrame, dim: int, n_components: int = 50) -> tuple[DataFrame, float]:
    """(snippet_id, vector) along the directions of largest variance of centred vectors, at
    most min(n_components, N - 1, dim) of them, and the share of variance explained. Each
    direction points so that its largest part is positive."""
    n, total, outer = moments(vectors, dim)
    if n < 2:
        raise ValueError("two vectors at least are needed")
    mean = total / n
    values, axes = np.linalg.eigh((outer - n * np.outer(mean, mean)) / (n - 1))
    k = min(n_components, n - 1, dim)
    values, axes = values[::-1], axes[:, ::-1][:, :k]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(k)])
    shared = vectors.sparkSession.sparkContext.broadcast((mean, axes))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mean, axes = shared.value
        for batch in batches:
            if len(batch):
                x = (np.stack(batch["vector"].to_numpy()).astype(np.float64) - mean) @ axes
                yield pd.DataFrame({"snippet_id": batch["snippet_id"], "vector": list(x)})

    explained = float(values[:k].sum() / max(values.sum(), 1e-300))
    if explained < LEAST_EXPLAINED:
        warnings.warn(f"{k} of {dim} directions explain {explained:.1%} of the variance", stacklevel=2)
    return vectors.select("snippet_id", "vector").mapInPandas(run, "snippet_id long, vector array<double>"), explained


def knn_graph(vectors: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """Each vector with itself (distance 0) and its k - 1 nearest others."""
    return nearest(vectors, vectors, k, metric=metric)


def geodesics(graph: DataFrame, landmarks: DataFrame, most_rounds: int = 200) -> DataFrame:
    """For M14: (landmark, snippet_id, d): shortest ways along the graph from some landmarks, by
    rounds of relaxation (see ways.py). The driver sees the ids of the landmarks."""
    names = [r.snippet_id for r in landmarks.select("snippet_id").distinct().collect()]
    if not names:
        return graph.sparkSession.createDataFrame([], "landmark long, snippet_id long, d double")
    points = landmarks.select("snippet_id").unionAll(graph.select("query_id")).unionAll(graph.select("snippet_id")).distinct()
    return ways.shortest(graph, names, points, most_rounds).rows()


def landmark_isomap(vectors: DataFrame, n_neighbors: int = 15, n_landmarks: int = 100, n_components: int = 2, seed: int = 42, graph: DataFrame | None = None) -> DataFrame:
    """(snippet_id, coordinates): geodesic distances to landmarks, classical scaling of the
    landmarks, and every vector placed by its distances to them. A vector that can't be reached
    from a landmark counts as twice the largest distance away. n_landmarks bounds what the
    driver sees: the table of distances between landmarks."""
    order = F.md5(F.concat_ws(":", F.col("snippet_id").cast("string"), F.lit(str(seed))))
    landmarks = [r.snippet_id for r in vectors.select("snippet_id").orderBy(order, "snippet_id").limit(n_landmarks).collect()]
    if not landmarks:
        raise ValueError("a vector at least is needed")
    found = ways.shortest(knn_graph(vectors, n_neighbors) if graph is None else graph, landmarks, vectors.select("snippet_id"))
    square = found.between()
    far = 2 * np.nanmax(square)
    square = np.where(np.isnan(square), far, square) ** 2
    mean = square.mean(axis=0)
    b = -0.5 * (square - mean[None, :] - square.mean(axis=1)[:, None] + square.mean())
    values, axes = np.linalg.eigh((b + b.T) / 2)
    values, axes = values[::-1][:n_components], axes[:, ::-1][:, :n_components]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    pseudo = (axes / np.sqrt(np.maximum(values, 1e-12))).T
    return found.placed(pseudo, mean, far)
