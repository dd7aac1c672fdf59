"""Preparing training rows, and fitting and applying multi-label models.

A model is small (labels x dimensions), so its gradient steps run as Spark aggregates: each
task sums gradients over its rows in numpy, the sums are added up, and one step is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonoflock.plans.shared import materialise


def align(vectors: DataFrame, truth: DataFrame) -> DataFrame:
    """Vectors with the labels of all events of their file by name, else by path, in
    order. Truth has a row (key, labels) for each event: an event without labels makes its file a
    negative, with no labels; NULL stands for a file without events, which is no match, and as its
    name is there, its path isn't looked up. Files that nothing matches are left out."""
    each = truth.select("key", F.col("labels").isNotNull().alias("_event"), F.explode_outer("labels").alias("_label"))
    # labels are made distinct before they are gathered
    files = each.groupBy("key").agg(F.bool_or("_event").alias("_any"), F.array_sort(F.collect_set("_label")).alias("_all"))
    files = files.select("key", F.when(F.col("_any"), F.col("_all")).alias("labels"), F.lit(True).alias("_there"))
    by_name = files.select(F.col("key").alias("file_name"), F.col("labels").alias("_by_name"), "_there")
    by_path = files.select(F.col("key").alias("file_path"), F.col("labels").alias("_by_path"))
    out = vectors.join(by_name, "file_name", "left").join(by_path, "file_path", "left")
    labels = F.when(F.col("_there"), F.col("_by_name")).otherwise(F.col("_by_path"))
    return out.withColumn("labels", labels).drop("_by_name", "_by_path", "_there").where("labels is not null")


def training_rows(vectors: DataFrame, truth: DataFrame) -> DataFrame:
    """M3: align(), as a table; it is an error if nothing matches."""
    out = materialise(align(vectors, truth), "aligned")
    if out.isEmpty():
        raise ValueError("no vector has a file that the ground truth names")
    return out


def class_support(rows: DataFrame) -> DataFrame:
    """A10: rows of each label."""
    return rows.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("support"))


def filter_classes(rows: DataFrame, least: int, negatives: bool = True, none: str = "None") -> DataFrame:
    """M4, M5: labels with enough rows are kept, rows left without a label go; confirmed
    negatives are put back, without labels, if any label is kept."""
    is_negative = rows["labels"] == F.array(F.lit(none))
    positives = rows.where(~is_negative)
    kept = class_support(positives).where(F.col("support") >= least).agg(F.collect_set("label").alias("_kept"))
    # one row with the vocabulary of labels; Spark decides by its size how it is joined
    filtered = positives.crossJoin(kept).withColumn("labels", F.array_intersect("labels", "_kept"))
    filtered = filtered.where(F.size("labels") > 0).drop("_kept")
    if not negatives:
        return filtered
    back = rows.where(is_negative).crossJoin(kept).where(F.size("_kept") > 0).drop("_kept")
    return filtered.unionByName(back.withColumn("labels", F.array().cast("array<string>")))


def cap_classes(rows: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """M5: going through rows in a seeded order, a row is taken if any of its labels has been
    taken fewer than `most` times. The first `most` rows of each label are all taken, and after
    them the label is full; so the rows taken are those among the first `most` of some label."""
    order = F.md5(F.concat_ws(":", F.col("snippet_id").cast("string"), F.lit(str(seed))))
    ranked = rows.withColumn("_order", order)
    exploded = ranked.select("snippet_id", "_order", F.explode("labels").alias("_label"))
    early = exploded.withColumn("_r", F.row_number().over(Window.partitionBy("_label").orderBy("_order", "snippet_id")))
    taken = early.where(F.col("_r") <= most).select("snippet_id").distinct()
    return ranked.join(taken, "snippet_id", "left_semi").drop("_order")


@dataclass
class Linear:
    """Independent logistic regressions, one for each label."""

    labels: list[str]
    weights: np.ndarray
    bias: np.ndarray
    losses: list[float]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -50, 50)))


def summed(rows: DataFrame, sums_of, size: int) -> np.ndarray:
    """The sum over all rows of the vectors that sums_of gives for each batch of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for batch in batches:
            if len(batch):
                total += sums_of(np.stack(batch["vector"].to_numpy()).astype(np.float64), np.stack(batch["y"].to_numpy()).astype(np.float64))
        yield pd.DataFrame({"k": np.arange(size), "v": total})

    parts = rows.mapInPandas(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v"))
    out = np.zeros(size)
    for r in parts.collect():
        out[r.k] = r.v
    return out


def targets(rows: DataFrame, labels: list[str]) -> DataFrame:
    y = F.array(*[F.array_contains("labels", x).cast("double") for x in labels])
    return rows.select(F.col("vector").cast("array<double>").alias("vector"), y.alias("y"))


def fit_linear(rows: DataFrame, labels: list[str], dim: int, steps: int = 30, rate: float = 0.5) -> Linear:
    """Weighted cross-entropy by Adam over the whole table; positives weigh as much as
    negatives in each label."""
    data = targets(rows, labels).persist()
    k = len(labels)
    count = summed(data, lambda x, y: np.append(y.sum(axis=0), len(y)), k + 1)
    pos, n = count[:k], max(count[k], 1)
    weight = np.where(pos > 0, (n - pos) / np.maximum(pos, 1), 1.0)
    w, b, losses = np.zeros((dim, k)), np.zeros(k), []
    m, v = np.zeros((dim + 1) * k), np.zeros((dim + 1) * k)
    for step in range(1, steps + 1):

        def gradient(x: np.ndarray, y: np.ndarray, w=w, b=b) -> np.ndarray:
            p = 1 / (1 + np.exp(-np.clip(x @ w + b, -50, 50)))
            g = np.where(y > 0, weight * (p - 1), p)
            loss = -(weight * y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12)).sum()
            return np.concatenate([(x.T @ g).ravel(), g.sum(axis=0), [loss]])

        total = summed(data, gradient, (dim + 1) * k + 1) / n
        losses.append(float(total[-1] / k))
        m = 0.9 * m + 0.1 * total[:-1]
        v = 0.99 * v + 0.01 * total[:-1] ** 2
        change = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - change[: dim * k].reshape(dim, k), b - change[dim * k :]
    data.unpersist()
    return Linear(labels, w, b, losses)


@dataclass
class Mlp:
    """One hidden layer with ReLU; its activations are the features."""

    labels: list[str]
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    losses: list[float]

    def features(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(x) @ self.w2 + self.b2, -50, 50)))


def fit_mlp(rows: DataFrame, labels: list[str], dim: int, hidden: int = 32, steps: int = 40, rate: float = 0.05, seed: int = 42) -> Mlp:
    """M7, M10"""
    data = targets(rows, labels).persist()
    rng, k = np.random.default_rng(seed), len(labels)
    shapes = [(dim, hidden), (hidden,), (hidden, k), (k,)]
    theta = [rng.normal(0, np.sqrt(2 / dim), shapes[0]), np.zeros(hidden), rng.normal(0, np.sqrt(2 / hidden), shapes[2]), np.zeros(k)]
    cuts = np.cumsum([int(np.prod(s)) for s in shapes])
    m, v, losses = np.zeros(cuts[-1]), np.zeros(cuts[-1]), []
    n = max(data.count(), 1)
    for step in range(1, steps + 1):

        def gradient(x: np.ndarray, y: np.ndarray, theta=theta) -> np.ndarray:
            w1, b1, w2, b2 = theta
            h = np.maximum(x @ w1 + b1, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ w2 + b2, -50, 50)))
            g = p - y
            gh = (g @ w2.T) * (h > 0)
            loss = -(y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12)).sum()
            return np.concatenate([(x.T @ gh).ravel(), gh.sum(axis=0), (h.T @ g).ravel(), g.sum(axis=0), [loss]])

        total = summed(data, gradient, int(cuts[-1]) + 1) / n
        losses.append(float(total[-1] / k))
        m = 0.9 * m + 0.1 * total[:-1]
        v = 0.99 * v + 0.01 * total[:-1] ** 2
        change = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        theta = [a - c.reshape(s) for a, c, s in zip(theta, np.split(change, cuts[:-1]), shapes, strict=True)]
    data.unpersist()
    return Mlp(labels, *theta, losses)


def apply_model(vectors: DataFrame, model: Linear | Mlp) -> DataFrame:
    """M8: (snippet_id, probs) by batches."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["vector"].to_numpy()).astype(np.float64)
                yield pd.DataFrame({"snippet_id": batch["snippet_id"], "p": list(shared.value.probabilities(x))})

    rows = vectors.select("snippet_id", "vector").mapInPandas(run, "snippet_id long, p array<double>")
    return rows.select("snippet_id", F.map_from_arrays(F.array(*map(F.lit, model.labels)), "p").alias("probs"))
