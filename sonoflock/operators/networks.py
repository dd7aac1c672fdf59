"""Networks of any depth and models of bags of instances, trained by Spark aggregates.

A step sends the parameters to all tasks; each adds up the gradient over its rows, the sums of
tasks are added in groups, and the driver takes one step of Adam. What moves is a few copies of
the parameters, however many rows there are.

Which rows make up a minibatch, and which units drop out of it, follows from hashes of the seed,
the step, the row's id and the unit. So training gives the same model however the rows are dealt
out, up to the order of sums, and a task that is run again repeats itself.

For bags (M11) only the label of a bag is known. A bag may be large and lie in many tasks: a first
aggregate adds up what its pooling needs, the slope of the loss by the pooled probability goes
back to the instances by a join, and a second aggregate adds up the gradient.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-6
#: Sums of so many tasks are added in one.
FAN_IN = 64


def hashed(*parts: np.ndarray | int) -> np.ndarray:
    """Well mixed 64-bit numbers from whole numbers."""
    x = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            x = x ^ np.asarray(p).astype(np.int64).astype(np.uint64)
            for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
            x = x ^ (x >> np.uint64(31))
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


@dataclass
class Network:
    """Dense layers with ReLU between them, one logistic output for each label; the last hidden
    layer's activations are the features. No hidden layer: a linear model."""

    labels: list[str]
    layers: list[tuple[np.ndarray, np.ndarray]]
    losses: list[float] = field(default_factory=list)

    @staticmethod
    def new(labels: list[str], dim: int, hidden: tuple[int, ...], seed: int = 42) -> Network:
        rng, sizes = np.random.default_rng(seed), [dim, *hidden, len(labels)]
        return Network(labels, [(rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)])

    def features(self, x: np.ndarray) -> np.ndarray:
        for w, b in self.layers[:-1]:
            x = np.maximum(x @ w + b, 0)
        return x

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        w, b = self.layers[-1]
        return sigmoid(self.features(x) @ w + b)

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for layer in self.layers for a in layer])

    def like(self, theta: np.ndarray) -> Network:
        layers, at = [], 0
        for w, b in self.layers:
            layers.append((theta[at : at + w.size].reshape(w.shape), theta[at + w.size : at + w.size + b.size]))
            at += w.size + b.size
        return Network(self.labels, layers, self.losses)

    def forward(self, x: np.ndarray, ids: np.ndarray, dropout: float, seed: int, step: int) -> tuple[np.ndarray, list, list]:
        """Outputs, with the inputs of each layer and the masks of the hidden ones."""
        inputs, masks = [x], []
        for depth, (w, b) in enumerate(self.layers[:-1]):
            h = np.maximum(inputs[-1] @ w + b, 0)
            mask = (h > 0).astype(float)
            if dropout:
                units = hashed(seed, step, depth, ids[:, None], np.arange(len(b))[None, :])
                mask *= (units >> np.uint64(11)).astype(float) / (1 << 53) >= dropout
                mask /= 1 - dropout
                h = h * (mask > 0) / (1 - dropout)
            inputs.append(h)
            masks.append(mask)
        w, b = self.layers[-1]
        return sigmoid(inputs[-1] @ w + b), inputs, masks

    def backward(self, g: np.ndarray, inputs: list, masks: list) -> np.ndarray:
        """The gradient of all parameters, where g is that of the outputs before the sigmoid."""
        out: list[np.ndarray] = []
        for depth in range(len(self.layers) - 1, -1, -1):
            w, _ = self.layers[depth]
            out = [(inputs[depth].T @ g).ravel(), g.sum(axis=0), *out]
            if depth:
                g = (g @ w.T) * masks[depth - 1]
        return np.concatenate(out)


def added(rows: DataFrame, sums_of: Callable[[pd.DataFrame], np.ndarray | None]) -> np.ndarray | None:
    """The sum over all batches of rows of the vectors that sums_of gives (None: nothing)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, first = None, 0
        for batch in batches:
            part = sums_of(batch) if len(batch) else None
            if part is not None:
                first = int(batch.iloc[0, 0]) if total is None else first
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"k": [first], "v": [total.tobytes()]})

    def join(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [0], "v": [sum(np.frombuffer(x) for x in group.sort_values("k")["v"]).tobytes()]})

    parts = rows.mapInPandas(run, "k long, v binary")
    parts = parts.groupBy(F.pmod(F.xxhash64("k"), F.lit(FAN_IN)).alias("g")).applyInPandas(join, "k long, v binary")
    found = [np.frombuffer(r.v) for r in parts.collect()]  # FAN_IN at most
    return sum(found) if found else None


class Adam:
    def __init__(self, size: int, rate: float):
        self.rate, self.step, self.m, self.v = rate, 0, np.zeros(size), np.zeros(size)

    def change(self, g: np.ndarray) -> np.ndarray:
        self.step += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        return self.rate * (self.m / (1 - 0.9**self.step)) / (np.sqrt(self.v / (1 - 0.999**self.step)) + 1e-8)


def stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def weigh_positives(rows: DataFrame, labels: list[str]) -> np.ndarray:
    """V12 for each label, by one aggregate: clean rows for each positive one."""
    counts = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.array_contains("labels", x), 1)).alias(f"c{k}") for k, x in enumerate(labels)]).first()
    pos = np.array([counts[f"c{k}"] for k in range(len(labels))], float)
    return np.where(pos > 0, (counts.n - pos) / np.maximum(pos, 1), 1.0)


def gradient(model: Network, batch: pd.DataFrame, weight: np.ndarray, dropout: float = 0.0, seed: int = 42, step: int = 0) -> np.ndarray:
    """Gradient, loss and number of rows (snippet_id, vector, y), as one vector of sums."""
    x, y, ids = stacked(batch["vector"]), stacked(batch["y"]), batch["snippet_id"].to_numpy(np.int64)
    p, inputs, masks = model.forward(x, ids, dropout, seed, step)
    loss = -(weight * y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12)).sum() / y.shape[1]
    g = np.where(y > 0, weight * (p - 1), p) / y.shape[1]
    return np.concatenate([model.backward(g, inputs, masks), [loss, len(x)]])


def fit(
    rows: DataFrame,
    labels: list[str],
    dim: int,
    hidden: tuple[int, ...] = (512, 256, 128),
    epochs: int = 5,
    batches: int = 4,
    dropout: float = 0.3,
    rate: float = 0.001,
    seed: int = 42,
    weighted: bool = True,
) -> Network:
    """M6, M7, M10 from rows (snippet_id, vector, labels): every epoch goes once through all rows,
    in `batches` minibatches that a hash deals anew. losses: the mean over each epoch."""
    y = F.array(*[F.array_contains("labels", x).cast("double") for x in labels])
    data = rows.select(F.col("snippet_id").cast("long").alias("snippet_id"), F.col("vector").cast("array<double>").alias("vector"), y.alias("y")).persist()
    weight = weigh_positives(rows, labels) if weighted else np.ones(len(labels))
    model = Network.new(labels, dim, hidden, seed)
    theta = model.flat()
    adam = Adam(len(theta), rate)
    for epoch in range(epochs):
        loss = seen = 0.0
        for part in range(batches):
            mine = F.pmod(F.xxhash64("snippet_id", F.lit(seed), F.lit(epoch)), F.lit(batches)) == part
            held = rows.sparkSession.sparkContext.broadcast(model.like(theta))
            total = added(data.where(mine), lambda b, held=held, s=adam.step: gradient(held.value, b, weight, dropout, seed, s))
            held.unpersist()
            if total is not None:
                theta = theta - adam.change(total[:-2] / total[-1])
                loss, seen = loss + total[-2], seen + total[-1]
        model.losses.append(loss / max(seen, 1.0))
    data.unpersist()
    return model.like(theta)


# --- bags of instances -------------------------------------------------------------------------

POOLINGS = ("max", "avg", "exp", "lin")


def pooled(pooling: str) -> tuple[list[Column], Column]:
    """A17 in two steps: the sums over instances (columns s0, s1 and n), and the pooled
    probability by them."""
    p = F.col("p")
    sums = {"max": (F.max(p), F.lit(0.0)), "avg": (F.sum(p), F.lit(0.0)), "exp": (F.sum(p * F.exp(p)), F.sum(F.exp(p))), "lin": (F.sum(p * p), F.sum(p))}
    s0, s1, n = F.col("s0"), F.col("s1"), F.col("n")
    value = {"max": s0, "avg": s0 / n, "exp": s0 / s1, "lin": s0 / (s1 + 1e-8)}[pooling]
    return [c.alias(x) for c, x in zip(sums[pooling], ("s0", "s1"), strict=True)] + [F.count(F.lit(1)).alias("n")], value


def slope(pooling: str) -> Column:
    """The pooled probability's slope by one instance's p. Of equal largest ones each has its part."""
    p, s0, s1, n, q = (F.col(c) for c in ("p", "s0", "s1", "n", "q"))
    return {
        "max": F.when(p == s0, 1 / F.col("at_top")).otherwise(0.0),
        "avg": 1 / n,
        "exp": F.exp(p) * (1 + p - q) / s1,
        "lin": (2 * p - q) / (s1 + 1e-8),
    }[pooling]


def bag_gradient(instances: DataFrame, bags: DataFrame, w: np.ndarray, b: float, pooling: str = "lin", weight: float = 1.0) -> np.ndarray:
    """Gradient by w and b, then the loss, of a linear instance model, as means over all bags.
    instances: (bag, vector); bags: (bag, y), which of them are positive."""
    held = instances.sparkSession.sparkContext.broadcast((w, b))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, b = held.value
        for batch in batches:
            if len(batch):
                yield batch.assign(p=sigmoid(stacked(batch["vector"]) @ w + b))

    scored = instances.select("bag", "vector").mapInPandas(score, "bag long, vector array<double>, p double")
    sums, value = pooled(pooling)
    q, y = F.col("q"), F.col("y")
    whole = scored.groupBy("bag").agg(*sums).join(bags, "bag").withColumn("q", value)
    if pooling == "max":
        top = scored.join(whole.select("bag", "s0"), "bag").where(F.col("p") == F.col("s0")).groupBy("bag").agg(F.count(F.lit(1)).alias("at_top"))
        whole = whole.join(top, "bag")
    # the loss is that of the logit of q within EPS and 1 - EPS, so it has no slope beyond them
    inside = q.between(EPS, 1 - EPS)
    safe = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), q))
    whole = whole.withColumn("dq", F.when(inside, (1 - y) / (1 - safe) - weight * y / safe).otherwise(0.0))
    loss = whole.agg(F.count(F.lit(1)).alias("n"), F.sum(-(weight * y * F.ln(safe) + (1 - y) * F.ln(1 - safe))).alias("loss")).first()
    if not loss.n:
        return np.zeros(len(w) + 2)
    back = scored.join(whole, "bag").select("bag", "vector", (F.col("dq") * slope(pooling) * F.col("p") * (1 - F.col("p"))).alias("g"))

    def total(batch: pd.DataFrame) -> np.ndarray:
        g = batch["g"].to_numpy()
        return np.append(stacked(batch["vector"]).T @ g, g.sum())

    return np.append(added(back, total), loss.loss) / loss.n


def fit_bags(instances: DataFrame, bags: DataFrame, label: str, dim: int, pooling: str = "lin", steps: int = 20, rate: float = 0.1) -> Network:
    """A linear instance model from the labels of bags."""
    instances, bags = instances.persist(), bags.select("bag", F.col("y").cast("double").alias("y")).persist()
    count = bags.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")).first()
    weight = (count.n - count.pos) / count.pos if count.pos else 1.0
    theta, adam, losses = np.zeros(dim + 1), Adam(dim + 1, rate), []
    for _ in range(steps):
        g = bag_gradient(instances, bags, theta[:-1], float(theta[-1]), pooling, weight)
        losses.append(float(g[-1]))
        theta = theta - adam.change(g[:-1])
    instances.unpersist()
    bags.unpersist()
    return Network([label], [(theta[:-1, None], theta[-1:])], losses)
