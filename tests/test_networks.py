"""Deep networks and models of bags, against plain numpy."""

import numpy as np
import pandas as pd
import pytest

from sonoflock.operators import networks as N
from sonoflock.operators import training


def rows_of(spark, x, labels, parts=3):
    rows = [(k * 7, list(map(float, v)), ls) for k, (v, ls) in enumerate(zip(x, labels, strict=True))]
    return spark.createDataFrame(rows, "snippet_id long, vector array<double>, labels array<string>").repartition(parts)


@pytest.mark.parametrize("dropout", [0.0, 0.4])
def test_gradients_equal_differences(dropout):
    rng = np.random.default_rng(1)
    model = N.Network.new(["a", "b"], 5, (7, 4, 3), 3)
    # no unit just at 0, and no output where the loss is cut off
    model = model.like(0.5 * model.flat() + 0.1 * rng.normal(size=len(model.flat())))
    batch = pd.DataFrame({"snippet_id": range(20), "vector": list(rng.normal(size=(20, 5))), "y": list((rng.random((20, 2)) < 0.4).astype(float))})
    weight = np.array([2.0, 0.5])
    got, theta = N.gradient(model, batch, weight, dropout, 9, 2), model.flat()
    assert got[-1] == 20
    for k in rng.choice(len(theta), 25, replace=False):
        up, down = theta.copy(), theta.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        want = (N.gradient(model.like(up), batch, weight, dropout, 9, 2)[-2] - N.gradient(model.like(down), batch, weight, dropout, 9, 2)[-2]) / 2e-6
        assert abs(want - got[k]) < 1e-5


def test_dropout_drops_its_share():
    model = N.Network.new(["a"], 4, (400,), 1)
    x = np.abs(np.random.default_rng(2).normal(size=(50, 4)))
    _, inputs, _ = model.forward(x, np.arange(50), 0.3, 1, 0)
    alive = model.features(x) > 0
    assert abs((inputs[1][alive] == 0).mean() - 0.3) < 0.02
    assert np.allclose(inputs[1][inputs[1] > 0], (model.features(x) / 0.7)[inputs[1] > 0])
    again = model.forward(x, np.arange(50), 0.3, 1, 1)[1][1]
    assert ((inputs[1] == 0) != (again == 0)).any()


def test_deep_networks_learn_and_dont_depend_on_partitions(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6))
    labels = [[n for n, on in (("in", (v[:2] ** 2).sum() < 1.5), ("up", v[2] * v[3] > 0)) if on] for v in x]
    args = dict(labels=["in", "up"], dim=6, hidden=(64, 32, 16), epochs=12, batches=3, dropout=0.1, rate=0.01)
    a, b = N.fit(rows_of(spark, x, labels), **args), N.fit(rows_of(spark, x, labels, 7), **args)
    assert np.allclose(a.flat(), b.flat(), atol=1e-6)
    assert a.losses[-1] < 0.6 * a.losses[0]
    out = training.apply_model(rows_of(spark, x, labels), a)
    right = [(r.probs[n] >= 0.5) == (n in labels[r.snippet_id // 7]) for r in out.collect() for n in ("in", "up")]
    assert np.mean(right) > 0.85
    assert a.features(x).shape == (300, 16)
    assert [w.shape for w, _ in N.Network.new(["x"], 10, (512, 256, 128)).layers] == [(10, 512), (512, 256), (256, 128), (128, 1)]
    assert N.fit(rows_of(spark, x, labels).limit(0), **(args | {"epochs": 1})).losses == [0.0]


def pool(p, kind):
    return {"max": p.max(), "avg": p.mean(), "exp": (p * np.exp(p)).sum() / np.exp(p).sum(), "lin": (p * p).sum() / (p.sum() + 1e-8)}[kind]


@pytest.mark.parametrize("kind", N.POOLINGS)
def test_bags_across_tasks(spark, kind):
    rng = np.random.default_rng(4)
    sizes = [1, 2, 5, 200, 3]
    x = [rng.normal(size=(n, 4)) for n in sizes]
    x[2][1] = x[2][0]
    y = np.array([1.0, 0, 1, 1, 0])
    rows = [(k, list(map(float, v))) for k, bag in enumerate(x) for v in bag]
    instances = spark.createDataFrame(rows, "bag long, vector array<double>").repartition(6)
    bags = spark.createDataFrame([(k, float(v)) for k, v in enumerate(y)], "bag long, y double")
    w, b = rng.normal(size=4), 0.3

    def loss(theta):
        q = np.array([pool(N.sigmoid(v @ theta[:-1] + theta[-1]), kind) for v in x])
        return -(1.5 * y * np.log(q) + (1 - y) * np.log(1 - q)).mean()

    got = N.bag_gradient(instances, bags, w, b, kind, 1.5)
    theta = np.append(w, b)
    assert abs(got[-1] - loss(theta)) < 1e-9
    for k in range(5):
        up, down = theta.copy(), theta.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        assert abs((loss(up) - loss(down)) / 2e-6 - got[k]) < 1e-5


def test_instances_are_learned_from_bags(spark):
    rng = np.random.default_rng(5)
    rows, y = [], []
    for bag in range(60):
        on = bag % 2
        for k in range(6):
            v = rng.normal(size=3) + (np.array([4.0, 0, 0]) if on and k == 0 else np.array([-1.0, 0, 0]))
            rows.append((bag, list(map(float, v))))
        y.append((bag, on))
    instances = spark.createDataFrame(rows, "bag long, vector array<double>").repartition(4)
    model = N.fit_bags(instances, spark.createDataFrame(y, "bag long, y int"), "bird", 3, steps=15, rate=0.3)
    assert model.losses[-1] < 0.5 * model.losses[0]
    p = model.probabilities(np.array([r[1] for r in rows]))[:, 0]
    first = np.array([k % 12 == 6 for k in range(len(rows))])
    assert p[first].mean() > 0.8 and p[~first].mean() < 0.3
    assert N.bag_gradient(instances.limit(0), spark.createDataFrame([], "bag long, y double"), np.zeros(3), 0.0).tolist() == [0] * 5
