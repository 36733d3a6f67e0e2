"""The network: gradients by finite differences, the penalty, one Adam step by hand, batches, prediction, warm starts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from postcred.operators import classify as MC


def rows(n=90, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        c = i % 3
        out.append((f"p{i:03d}", float(c * 2 + rng.normal(0, 0.3)), float((c == 1) * 2 + rng.normal(0, 0.3)), c))
    return out


def frame(spark, data, parts=4):
    return spark.createDataFrame(data, "k string, a double, b double, label int").repartition(parts)


def plain_loss(net, x, y, l2=0.0):
    h = x
    for i, (w, b) in enumerate(zip(net.weights, net.biases)):
        h = np.array([[sum(v * w[j, k] for j, v in enumerate(r)) + b[k] for k in range(w.shape[1])] for r in h])
        if i + 1 < len(net.weights):
            h = np.maximum(h, MC.LEAK * h)
    p = np.exp(h) / np.exp(h).sum(axis=1, keepdims=True)
    mean = -np.mean([math.log(p[i, c]) for i, c in enumerate(y)])
    return mean + 0.5 * l2 / len(y) * sum((w * w).sum() for w in net.weights)


def test_gradient_equals_finite_differences(spark):
    data = rows(30)
    x, y = np.array([[r[1], r[2]] for r in data]), np.array([r[3] for r in data])
    net, l2 = MC.new_network(2, 3, seed=4), 0.7
    blocks = MC.TrainingRows(frame(spark, data), ["a", "b"], "label")
    loss, grad = blocks.sums(net, 0)
    cost, pull = MC.penalty(net, l2, len(data))
    assert loss / len(data) + cost == pytest.approx(plain_loss(net, x, y, l2), rel=1e-9)
    flat, grad = net.flat(), grad / len(data) + pull
    for i in range(len(flat)):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        slope = (plain_loss(net.with_flat(up), x, y, l2) - plain_loss(net.with_flat(down), x, y, l2)) / 2e-6
        assert grad[i] == pytest.approx(slope, rel=1e-4, abs=1e-7)


def test_one_adam_step_by_hand(spark):
    data = rows(24)
    net = MC.new_network(2, 3, seed=5)
    x, y = np.array([[r[1], r[2]] for r in data]), np.array([r[3] for r in data])
    _, grad = MC.loss_and_gradient(net, x, y)
    _, pull = MC.penalty(net, 0.001, len(data))
    g = grad / len(data) + pull
    want = net.flat() - 0.02 * g / (np.abs(g) + 1e-8)
    got = MC.mlp_fit(frame(spark, data), 3, ["a", "b"], max_iter=1, seed=5)
    assert np.abs(got.flat() - want).max() < 1e-9 and got.steps == 1


def test_penalty_shrinks_the_weights(spark):
    df = frame(spark, rows())
    loose = MC.mlp_fit(df, 3, ["a", "b"], max_iter=60, l2=0.0)
    tight = MC.mlp_fit(df, 3, ["a", "b"], max_iter=60, l2=50.0)
    assert sum((w * w).sum() for w in tight.weights) < 0.7 * sum((w * w).sum() for w in loose.weights)


@pytest.mark.parametrize("batches", [1, 3])
def test_learns_and_predicts_like_the_forward_pass(spark, batches, monkeypatch):
    monkeypatch.setattr(MC, "FAN_IN", 2)
    monkeypatch.setattr(MC, "BLOCK_ROWS", 7)
    data = rows()
    df = frame(spark, data)
    net = MC.mlp_fit(df, 3, ["a", "b"], max_iter=150, batches=batches, seed=22)
    assert net.losses[-1] < net.losses[0] / 2 and net.steps == batches * len(net.losses)
    got = {r["k"]: r for r in MC.mlp_predict(net, df, ["a", "b"], scores="s").collect()}
    right = 0
    for k, a, b, c in data:
        h = np.array([a, b])
        for i, (w, bias) in enumerate(zip(net.weights, net.biases)):
            h = h @ w + bias
            if i + 1 < len(net.weights):
                h = np.maximum(h, MC.LEAK * h)
        assert got[k]["s"] == pytest.approx(list(h), rel=1e-9) and got[k]["predicted"] == int(np.argmax(h))
        right += got[k]["predicted"] == c
    assert right > 0.9 * len(data)


def test_warm_start_goes_on_and_null_rows_are_skipped(spark):
    df = frame(spark, rows() + [("null", 1.0, 1.0, None)])
    first = MC.mlp_fit(df, 3, ["a", "b"], max_iter=10)
    more = MC.mlp_fit_incremental([df.where(F.col("label") < 2), df], 3, ["a", "b"], max_iter_per_batch=10, model=first)
    assert more.steps == 30 and not np.allclose(more.flat(), first.flat())
    empty = MC.mlp_fit(df.limit(0), 3, ["a", "b"])
    assert np.array_equal(empty.flat(), MC.new_network(2, 3, seed=21).flat())
    odd = MC.mlp_predict(first, spark.createDataFrame([(None, 1.0)], "a double, b double"), ["a", "b"]).first()
    assert odd["predicted"] is None


def test_stops_when_the_loss_no_longer_falls(spark):
    data = [("p", 1.0, 1.0, 0)] * 20
    net = MC.mlp_fit(frame(spark, data), 1, ["a", "b"], max_iter=200, l2=0.0)
    assert net.converged and len(net.losses) < 30


def test_json_round_trip():
    net = MC.new_network(5, 3, seed=9)
    back = MC.Network.from_json(net.to_json())
    assert np.array_equal(back.flat(), net.flat()) and back.layers == net.layers
