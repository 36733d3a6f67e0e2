"""Classifier (M1-M4): ordered split, network fit with an L2 penalty and Adam, warm starts, prediction.

The network is tiny (features -> three hidden layers of that width -> classes), so its weights are the only state on the driver.
The training rows are packed once into binary blocks; a gradient step is one pass in which every task sums the
loss and gradient of its blocks, and one row of that size per group of tasks comes back.  Prediction is a projection with
the weights as literals: no Python, no join.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postcred.schemas import FEATURES, KEY
from postcred.session import scratch_dir

MAX_TEST_SHARE = 0.40
BLOCK_ROWS, FAN_IN = 65_536, 64
#: Slope of a hidden unit below zero: layers as narrow as the features must not lose their units for good.
LEAK = 0.1


def dense_index(df: DataFrame, order_cols: Sequence[str] = KEY, out: str = "row_index") -> DataFrame:
    """0-based position of every row in ``order_cols`` order, without a single-partition window.

    Range-partition + sort within partitions and write the rows with their partition's number and their place in it, so both passes
    see the same contents and executor loss cannot reshuffle them; count rows per partition (one small row
    per partition to the driver) and add the partition's offset to the place.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
    tagged = ranged.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    path = scratch_dir(spark, "ordered")
    tagged.write.parquet(path)
    tagged = spark.read.schema(tagged.schema).parquet(path)
    counts = dict(tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).select("_pid", "n").collect())
    n_parts = max(counts.keys(), default=-1) + 1
    offsets, acc = [], 0
    for p in range(n_parts):
        offsets.append(acc)
        acc += counts.get(p, 0)
    off = F.get(F.array(*[F.lit(o).cast("long") for o in offsets] or [F.lit(0).cast("long")]), F.col("_pid"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return tagged.withColumn(out, off + local).drop("_pid", "_mid")


def ordered_split(df: DataFrame, test_share: float, order_cols: Sequence[str] = KEY,
                  out: str = "split") -> DataFrame:
    """M1: un-shuffled split; the last ``ceil(test_share * n)`` rows in key order are ``test``.

    ``test_share`` must be below 40 % (the reference refuses larger shares).
    """
    if not 0.0 <= test_share < MAX_TEST_SHARE:
        raise ValueError("the test share must be below 40 %")
    indexed = dense_index(df, order_cols)
    n = indexed.count()
    n_train = n - int(math.ceil(test_share * n))
    return indexed.withColumn(out, F.when(F.col("row_index") < n_train, "train").otherwise("test"))


# ------------------------------------------------------------------------------------- the network
@dataclass
class Network:
    """Weights of a multilayer network with leaky ReLU hidden layers and a softmax output."""
    layers: list[int]
    weights: list[np.ndarray]          # one (inputs x outputs) matrix per layer
    biases: list[np.ndarray]
    steps: int = 0
    losses: list[float] = field(default_factory=list)
    converged: bool = False

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for w, b in zip(self.weights, self.biases) for p in (w, b)])

    def with_flat(self, flat: np.ndarray) -> "Network":
        weights, biases, at = [], [], 0
        for a, b in zip(self.layers, self.layers[1:]):
            weights.append(flat[at:at + a * b].reshape(a, b).copy())
            biases.append(flat[at + a * b:at + a * b + b].copy())
            at += a * b + b
        return Network(self.layers, weights, biases, self.steps, self.losses, self.converged)

    def to_json(self) -> str:
        return json.dumps({"layers": self.layers, "flat": self.flat().tolist(), "steps": self.steps, "losses": self.losses[-1:], "converged": self.converged})

    @staticmethod
    def from_json(text: str) -> "Network":
        d = json.loads(text)
        empty = Network(d["layers"], [], [], d["steps"], d["losses"], d["converged"])
        return empty.with_flat(np.array(d["flat"], float))


def new_network(n_features: int, n_classes: int, hidden: int = 3, seed: int = 21) -> Network:
    """Three hidden layers as wide as the feature count; start weights uniform within sqrt(6 / (inputs + outputs)), biases not below zero
    (a narrow layer whose units all start off would never learn)."""
    layers = [n_features] + [n_features] * hidden + [n_classes]
    rng = np.random.RandomState(seed)
    weights, biases = [], []
    for a, b in zip(layers, layers[1:]):
        bound = math.sqrt(6.0 / (a + b))
        weights.append(rng.uniform(-bound, bound, (a, b)))
        biases.append(rng.uniform(0, bound, b))
    return Network(layers, weights, biases)


def loss_and_gradient(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed cross entropy of the rows and its gradient, in the order of ``Network.flat`` (no penalty, not divided)."""
    acts = [x]
    for i, (w, b) in enumerate(zip(net.weights, net.biases)):
        z = acts[-1] @ w + b
        acts.append(np.maximum(z, LEAK * z) if i + 1 < len(net.weights) else z)
    z = acts[-1] - acts[-1].max(axis=1, keepdims=True)
    logp = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    loss = -float(logp[np.arange(len(y)), y].sum())
    delta = np.exp(logp)
    delta[np.arange(len(y)), y] -= 1
    grads: list[np.ndarray] = []
    for i in range(len(net.weights) - 1, -1, -1):
        grads = [(acts[i].T @ delta).ravel(), delta.sum(axis=0)] + grads
        if i:
            delta = (delta @ net.weights[i].T) * np.where(acts[i] > 0, 1.0, LEAK)
    return loss, np.concatenate(grads)


def penalty(net: Network, l2: float, n: int) -> tuple[float, np.ndarray]:
    """The L2 term of the mean loss, over matrices only, and its gradient."""
    parts = [p for w, b in zip(net.weights, net.biases) for p in ((l2 / n * w).ravel(), np.zeros(len(b)))]
    return 0.5 * l2 / n * sum(float((w * w).sum()) for w in net.weights), np.concatenate(parts)


class TrainingRows:
    """Training rows packed into blocks (features and class as doubles), dealt into ``batches`` by a hash of the row."""

    def __init__(self, df: DataFrame, cols: Sequence[str], label: str, batches: int = 1):
        self.width, self.batches = len(cols) + 1, batches
        batch = F.pmod(F.xxhash64(*cols, label), F.lit(batches)).cast("int") if batches > 1 else F.lit(0)
        good = df.where(F.col(label).isNotNull()).select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)],
                                                         F.col(label).cast("double").alias("y"), batch.alias("batch"))

        def run(parts):
            held: dict[int, list[np.ndarray]] = {}
            for b in parts:
                rows = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns - 1)], axis=1)
                which = b.column(b.num_columns - 1).to_numpy()
                for k in np.unique(which):
                    held.setdefault(int(k), []).append(rows[which == k])
                    if sum(map(len, held[int(k)])) >= BLOCK_ROWS:
                        yield _block_row(int(k), held.pop(int(k)))
            for k, rows in held.items():
                yield _block_row(k, rows)
        path = scratch_dir(df.sparkSession, "train-blocks")
        good.mapInArrow(run, "batch int, n long, data binary").write.parquet(path)
        self.blocks = df.sparkSession.read.schema("batch int, n long, data binary").parquet(path).persist()
        self.sizes = {r["batch"]: r["n"] for r in self.blocks.groupBy("batch").agg(F.sum("n").alias("n")).collect()}  # one row per batch

    def sums(self, net: Network, batch: int) -> tuple[float, np.ndarray]:
        """Loss and gradient over one batch: a row per task, merged in groups before the driver adds the rest."""
        width, size = self.width, len(net.flat()) + 1

        def run(parts):
            from pyspark import TaskContext
            acc = np.zeros(size)
            for b in parts:
                for data in b.column(0):
                    rows = np.frombuffer(data.as_py()).reshape(-1, width)
                    loss, grad = loss_and_gradient(net, rows[:, :-1], rows[:, -1].astype(int))
                    acc[0] += loss
                    acc[1:] += grad
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() // FAN_IN], pa.int64()), pa.array([acc.tobytes()], pa.binary())], ["g", "acc"])

        def merged(table: pa.Table) -> pa.Table:
            acc = sum(np.frombuffer(a.as_py()) for a in table.column("acc"))
            return pa.table({"g": table.column("g").slice(0, 1), "acc": pa.array([acc.tobytes()], pa.binary())})

        part = self.blocks if self.batches == 1 else self.blocks.where(F.col("batch") == batch)
        rows = part.select("data").mapInArrow(run, "g long, acc binary")
        if self.blocks.rdd.getNumPartitions() > FAN_IN:
            rows = rows.groupBy("g").applyInArrow(merged, "g long, acc binary")
        total = np.zeros(size)
        for r in sorted(rows.collect(), key=lambda r: r["g"]):
            total = total + np.frombuffer(r["acc"])
        return float(total[0]), total[1:]

    def release(self) -> None:
        self.blocks.unpersist()


def _block_row(batch: int, rows: list[np.ndarray]) -> pa.RecordBatch:
    data = np.concatenate(rows)
    return pa.RecordBatch.from_arrays([pa.array([batch], pa.int32()), pa.array([len(data)], pa.int64()), pa.array([data.tobytes()], pa.binary())], ["batch", "n", "data"])


def mlp_fit(train: DataFrame, n_classes: int, cols: Sequence[str] = FEATURES, label: str = "label", max_iter: int = 500,
            tol: float = 1e-8, seed: int = 21, initial: Network | None = None, l2: float = 0.001, rate: float = 0.02,
            batches: int = 1, patience: int = 10) -> Network:
    """M2: Adam on the mean cross entropy with an L2 penalty, ``max_iter`` passes over the training rows.

    A pass takes ``batches`` steps, each on the rows of one hash class.  It stops once ``patience`` passes in a row have not bettered the
    best loss by ``tol``.  ``initial`` continues from earlier weights.  Without rows the start weights come back.
    """
    net = initial or new_network(len(cols), n_classes, seed=seed)
    rows = TrainingRows(train, cols, label, batches)
    n = sum(rows.sizes.values())
    if not n:
        rows.release()
        return net
    flat = net.flat()
    mean, var, step = np.zeros_like(flat), np.zeros_like(flat), 0
    losses: list[float] = []
    best, stalled, done = math.inf, 0, False
    for _ in range(max_iter):
        total = 0.0
        for k in sorted(rows.sizes):
            size = rows.sizes[k]
            loss, grad = rows.sums(net, k)
            cost, pull = penalty(net, l2, size)
            total += loss + cost * size
            grad = grad / size + pull
            step += 1
            mean += 0.1 * (grad - mean)
            var += 0.001 * (grad * grad - var)
            flat = flat - rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(var / (1 - 0.999 ** step)) + 1e-8)
            net = net.with_flat(flat)
        losses.append(total / n)
        stalled = stalled + 1 if losses[-1] > best - tol else 0
        best = min(best, losses[-1])
        if stalled >= patience:
            done = True
            break
    rows.release()
    net.steps, net.losses, net.converged = net.steps + step, losses, done
    return net


def mlp_fit_incremental(batches: Iterable[DataFrame], n_classes: int, cols: Sequence[str] = FEATURES,
                        label: str = "label", max_iter_per_batch: int = 20, seed: int = 21,
                        model: Network | None = None, **options) -> Network | None:
    """M3: train batch after batch, each fit continuing from the previous weights."""
    for b in batches:
        model = mlp_fit(b, n_classes, cols, label, max_iter=max_iter_per_batch, seed=seed, initial=model, **options)
    return model


def _layer(net: Network, i: int, values: Sequence[Column]) -> list[Column]:
    w, b = net.weights[i], net.biases[i]
    out = [sum((v * F.lit(float(w[j, k])) for j, v in enumerate(values)), F.lit(float(b[k]))) for k in range(w.shape[1])]
    return out if i + 1 == len(net.weights) else [F.greatest(z, z * F.lit(LEAK)) for z in out]


def mlp_predict(model: Network, df: DataFrame, cols: Sequence[str] = FEATURES, out: str = "predicted",
                scores: str | None = None) -> DataFrame:
    """M4: predicted class per row (columns of ``df`` kept); the first of equal scores.  A null feature gives a null class.

    Each layer is one array column, so its values are computed once.
    """
    d, values = df, [F.col(f"`{c}`").cast("double") for c in cols]
    for i in range(len(model.weights)):
        d = d.withColumn(f"_layer{i}", F.array(*_layer(model, i, values)))
        values = [F.get(f"_layer{i}", F.lit(k)) for k in range(model.layers[i + 1])]
    last = f"_layer{len(model.weights) - 1}"
    known = F.when(~F.exists(last, lambda v: v.isNull()), F.array_position(last, F.array_max(last)) - 1).cast("int")
    return d.select(*[F.col(f"`{c}`") for c in df.columns], known.alias(out), *([F.col(last).alias(scores)] if scores else []))
