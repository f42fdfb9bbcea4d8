"""Feed-forward networks trained in shuffled batches.

An epoch is one pass: every task goes through its rows in batches of ``batch_size``, in an order of its own and
from the same weights, and the weights of all tasks are averaged by rows. They meet in parts, one task per
part, so that no task sees more of them than a part of each. The driver holds one network.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actiscope.operators.layered import layer_moments, matrix
from actiscope.operators.saving import Saver
from actiscope.operators.stopping import StopRule
from actiscope.schema import BATCH_SIZE, EPOCHS, LEARNING_RATE, SEED, STOP_PATIENCE

SHUFFLED_BYTES = 64 << 20
"""Bytes of rows that a task holds and puts in random order."""
TASK_BYTES = 128 << 20
"""Bytes of rows that one task trains on."""
PART = 1 << 20
"""Weights that are averaged together."""
HELD_CELLS = 1 << 20
"""Values of all layers that are held at once where rows are scored."""
LEAST_BATCHES = 16
"""Batches that an epoch has at least: a set of fewer than so many times ``batch_size`` rows is cut into smaller ones."""
# Decay of the running means of gradients and their squares.
MEAN_DECAY, SQUARE_DECAY, TINY = 0.9, 0.999, 1e-8

Layers = list[np.ndarray]  # weights (out, in + 1) of each layer, the bias last


def first_weights(sizes: Sequence[int], seed: int) -> Layers:
    draw = np.random.default_rng(seed)
    return [np.column_stack((draw.normal(size=(b, a)) * np.sqrt(2 / a), np.zeros(b))).astype(np.float32) for a, b in zip(sizes, sizes[1:])]


def forward(layers: Layers, rows: np.ndarray) -> list[np.ndarray]:
    """What goes into each layer, and the class scores."""
    held = [rows]
    for i, w in enumerate(layers):
        out = held[-1] @ w[:, :-1].T + w[:, -1]
        held.append(np.maximum(out, 0) if i + 1 < len(layers) else out)
    return held


def softmax(scores: np.ndarray) -> np.ndarray:
    raised = np.exp(scores - scores.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def class_chances(model: NetworkModel, rows: np.ndarray, kind: type = np.float32) -> np.ndarray:
    """Chances of the classes (row, class), a few rows at a time: what the layers hold of a row can be many times the row."""
    step = max(1, HELD_CELLS // sum(w.shape[0] for w in model.layers))
    parts = [softmax(forward(model.layers, model.scaled(rows[at : at + step]))[-1].astype(kind)) for at in range(0, len(rows), step)]
    return np.concatenate(parts) if parts else np.zeros((0, len(model.layers[-1])), kind)


def losses(p: np.ndarray, labels: np.ndarray) -> np.ndarray:
    return -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12))


def gradients(layers: Layers, rows: np.ndarray, labels: np.ndarray) -> tuple[float, Layers]:
    """Summed loss of the rows, and the gradient of its mean."""
    held = forward(layers, rows)
    p = softmax(held[-1])
    loss = float(losses(p, labels).sum())
    p[np.arange(len(labels)), labels] -= 1
    back, found = p / len(labels), []
    for i in range(len(layers) - 1, -1, -1):
        found.append(np.column_stack((back.T @ held[i], back.sum(axis=0))))
        if i:
            back = (back @ layers[i][:, :-1]) * (held[i] > 0)
    return loss, found[::-1]


class Steps:
    """Gradient steps of a length that follows the running mean and square of each weight's gradient."""

    def __init__(self, layers: Layers, rate: float):
        self.layers, self.rate, self.n = layers, rate, 0
        self.means, self.squares = ([np.zeros_like(w) for w in layers] for _ in range(2))

    def take(self, found: Layers) -> None:
        self.n += 1
        rate = self.rate * np.sqrt(1 - SQUARE_DECAY**self.n) / (1 - MEAN_DECAY**self.n)
        for w, mean, square, g in zip(self.layers, self.means, self.squares, found):
            mean += (1 - MEAN_DECAY) * (g - mean)
            square += (1 - SQUARE_DECAY) * (g * g - square)
            w -= (rate * mean / (np.sqrt(square) + TINY)).astype(np.float32)


@dataclass
class NetworkModel:
    """A trained network over scaled vectors; adds ``probability`` and ``prediction``."""

    layers: Layers
    mean: np.ndarray
    scale: np.ndarray
    inp: str
    training_log: list = field(default_factory=list)

    def scaled(self, rows: np.ndarray) -> np.ndarray:
        return ((rows - self.mean) * self.scale).astype(np.float32)

    def transform(self, df: DataFrame) -> DataFrame:
        def score(v: pa.Array) -> pa.Array:
            k = len(self.layers[-1])
            found = class_chances(self, matrix(v) if len(v) else np.zeros((0, 0)), np.float64)
            return pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, k, dtype=np.int32)), pa.array(found.ravel()))

        made = df.withColumn("_p", F.arrow_udf(score, T.ArrayType(T.DoubleType()))(vector_to_array(self.inp)))
        best = (F.array_position("_p", F.array_max("_p")) - 1).cast("double")
        return made.withColumn("probability", array_to_vector("_p")).withColumn("prediction", best).drop("_p")

    def write(self) -> Saver:
        def save(path: str, mode: str) -> None:
            spark = SparkSession.active()
            parts = [(i, j, w.tolist()) for i, layer in enumerate(self.layers) for j, w in enumerate(layer)]
            spark.createDataFrame(parts, "layer int, unit int, weights array<float>").write.mode(mode).parquet(f"{path}/weights")
            meta = {"mean": self.mean.tolist(), "scale": self.scale.tolist(), "inp": self.inp}
            spark.range(1).select(F.lit(json.dumps(meta)).alias("value")).write.mode(mode).text(f"{path}/input")

        return Saver(save)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NetworkModel:
        meta = json.loads(spark.read.text(f"{path}/input").first()[0])
        layers: dict[int, list] = {}
        for r in spark.read.parquet(f"{path}/weights").orderBy("layer", "unit").collect():
            layers.setdefault(r.layer, []).append(r.weights)
        return cls([np.array(w, np.float32) for _, w in sorted(layers.items())], np.array(meta["mean"]), np.array(meta["scale"]), meta["inp"])


def _epoch(rows: DataFrame, model: NetworkModel, rate: float, batch_size: int, seed: int, epoch: int, tasks: int) -> tuple[Layers, float, int]:
    """Averaged weights, summed loss and rows of one pass."""
    shapes = [w.shape for w in model.layers]
    kind = "part int, loss double, n long, weights binary"

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        draw = np.random.default_rng([seed, epoch, TaskContext.get().partitionId()])
        steps, total, n = Steps([w.copy() for w in model.layers], rate), 0.0, 0
        vectors, labels, held = [], [], 0

        def learn() -> None:
            nonlocal total, n
            x, y = np.concatenate(vectors), np.concatenate(labels)
            order = draw.permutation(len(y))
            for at in range(0, len(y), batch_size):
                some = order[at : at + batch_size]
                loss, found = gradients(steps.layers, x[some], y[some])
                steps.take(found)
                total += loss
            n += len(y)

        for batch in batches:
            if batch.num_rows:
                vectors.append(model.scaled(matrix(batch.column(0))))
                labels.append(batch.column(1).to_numpy())
                held += vectors[-1].nbytes
            if held > SHUFFLED_BYTES:
                learn()
                vectors, labels, held = [], [], 0
        if vectors:
            learn()
        if n:
            flat = np.concatenate([w.ravel() for w in steps.layers]).astype(np.float64) * n
            for part, at in enumerate(range(0, len(flat), PART)):
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "loss": [total], "n": [n], "weights": [flat[at : at + PART].tobytes()]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for one in batch.to_pylist():
                sums = found.setdefault(one["part"], [0.0, 0, 0.0])
                for i, new in enumerate((one["loss"], one["n"], np.frombuffer(one["weights"]))):
                    sums[i] = sums[i] + new
        for part, (loss, n, weights) in found.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "loss": [loss], "n": [n], "weights": [weights.tobytes()]})

    found = rows.mapInArrow(train, kind)
    if tasks > 1:
        n_parts = -(-sum(a * b for a, b in shapes) // PART)
        found = found.repartition(n_parts, "part").mapInArrow(merge, kind)
    parts = sorted(found.collect(), key=lambda r: r.part)
    flat = np.concatenate([np.frombuffer(r.weights) for r in parts]) / parts[0].n
    layers, at = [], 0
    for a, b in shapes:
        layers.append(flat[at : at + a * b].reshape(a, b).astype(np.float32))
        at += a * b
    return layers, parts[0].loss, parts[0].n


def mean_loss(rows: DataFrame, model: NetworkModel) -> float:
    """Mean loss over rows (v, y)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0.0, 0
        for batch in batches:
            if batch.num_rows:
                p = class_chances(model, matrix(batch.column(0)))
                total += float(losses(p, batch.column(1).to_numpy()).sum())
                n += batch.num_rows
        yield pa.RecordBatch.from_pydict({"loss": [total], "n": [n]})

    loss, n = rows.mapInArrow(add, "loss double, n long").agg(F.sum("loss"), F.sum("n")).first()
    return loss / n


def fit_network(
    train: DataFrame,
    widths: Sequence[int],
    inp: str = "features",
    label: str = "label",
    val: DataFrame | None = None,
    epochs: int = EPOCHS,
    batch_size: int = BATCH_SIZE,
    rate: float | None = None,
    patience: int = STOP_PATIENCE,
    n_classes: int | None = None,
    seed: int = SEED,
    tasks: int | None = None,
) -> NetworkModel:
    """A network of the given hidden widths with rectified units, over vectors scaled by the train rows.

    With validation rows the rate is cut on a plateau, fitting stops early and the best epoch's weights come back; its
    ``training_log`` holds rows of (epoch, train_loss, val_loss, rate), the train loss as met during the epoch. Without, all
    epochs are run. Labels are 0, 1, ...; rows with a null vector or label take no part. Rows are dealt at random to
    tasks by their bytes, so each task trains on rows like those of the others.
    """
    select = lambda df: df.where(F.col(inp).isNotNull() & F.col(label).isNotNull()).select(vector_to_array(inp).alias("v"), F.col(label).cast("int").alias("y"))
    moments = layer_moments(train.where(F.col(inp).isNotNull() & F.col(label).isNotNull()), inp, None)
    if not moments:
        raise ValueError("no rows to fit on")
    n, mean, variance = moments[0]
    k = n_classes or int(train.agg(F.max(label)).first()[0]) + 1
    tasks = tasks or max(1, -(-n * len(mean) * 8 // TASK_BYTES))
    batch = max(1, min(batch_size, -(-n // (tasks * LEAST_BATCHES))))
    scale = np.divide(1.0, np.sqrt(variance), out=np.zeros(len(mean)), where=variance > 0)
    model = NetworkModel(first_weights([len(mean), *widths, k], seed), mean, scale, inp)
    watched = val is not None and not val.isEmpty()
    rule, best, log = StopRule(rate=LEARNING_RATE if rate is None else rate, patience=patience), None, []
    rows = select(train).repartition(tasks).persist(StorageLevel.MEMORY_AND_DISK)
    checked = select(val).persist(StorageLevel.MEMORY_AND_DISK) if watched else None
    try:
        for epoch in range(1, epochs + 1):
            now = rule.rate
            model.layers, loss, seen = _epoch(rows, model, now, batch, seed, epoch, tasks)
            log.append((epoch, loss / seen, mean_loss(checked, model) if watched else None, now))
            if watched:
                improved, stop = rule.update(log[-1][2])
                best = model.layers if improved or best is None else best
                if stop:
                    break
    finally:
        rows.unpersist()
        if watched:
            checked.unpersist()
    return NetworkModel(model.layers if best is None else best, mean, scale, inp, log if watched else [])
