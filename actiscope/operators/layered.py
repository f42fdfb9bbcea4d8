"""Models of all layers fitted together.

A pass over the rows adds up, per layer, what each layer's model needs next, so records are read once per
pass and not once per layer. What a pass brings to the driver is one array per layer, of the size of its model.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from actiscope.operators.features import PcaModel, without_empty
from actiscope.operators.saving import Saver
from actiscope.schema import PCA_DIM, SEED

SUM_BYTES = 256 << 20
"""Bytes of sums that a task holds at once; more layers than that take turns."""
SPARE = 10
"""Directions of a sketch beyond the components asked for."""
HISTORY = 10
"""Steps from which a solver guesses the curvature."""
TOLERANCE = 1e-6


def layer_moments(df: DataFrame, inp: str, layer: str | None) -> dict:
    """(rows, mean, population variance) of the vectors of each layer, from one scan."""
    key = F.lit(0) if layer is None else F.col(layer)
    found = df.groupBy(key.alias("layer")).agg(F.count(F.lit(1)).alias("n"), Summarizer.metrics("mean", "variance").summary(F.col(inp)).alias("s"))
    return {r.layer: (r.n, r.s.mean.toArray(), r.s.variance.toArray() * (r.n - 1) / r.n if r.n > 1 else np.zeros(r.s.mean.size)) for r in found.collect()}


def _rows(df: DataFrame, inp: str, layer: str | None, label: str | None = None) -> DataFrame:
    key = F.lit(0) if layer is None else F.col(layer)
    return df.select(key.alias("layer"), vector_to_array(inp).alias("v"), (F.lit(None) if label is None else F.col(label)).cast("int").alias("y"))


def matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(lists), -1)


def _summed(rows: DataFrame, add: Callable[[object, np.ndarray, np.ndarray], np.ndarray]) -> dict:
    """Per layer, the sum of ``add(layer, vectors, labels)`` over batches of its rows. Sums meet in one task per layer, one after the other."""
    kind = T.StructType([rows.schema["layer"], T.StructField("sums", T.BinaryType())])

    arrow = to_arrow_schema(kind)

    def record(found: dict) -> Iterator[pa.RecordBatch]:
        for layer, sums in found.items():
            yield pa.RecordBatch.from_pydict({"layer": [layer], "sums": [sums.tobytes()]}, schema=arrow)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            layers, vectors = np.array(batch.column(0).to_pylist()), matrix(batch.column(1))
            labels = batch.column(2).fill_null(0).to_numpy()
            for one in np.unique(layers):
                mine = layers == one
                new = add(one.item(), vectors[mine], labels[mine])
                if new is not None:
                    found[one.item()] = found[one.item()] + new if one.item() in found else new
        yield from record(found)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in batches:
            for layer, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found[layer] = found[layer] + np.frombuffer(sums) if layer in found else np.frombuffer(sums)
        yield from record(found)

    parts = rows.mapInArrow(partial, kind).repartition("layer").mapInArrow(merge, kind)
    return {r.layer: np.frombuffer(r.sums) for r in parts.collect()}


def _turns(layers: list, size: int) -> Iterator[list]:
    """Layers in groups whose sums, of ``size`` values each, fit a task."""
    step = max(1, SUM_BYTES // (8 * size))
    for at in range(0, len(layers), step):
        yield layers[at : at + step]


@dataclass(frozen=True)
class LayeredPca:
    """Components of each layer, applied to the rows of that layer; rows of other layers get null."""

    models: dict
    layer: str
    inp: str
    out: str

    def transform(self, df: DataFrame) -> DataFrame:
        turns = {k: (m.mean, m.components.T) for k, m in self.models.items()}
        return df.withColumn(self.out, array_to_vector(_by_layer(lambda k, rows: (rows - turns[k][0]) @ turns[k][1], turns)(F.col(self.layer), vector_to_array(self.inp)))) if turns else df


def _by_layer(work: Callable[[object, np.ndarray], np.ndarray], known) -> Callable:
    """Arrow function of (layer, vector): ``work`` on the rows of each known layer, null elsewhere."""
    known = set(known)

    def run(layers: pa.Array, vectors: pa.Array) -> pa.Array:
        keys, out = layers.to_pylist(), [None] * len(layers)
        for k in set(keys) & known:
            at = [i for i, key in enumerate(keys) if key == k]
            for i, row in zip(at, work(k, matrix(vectors.take(pa.array(at))))):
                out[i] = row
        return pa.array(out, pa.list_(pa.float64()))

    return F.arrow_udf(run, T.ArrayType(T.DoubleType()))


def fit_pca_layers(
    df: DataFrame, k: int = PCA_DIM, inp: str = "features", out: str = "pca", layer: str | None = "layer_index", spare: int = SPARE, power: int = 1, seed: int = SEED
) -> LayeredPca:
    """First ``k`` components of each layer from sketches of ``k + spare`` directions.

    The covariance meets random directions, what comes out is made orthogonal and meets it again (``power`` times), and
    the components are those of the covariance within the directions that are left. Tasks and driver hold
    length x (k + spare) values a layer, never length x length. A sketch as wide as the vectors is exact.
    """
    moments = layer_moments(df, inp, layer)
    if not moments:
        raise ValueError("no vectors to sum")
    d = len(next(iter(moments.values()))[1])
    width, kept = min(d, k + spare), min(k, d)
    rows, models = _rows(df, inp, layer), {}
    for some in _turns(sorted(moments), d * width):
        axes = {one: np.linalg.qr(np.random.default_rng([seed, i]).normal(size=(d, width)))[0] for i, one in enumerate(some)}
        means = {one: moments[one][1] for one in some}
        part = rows.where(F.col("layer").isin(some)) if len(some) < len(moments) else rows
        for turn in range(power + 2):
            held = dict(axes)

            def meet(one, vectors, _, held=held) -> np.ndarray | None:
                if one not in held:
                    return None
                centred = vectors - means[one]
                return centred.T @ (centred @ held[one])

            sums = {one: s.reshape(d, width) / moments[one][0] for one, s in _summed(part, meet).items()}
            if turn <= power:
                axes = {one: np.linalg.qr(s)[0] for one, s in sums.items()}
        for one in some:
            inner = axes[one].T @ sums[one]
            variances, turned = np.linalg.eigh((inner + inner.T) / 2)
            order = np.argsort(-variances, kind="stable")[:kept]
            components = (axes[one] @ turned[:, order]).T
            peaks = np.abs(components).argmax(axis=1)
            components *= np.where(components[np.arange(kept), peaks] < 0, -1.0, 1.0)[:, None]
            found = np.maximum(variances[order], 0.0)
            rest = max(0.0, float(moments[one][2].sum()) - float(found.sum()))
            models[one] = PcaModel(means[one], without_empty(components, found), np.append(found, rest), inp, out)
    return LayeredPca(models, layer or "layer_index", inp, out)


def fit_pca_sketch(df: DataFrame, k: int = PCA_DIM, inp: str = "features", out: str = "pca", **options) -> PcaModel:
    """Components of all rows as one, by the same sketches."""
    return fit_pca_layers(df, k, inp, out, None, **options).models[0]


@dataclass(frozen=True)
class LinearModel:
    """Class scores of scaled vectors; adds ``probability`` and ``prediction``."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    inp: str

    def chances(self, rows: np.ndarray) -> np.ndarray:
        scores = (rows - self.mean) * self.scale @ self.weights.T + self.bias
        raised = np.exp(scores - scores.max(axis=1, keepdims=True))
        return raised / raised.sum(axis=1, keepdims=True)

    def transform(self, df: DataFrame) -> DataFrame:
        return _with_chances(df, _by_layer(lambda _, rows: self.chances(rows), [0])(F.lit(0), vector_to_array(self.inp)))

    def write(self) -> Saver:
        def save(path: str, mode: str) -> None:
            parts = {"inp": self.inp} | {n: getattr(self, n).tolist() for n in ("mean", "scale", "weights", "bias")}
            SparkSession.active().range(1).select(F.lit(json.dumps(parts)).alias("value")).write.mode(mode).text(path)

        return Saver(save)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LinearModel:
        parts = json.loads(spark.read.text(path).first()[0])
        return cls(*(np.array(parts[n]) for n in ("mean", "scale", "weights", "bias")), parts["inp"])


def _with_chances(df: DataFrame, chances) -> DataFrame:
    best = (F.array_position("_p", F.array_max("_p")) - 1).cast("double")
    return df.withColumn("_p", chances).withColumn("probability", array_to_vector("_p")).withColumn("prediction", best).drop("_p")


@dataclass(frozen=True)
class LayeredModel:
    """One linear model per layer, each for the rows of its layer."""

    models: dict
    layer: str
    inp: str

    def transform(self, df: DataFrame) -> DataFrame:
        models = self.models
        return _with_chances(df, _by_layer(lambda k, rows: models[k].chances(rows), models)(F.col(self.layer), vector_to_array(self.inp)))


@dataclass
class Descent:
    """State of one solver: limited-memory quasi-Newton steps with halving, one value and gradient at a time."""

    x: np.ndarray
    most: int
    value: float | None = None
    gradient: np.ndarray | None = None
    steps: list = field(default_factory=list)
    direction: np.ndarray | None = None
    rate: float = 1.0
    done: bool = False
    n_steps: int = 0

    @property
    def trial(self) -> np.ndarray:
        return self.x if self.direction is None else self.x + self.rate * self.direction

    def tell(self, value: float, gradient: np.ndarray) -> None:
        """Take value and gradient at the trial point, and choose the next one."""
        if self.value is not None:
            wanted = self.value + 1e-4 * self.rate * (self.gradient @ self.direction)
            if not value <= wanted:
                self.rate /= 2
                self.done = self.rate < 1e-10
                return
            moved, turned = self.rate * self.direction, gradient - self.gradient
            if moved @ turned > 1e-12 * (turned @ turned):
                self.steps = [*self.steps, (moved, turned)][-HISTORY:]
            self.n_steps += 1
            change = (self.value - value) / max(abs(self.value), abs(value), 1.0)
            self.x = self.x + moved
            self.done = change <= TOLERANCE or self.n_steps >= self.most
        self.value, self.gradient = value, gradient
        self.direction = self._next()
        slope = gradient @ self.direction
        self.done = self.done or not slope < 0
        self.rate = 1.0 if self.steps else min(1.0, 1.0 / max(1e-12, float(np.abs(gradient).sum())))

    def _next(self) -> np.ndarray:
        way, past = -self.gradient, []
        for moved, turned in reversed(self.steps):
            share = (moved @ way) / (moved @ turned)
            way = way - share * turned
            past.append(share)
        if self.steps:
            moved, turned = self.steps[-1]
            way = way * (moved @ turned) / (turned @ turned)
        for (moved, turned), share in zip(self.steps, reversed(past)):
            way = way + moved * (share - (turned @ way) / (moved @ turned))
        return way


def fit_logreg_layers(
    train: DataFrame, inp: str = "features", label: str = "label", layer: str | None = "layer_index", max_iter: int = 1000, n_classes: int | None = None
) -> LayeredModel:
    """Scaled multinomial logistic regression of every layer, with the penalty of C = 1 on summed losses.

    Each pass gives every layer that has not settled the value and gradient at the point it asked for.
    """
    moments = layer_moments(train, inp, layer)
    if not moments:
        raise ValueError("no rows to fit on")
    k = n_classes or int(train.agg(F.max(label)).first()[0]) + 1
    d = len(next(iter(moments.values()))[1])
    rows, models = _rows(train, inp, layer, label), {}
    scales = {one: np.divide(1.0, np.sqrt(v), out=np.zeros(d), where=v > 0) for one, (_, _, v) in moments.items()}
    for some in _turns(sorted(moments), k * (d + 1)):
        solvers = {one: Descent(np.zeros(k * (d + 1)), max_iter) for one in some}
        while open_ones := {one: s.trial.reshape(k, d + 1) for one, s in solvers.items() if not s.done}:

            def slope(one, vectors, labels, points=open_ones) -> np.ndarray | None:
                if one not in points:
                    return None
                scaled = np.column_stack(((vectors - moments[one][1]) * scales[one], np.ones(len(vectors))))
                scores = scaled @ points[one].T
                top = scores.max(axis=1, keepdims=True)
                raised = np.exp(scores - top)
                whole = raised.sum(axis=1, keepdims=True)
                at = np.arange(len(labels))
                loss = float((np.log(whole[:, 0]) + top[:, 0] - scores[at, labels]).sum())
                p = raised / whole
                p[at, labels] -= 1
                return np.append((p.T @ scaled).ravel(), loss)

            # Layers that have settled are left out of the scan.
            part = rows.where(F.col("layer").isin(list(open_ones))) if len(open_ones) < len(moments) else rows
            for one, sums in _summed(part, slope).items():
                n, point = moments[one][0], open_ones[one]
                free = point.copy()
                free[:, -1] = 0  # the bias is not held down
                solvers[one].tell(sums[-1] / n + (free * free).sum() / (2 * n), (sums[:-1].reshape(k, d + 1) / n + free / n).ravel())
        for one, solver in solvers.items():
            found = solver.x.reshape(k, d + 1)
            models[one] = LinearModel(moments[one][1], scales[one], found[:, :-1], found[:, -1], inp)
    return LayeredModel(models, layer or "layer_index", inp)
