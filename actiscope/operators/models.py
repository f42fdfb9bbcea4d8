"""Classifiers by name, and the training loop with early stopping.

A ``ModelSpec`` fits on a frame of (features, label) and returns something with
``transform(df)`` that adds ``prediction``. Their order in the registry is the
training order, which breaks ties in model selection.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actiscope.operators import features as feature_ops
from actiscope.operators import hashing, layered, minibatch, neighbors
from actiscope.operators.boosting import fit_boosted
from actiscope.operators.evaluate import MIN_PROBABILITY
from actiscope.operators.saving import Saver
from actiscope.operators.stopping import StopRule
from actiscope.schema import BATCH_SIZE, EPOCHS, LEARNING_RATE, SEED, STOP_PATIENCE

# Hidden layer widths of the feed-forward networks.
MLP_WIDTHS = {
    "MLP_Tiny": [64],
    "MLP_Small": [512],
    "MLP_Medium": [1024],
    "MLP_2L": [512, 128],
    "MLP_Deep": [1024, 256, 64],
    "MLP_Wide": [2048, 1024],
    "MLP_Bottleneck": [1024, 128, 1024],
}
# First convolution (kernels, kernel size, stride) of the convolutional networks.
CONV_STAGES = {
    "CNN_Tiny": (32, 7, 2),
    "CNN_Small": (64, 7, 2),
    "CNN_Deep": (64, 7, 1),
    "CNN_Wide": (128, 15, 2),
}
# Fixed value: token width of the attention networks.
TOKEN_WIDTH = 512
# Tree and neighbour settings.
TREES = 200
NEIGHBORS = 5
MAX_ITERATIONS = 1000


@dataclass(frozen=True)
class ModelSpec:
    name: str
    family: str  # "classical", "network", or "features" for a fixed transform with logistic regression
    fit: Callable
    settings: dict = field(default_factory=dict)
    uses_val: bool = False  # the fit also takes the validation rows, as ``val``
    fit_layers: Callable | None = None  # fits one model per layer in common passes


def fit_logreg(train: DataFrame, inp: str = "features", label: str = "label", max_iter: int = MAX_ITERATIONS) -> PipelineModel:
    """Scaled multinomial logistic regression; the penalty is that of C = 1 on summed losses."""
    n = train.count()
    scaler = feature_ops.fit_scaler(train, inp, "_std", n)
    model = LogisticRegression(
        featuresCol="_std",
        labelCol=label,
        family="multinomial",
        maxIter=max_iter,
        regParam=1.0 / n,
        elasticNetParam=0.0,
        standardization=False,
    ).fit(scaler.transform(train))
    return PipelineModel([*scaler.stages, model])


def fit_forest(train: DataFrame, inp: str = "features", label: str = "label", trees: int = TREES, depth: int = 30, seed: int = SEED):
    """Random forest of deep trees, grown from all rows; the driver holds the trees."""
    return RandomForestClassifier(
        featuresCol=inp,
        labelCol=label,
        numTrees=trees,
        maxDepth=depth,
        featureSubsetStrategy="sqrt",
        seed=seed,
        maxMemoryInMB=1024,
    ).fit(train)


def prepared(df: DataFrame, spec: Mapping) -> DataFrame:
    """``df`` with the made features that a spec (kind, inp and the settings of that kind) describes."""
    makers = {
        "fourier": lambda x, v, o: feature_ops.fourier_features(x, spec["count"], spec["width"], v, o, spec["seed"]),
        "conv": lambda x, v, o: feature_ops.conv_features_arrow(x, feature_ops.kernel_bank(spec["count"], spec["size"], spec["seed"]), v, o, spec["stride"]),
        "tokens": lambda x, v, o: feature_ops.chunk_tokens(x, spec["width"], v, o),
    }
    return _features_from(df, spec["inp"], makers[spec["kind"]])


class FeatureModel:
    """A feature transform of the raw vectors, told by a spec, followed by a fitted model."""

    def __init__(self, spec: Mapping, model):
        self.spec, self.model = dict(spec), model

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(prepared(df, self.spec))

    def write(self) -> Saver:
        def save(path: str, mode: str) -> None:
            writer = PipelineModel([self.model]).write()
            (writer.overwrite() if mode == "overwrite" else writer).save(f"{path}/model")
            row = SparkSession.active().range(1).select(F.lit(json.dumps(self.spec)).alias("value"))
            row.write.mode(mode).text(f"{path}/spec")

        return Saver(save)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FeatureModel:
        return cls(json.loads(spark.read.text(f"{path}/spec").first()[0]), PipelineModel.load(f"{path}/model"))


class NeighborModel:
    """Scaled k-nearest-neighbour vote over a fitted base, exact for any number of base rows."""

    def __init__(self, scaler, base: DataFrame, inp: str, label: str, id_col: str, k: int):
        self.scaler, self.base, self.inp, self.label, self.id_col, self.k = scaler, base, inp, label, id_col, k

    def _rows(self, df: DataFrame, *columns: str) -> DataFrame:
        return self.scaler.transform(df).select(self.id_col, *columns, vector_to_array("_std").alias("_vec"))

    def transform(self, df: DataFrame) -> DataFrame:
        near = hashing.find_neighbors(self._rows(df), self._rows(self.base, self.label), self.k, id_col=self.id_col, vec="_vec", label=self.label)
        votes = neighbors.vote(near)
        scored = votes.select(F.col("query_id").alias(self.id_col), F.col("y_pred").cast("double").alias("prediction"))
        return df.join(scored, self.id_col)

    def write(self) -> Saver:
        def save(path: str, mode: str) -> None:
            writer = self.scaler.write()
            (writer.overwrite() if mode == "overwrite" else writer).save(f"{path}/scaler")
            self.base.select(self.id_col, self.label, self.inp).write.mode(mode).parquet(f"{path}/base")

        return Saver(save)

    @classmethod
    def load(cls, spark: SparkSession, path: str, k: int = NEIGHBORS) -> NeighborModel:
        base = spark.read.parquet(f"{path}/base")
        id_col, label, inp = base.columns
        return cls(PipelineModel.load(f"{path}/scaler"), base, inp, label, id_col, k)


def fit_knn(
    train: DataFrame, inp: str = "features", label: str = "label", id_col: str = "sample_id", k: int = NEIGHBORS
) -> NeighborModel:
    return NeighborModel(feature_ops.fit_scaler(train, inp, "_std"), train, inp, label, id_col, k)


def fit_svm(
    train: DataFrame,
    inp: str = "features",
    label: str = "label",
    count: int = 512,
    max_iter: int = 100,
    width: float | None = None,
    seed: int = SEED,
) -> FeatureModel:
    """Gaussian-kernel support vectors, one against the rest, on random Fourier features.

    The kernel width defaults to 1 / (length * variance of all values), the
    penalty to that of C = 1.
    """
    n, d = train.count(), feature_ops.vector_size(train, inp)
    if width is None:
        values = train.select(Summarizer.metrics("mean", "variance").summary(F.col(inp)).alias("s")).first().s
        means, spread = values.mean.toArray(), values.variance.toArray() * (n - 1) / n
        width = 1.0 / (d * (spread.mean() + means.var()))

    spec = {"kind": "fourier", "inp": inp, "count": count, "width": width, "seed": seed}
    kept = prepared(train, spec).select(label, "_made").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        margin = LinearSVC(featuresCol="_made", labelCol=label, maxIter=max_iter, regParam=1.0 / n, standardization=False)
        model = OneVsRest(classifier=margin, featuresCol="_made", labelCol=label, parallelism=4).fit(kept)
    finally:
        kept.unpersist()
    for m in model.models:  # a summary holds the session, which can't travel to tasks once it has observed a query
        m._java_obj.setSummary(train.sparkSession._jvm.scala.Option.empty())
    return FeatureModel(spec, model)


def network_layers(name: str, n_inputs: int, n_classes: int) -> list[int]:
    if name not in MLP_WIDTHS:
        raise ValueError(f"unknown network: {name!r}")
    return [n_inputs, *MLP_WIDTHS[name], n_classes]


def fit_mlp(
    train: DataFrame,
    name: str = "MLP_Tiny",
    inp: str = "features",
    label: str = "label",
    epochs: int = EPOCHS,
    seed: int = SEED,
    block_size: int = BATCH_SIZE,
    n_classes: int | None = None,
):
    """Feed-forward network by name, class count taken from all training rows."""
    if n_classes is None:
        n_classes = int(train.agg(F.max(label)).first()[0]) + 1
    layers = network_layers(name, feature_ops.vector_size(train, inp), n_classes)
    return MultilayerPerceptronClassifier(
        featuresCol=inp, labelCol=label, layers=layers, maxIter=epochs, seed=seed, blockSize=block_size
    ).fit(train)


def validation_loss(model, df: DataFrame, label: str = "label") -> float:
    p = F.element_at(vector_to_array("probability"), F.col(label).cast("int") + 1)
    loss = -F.log(F.greatest(p, F.lit(MIN_PROBABILITY)))
    return float(model.transform(df).agg(F.avg(loss)).first()[0])


def fit_early_stop(
    train: DataFrame,
    val: DataFrame,
    name: str = "MLP_Tiny",
    inp: str = "features",
    label: str = "label",
    epochs: int = EPOCHS,
    steps_per_epoch: int = 1,
    rate: float = LEARNING_RATE,
    patience: int = STOP_PATIENCE,
    seed: int = SEED,
    block_size: int = BATCH_SIZE,
    n_classes: int | None = None,
    solver: str = "gd",
):
    """Train in epochs of a few solver steps, each started from the last weights.

    ``gd`` takes gradient steps of the current rate; ``l-bfgs`` finds its own
    step length, so that only the stop rule acts. Returns the model of the best epoch
    and the log as rows of (epoch, train_loss, val_loss, rate). Pass cached frames:
    every epoch reads both.
    """
    if n_classes is None:
        n_classes = int(train.agg(F.max(label)).first()[0]) + 1
    layers = network_layers(name, feature_ops.vector_size(train, inp), n_classes)
    rule = StopRule(rate=rate, patience=patience)
    weights, best, log = None, None, []
    for epoch in range(1, epochs + 1):
        trainer = MultilayerPerceptronClassifier(
            featuresCol=inp,
            labelCol=label,
            layers=layers,
            solver=solver,
            stepSize=rule.rate,
            maxIter=steps_per_epoch,
            tol=0.0,
            seed=seed,
            blockSize=block_size,
        )
        if weights is not None:
            trainer.setInitialWeights(weights)
        model = trainer.fit(train)
        weights = model.weights
        loss = validation_loss(model, val, label)
        log.append((epoch, validation_loss(model, train, label), loss, rule.rate))
        improved, stop = rule.update(loss)
        if improved:
            best = model
        if stop:
            break
    return best, log


def fit_network(
    train: DataFrame,
    name: str = "MLP_Tiny",
    inp: str = "features",
    label: str = "label",
    val: DataFrame | None = None,
    steps_per_epoch: int = 5,
    rate: float | None = None,
    patience: int = STOP_PATIENCE,
    **settings,
):
    """A feed-forward network, stopped early when there are validation rows.

    With a ``rate`` it takes gradient steps of that rate, cut on a plateau; without, l-bfgs steps. The
    model's ``training_log`` holds the rows of ``fit_early_stop``. Without validation rows neither
    rate nor patience acts.
    """
    if val is None or val.isEmpty():
        return fit_mlp(train, name, inp, label, **settings)
    how = {"solver": "l-bfgs"} if rate is None else {"solver": "gd", "rate": rate}
    best, log = fit_early_stop(train, val, name, inp, label, steps_per_epoch=steps_per_epoch, patience=patience, **how, **settings)
    best.training_log = log
    return best


def fit_widths(train: DataFrame, name: str = "MLP_Tiny", inp: str = "features", label: str = "label", val: DataFrame | None = None, **settings) -> minibatch.NetworkModel:
    """A feed-forward network by name, trained in shuffled batches and stopped early when there are validation rows."""
    if name not in MLP_WIDTHS:
        raise ValueError(f"unknown network: {name!r}")
    return minibatch.fit_network(train, MLP_WIDTHS[name], inp, label, val, **settings)


def linear_scorer(weights: np.ndarray, bias: np.ndarray, batch_size: int = 4096):
    """Class scores of an externally trained linear model, in batches."""

    def load():
        def predict(rows: np.ndarray) -> np.ndarray:
            return rows.astype(np.float64) @ weights.T + bias

        return predict

    return predict_batch_udf(
        load, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size, input_tensor_shapes=[[weights.shape[1]]]
    )


def batch_predict(df: DataFrame, scorer, vec: str = "hidden_state_vector", out: str = "prediction") -> DataFrame:
    """Class with the highest score; the lowest class wins a tie."""
    scored = df.withColumn("_scores", scorer(F.col(vec)))
    best = F.array_position("_scores", F.array_max("_scores")) - 1
    return scored.withColumn(out, best.cast("int")).drop("_scores")


def _features_from(df: DataFrame, inp: str, make: Callable[[DataFrame, str, str], DataFrame]) -> DataFrame:
    raw = df.withColumn("_raw", vector_to_array(inp))
    made = make(raw, "_raw", "_made")
    return made.withColumn("_made", array_to_vector("_made")).drop("_raw")


def _fit_prepared(made: DataFrame, label: str, max_iter: int) -> PipelineModel:
    """Fit on made features, which are short and kept while the fit reads them."""
    kept = made.select(label, "_made").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return fit_logreg(kept, "_made", label, max_iter)
    finally:
        kept.unpersist()


def fit_conv(
    train: DataFrame, name: str = "CNN_Tiny", inp: str = "features", label: str = "label", max_iter: int = 100, seed: int = SEED
) -> FeatureModel:
    """Fixed random kernels shaped like the network's first stage, then logistic regression."""
    count, size, stride = CONV_STAGES[name]
    spec = {"kind": "conv", "inp": inp, "count": count, "size": size, "stride": stride, "seed": seed}
    return FeatureModel(spec, _fit_prepared(prepared(train, spec), label, max_iter))


def fit_chunks(
    train: DataFrame, inp: str = "features", label: str = "label", max_iter: int = 100, width: int = TOKEN_WIDTH
) -> FeatureModel:
    """Mean of the vector's tokens, then logistic regression; a length that tokens don't fill is an error."""
    size = feature_ops.vector_size(train, inp)
    if size % width:
        raise ValueError(f"vectors of {size} values are no whole number of tokens of {width}")

    spec = {"kind": "tokens", "inp": inp, "width": width}
    return FeatureModel(spec, _fit_prepared(prepared(train, spec), label, max_iter))


def classical_models(**settings) -> dict[str, ModelSpec]:
    """Models of the first track, in training order.

    ``settings`` maps a model name to keyword arguments of its fit function.
    The kernel model is only made when ``settings`` names it.
    """
    fits = {"LogisticRegression": fit_logreg, "RandomForest": fit_forest, "KNN": fit_knn, "BoostedTrees": fit_boosted}
    if "SVM" in settings:
        fits["SVM"] = fit_svm
    together = {"LogisticRegression": layered.fit_logreg_layers}
    return {name: ModelSpec(name, "classical", fit, settings.get(name, {}), fit_layers=together.get(name)) for name, fit in fits.items()}


def network_models(names: Sequence[str] | None = None, token_width: int = TOKEN_WIDTH, **settings) -> dict[str, ModelSpec]:
    """Networks in training order, all or the named ones, with shared settings.

    The convolutional and attention models are logistic regressions on a fixed transform; of the settings
    ``epochs`` (as iterations) and ``seed`` reach them, the others have no meaning there.
    """
    steps = {"max_iter": settings["epochs"]} if "epochs" in settings else {}
    seeded = {"seed": settings["seed"]} if "seed" in settings else {}
    specs = {}
    for name in MLP_WIDTHS:
        specs[name] = ModelSpec(name, "network", fit_widths, {"name": name, **settings}, uses_val=True)
    for name in CONV_STAGES:
        specs[name] = ModelSpec(name, "features", fit_conv, {"name": name, **steps, **seeded})
    specs["Attention_Small"] = ModelSpec("Attention_Small", "features", fit_chunks, {"width": token_width, **steps})
    if names is None:
        return specs
    unknown = [n for n in names if n not in specs]
    if unknown:
        raise ValueError(f"unknown networks: {unknown}")
    return {n: specs[n] for n in names}


def n_weights(layers: Sequence[int]) -> int:
    """Weights and biases of a fully connected network."""
    return sum((a + 1) * b for a, b in zip(layers, layers[1:]))
