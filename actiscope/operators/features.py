"""Vector columns as model features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import ElementwiseProduct, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actiscope.functions import keyed, vectors
from actiscope.schema import PCA_DIM, SEED
from actiscope.session import stored


def stack_vectors(df: DataFrame, vec: str = "hidden_state_vector", out: str = "features") -> DataFrame:
    """Array column as an ML vector; rows with a null vector are left out."""
    df = df.where(F.col(vec).isNotNull())
    return df.withColumn(out, array_to_vector(F.col(vec).cast("array<double>")))


def unstack(df: DataFrame, vec: str, out: str) -> DataFrame:
    return df.withColumn(out, vector_to_array(F.col(vec)))


def vector_size(df: DataFrame, vec: str) -> int:
    """Length of the vectors, read from the first row."""
    first = df.select(vec).first()
    if first is None:
        raise ValueError("no rows to take the vector length from")
    return len(first[0])


def fit_scaler(df: DataFrame, inp: str = "features", out: str = "scaled", n: int | None = None) -> PipelineModel:
    """Zero mean and unit population deviation.

    Spark's scaler divides by the sample deviation; the factor between the two
    depends on the row count alone, which may be passed when it is known.
    """
    n = df.count() if n is None else n
    sample = StandardScaler(inputCol=inp, outputCol=f"_{out}", withMean=True, withStd=True).fit(df)
    factor = float(np.sqrt(n / (n - 1))) if n > 1 else 1.0
    weights = Vectors.dense([factor] * sample.mean.size)
    return PipelineModel([sample, ElementwiseProduct(scalingVec=weights, inputCol=f"_{out}", outputCol=out)])


@dataclass(frozen=True)
class PcaModel:
    """Mean, components as rows, and the variance along each of all components."""

    mean: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    inp: str
    out: str

    @property
    def ratios(self) -> np.ndarray:
        """Share of the total variance of each kept component."""
        whole = self.variances.sum()
        kept = self.variances[: len(self.components)]
        return kept / whole if whole > 0 else np.zeros_like(kept)

    def transform(self, df: DataFrame) -> DataFrame:
        """Centre and project, one matrix product per Arrow batch."""
        mean, turned = self.mean, self.components.T

        def project(v: pa.Array) -> pa.Array:
            scores = (matrix(v, len(mean)) - mean) @ turned
            offsets = pa.array(np.arange(0, scores.size + 1, turned.shape[1], dtype=np.int32))
            return pa.ListArray.from_arrays(offsets, pa.array(scores.ravel()))

        scores = F.arrow_udf(project, T.ArrayType(T.DoubleType()))(vector_to_array(self.inp))
        return df.withColumn(self.out, array_to_vector(scores))


    def save(self, spark: SparkSession, path: str) -> None:
        row = (self.mean.tolist(), self.components.tolist(), self.variances.tolist(), self.inp, self.out)
        spark.createDataFrame([row], PCA_SCHEMA).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PcaModel:
        row = spark.read.schema(PCA_SCHEMA).parquet(path).first()
        return cls(*(np.array(x) for x in row[:3]), row.inp, row.out)


PCA_SCHEMA = "mean array<double>, components array<array<double>>, variances array<double>, inp string, out string"


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of an Arrow list column that all have ``width`` values."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), width)


def fit_pca(df: DataFrame, k: int = PCA_DIM, inp: str = "features", out: str = "pca") -> PcaModel:
    """First ``k`` components (at most the vector length) of the rows.

    The rows stay in their tasks: the driver gets the covariance matrix, whose
    size is the vector length squared, and takes its eigenvectors. The largest
    loading of each component is made positive, so the result is repeatable.
    """
    table = comoments(df.select(vector_to_array(inp).alias("_v")), "_v").sort("i").toArrow()
    n, d = table["n"][0].as_py(), table.num_rows
    lower, offset = np.zeros((d, d)), np.zeros(d)
    for i, row in enumerate(table["row"]):
        values = row.values.to_numpy() / n
        lower[i, : i + 1], offset[i] = values[:-1], values[-1]
    mu, lower = table["shift"].to_numpy() + offset, lower - np.outer(offset, offset)
    variances, axes = np.linalg.eigh(lower, UPLO="L")
    order = np.argsort(-variances, kind="stable")
    components = axes[:, order[: min(k, d)]].T
    peaks = np.abs(components).argmax(axis=1)
    components = components * np.where(components[np.arange(len(components)), peaks] < 0, -1.0, 1.0)[:, None]
    variances = np.maximum(variances[order], 0.0)
    return PcaModel(mu, without_empty(components, variances), variances, inp, out)


def without_empty(components: np.ndarray, variances: np.ndarray) -> np.ndarray:
    """Components, zero where there is no variance but that of rounding, which a scaler would otherwise blow up."""
    kept = variances[: len(components)] > 1e-12 * max(variances[0], 0.0)
    return components * kept[:, None]


def explained_variance(model: PcaModel) -> float:
    """Share of the variance the components keep, in per cent."""
    return 100.0 * float(model.ratios.sum())


def comoments(df: DataFrame, vec: str, tasks: int | None = None) -> DataFrame:
    """Sums of products of the vectors, found in one scan: rows (i, row, shift, n).

    Vectors are taken relative to one of them, whose values are ``shift``; this
    keeps the sums small. ``row`` holds the products of position i with
    positions 0 to i, then the plain sum of position i. Each task adds up the
    products of its rows by matrix multiplication and emits one such triangle;
    the triangles are then added up row by row. What is shuffled depends on the
    vector length and the number of tasks, not on the rows, so the input is
    read by as many tasks as there are cores unless ``tasks`` says otherwise.
    The result, of half the vector length squared, is stored. Null vectors add
    nothing.
    """
    tasks = tasks or df.sparkSession.sparkContext.defaultParallelism
    some = df.select(F.col(vec).cast("array<double>").alias("v")).where("v is not null").first()
    if some is None:
        raise ValueError("no vectors to sum")
    shift = np.array(some.v)
    d = len(shift)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums, n = np.zeros((d, d)), np.zeros(d), 0
        for batch in batches:
            rows = matrix(batch.column(0).drop_null(), d) - shift
            products += rows.T @ rows
            sums += rows.sum(axis=0)
            n += len(rows)
        if n:
            triangle = np.tril(np.ones((d, d + 1), dtype=bool), 1)  # one place more per row, for the sum
            values = np.column_stack((products, sums))
            values[np.arange(d), np.arange(d) + 1] = sums
            offsets = np.concatenate(([0], np.cumsum(np.arange(d) + 2))).astype(np.int32)
            columns = {
                "i": pa.array(np.arange(d, dtype=np.int32)),
                "row": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[triangle])),
                "shift": pa.array(shift),
                "n": pa.array(np.full(d, n, dtype=np.int64)),
            }
            yield pa.RecordBatch.from_pydict(columns)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sum of the rows of each i; a task holds its share of one triangle."""
        found: dict[int, list] = {}
        for batch in batches:
            ids, shifts, counts = (batch.column(c).to_numpy() for c in ("i", "shift", "n"))
            for at, row in enumerate(batch.column("row")):
                kept = found.setdefault(int(ids[at]), [0.0, shifts[at], 0])
                kept[0] = kept[0] + row.values.to_numpy()
                kept[2] += counts[at]
        for i, (row, base, n) in found.items():
            yield pa.RecordBatch.from_pydict(
                {
                    "i": pa.array([i], pa.int32()),
                    "row": pa.array([row], pa.list_(pa.float64())),
                    "shift": pa.array([base], pa.float64()),
                    "n": pa.array([n], pa.int64()),
                }
            )

    kind = "i int, row array<double>, shift double, n bigint"
    partials = df.select(vec).coalesce(tasks).mapInArrow(partial, kind)
    return stored(partials.repartition("i").mapInArrow(added, kind), "comoments")


def covariance(df: DataFrame, vec: str = "hidden_state_vector", tasks: int | None = None) -> DataFrame:
    """Population covariance as rows (i, j, covariance) with j <= i."""
    rows = comoments(df, vec, tasks).withColumn("sum_i", F.element_at("row", -1))
    cells = rows.select("i", "n", "sum_i", F.posexplode(F.expr("slice(row, 1, i + 1)")).alias("j", "value"))
    sums = rows.select(F.col("i").alias("j"), F.col("sum_i").alias("sum_j"))  # one row per vector position
    centred = F.col("value") - F.col("sum_i") * F.col("sum_j") / F.col("n")
    return cells.join(F.broadcast(sums), "j").select("i", "j", (centred / F.col("n")).alias("covariance"))


def kernel_bank(count: int, size: int = 7, seed: int = SEED) -> list[list[float]]:
    """Zero-mean random convolution kernels, a function of the seed alone."""
    a = np.arange(count, dtype=np.int64) + seed
    values = keyed.normals_flat(a, a * 7919 & keyed.MASK, np.full(count, size)).reshape(count, size)
    return (values - values.mean(axis=1, keepdims=True)).round(6).tolist()


def conv_features(
    df: DataFrame, kernels: list[list[float]], vec: str = "hidden_state_vector", out: str = "conv", stride: int = 2
) -> DataFrame:
    """One feature per kernel: convolve with zero padding, ReLU, average over positions."""
    responses = [vectors.conv_relu_mean(vec, kernel, stride) for kernel in kernels]
    return df.withColumn(out, F.expr(f"array({', '.join(responses)})"))


CONV_CELLS = 1 << 20
"""Windows and responses of a convolution that are held at once."""


def conv_features_arrow(
    df: DataFrame, kernels: list[list[float]], vec: str = "hidden_state_vector", out: str = "conv", stride: int = 2
) -> DataFrame:
    """``conv_features`` in NumPy on Arrow batches, for long vectors or many kernels."""
    sizes = {len(k) for k in kernels}
    if len(sizes) != 1:
        raise ValueError("kernels of one call must have one size")
    size = sizes.pop()
    bank = np.array(kernels).T

    def respond(v: pa.Array) -> pa.Array:
        lengths = v.value_lengths().fill_null(0).to_numpy()
        flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
        result = np.zeros((len(lengths), bank.shape[1]))
        for d in np.unique(lengths[lengths > 0]):
            which = np.flatnonzero(lengths == d)
            responses = -(-int(d) // stride) * max(size, bank.shape[1])
            for part in np.array_split(which, max(1, -(-len(which) * responses // CONV_CELLS))):
                rows = flat[starts[part][:, None] + np.arange(d)]
                padded = np.pad(rows, ((0, 0), (size // 2, size // 2)))
                windows = np.lib.stride_tricks.sliding_window_view(padded, size, axis=1)[:, ::stride]
                result[part] = np.maximum(windows @ bank, 0).mean(axis=1)
        offsets = pa.array(np.arange(0, result.size + 1, bank.shape[1], dtype=np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(result.ravel()))

    udf = F.arrow_udf(respond, T.ArrayType(T.DoubleType()))
    return df.withColumn(out, udf(F.col(vec)))


def chunk_tokens(df: DataFrame, width: int, vec: str = "hidden_state_vector", out: str = "pooled") -> DataFrame:
    """View each vector as tokens of ``width`` values and average them."""
    return df.withColumn(out, F.expr(vectors.chunk_mean(vec, width)))


def fourier_features(df: DataFrame, count: int, width: float, vec: str, out: str = "fourier", seed: int = SEED) -> DataFrame:
    """Random Fourier features of a Gaussian kernel exp(-width * distance ** 2).

    ``vec`` is an array column; the directions are a function of the seed and
    the vector length, so every task makes the same ones.
    """

    def lift(v: pa.Array) -> pa.Array:
        if not len(v):
            return pa.array([], pa.list_(pa.float64()))
        rows = matrix(v, len(v[0]))
        a = np.arange(count, dtype=np.int64) + seed
        sizes = np.full(count, rows.shape[1] + 1)
        directions = keyed.normals_flat(a, a * 7919 & keyed.MASK, sizes).reshape(count, -1)
        phase = np.pi * directions[:, -1] * 16  # wide against one turn, so close to uniform on the circle
        lifted = np.sqrt(2.0 / count) * np.cos(rows @ (np.sqrt(2 * width) * directions[:, :-1].T) + phase)
        offsets = pa.array(np.arange(0, lifted.size + 1, count, dtype=np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(lifted.ravel()))

    return df.withColumn(out, F.arrow_udf(lift, T.ArrayType(T.DoubleType()))(F.col(vec)))
