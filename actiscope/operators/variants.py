"""The five labelled variants of a layer output.

``GENERATORS`` maps a label to a function of ``VariantInputs`` that returns SQL
text; add an entry to add a variant. ``expand`` turns one layer state into one row per entry without
a shuffle.

Two engines give the same values: ``columns`` stays in the JVM, ``arrow`` makes
the three computed variants in NumPy on Arrow batches. Array lambdas are
interpreted element by element, so ``arrow`` is many times faster for vectors
of thousands of values and is the default.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actiscope.functions import keyed, vectors
from actiscope.schema import LABELS, SEED

# Lower bounds of the noise widths, and the relative width of a perturbation.
MIN_NOISE_STD = 1e-8
MIN_PERTURBATION_STD = 1e-10
PERTURBATION_SHARE = 0.05


@dataclass(frozen=True)
class VariantInputs:
    """SQL text of what a generator may use."""

    input_vec: str
    output_vec: str
    mu: str
    std: str
    seed: int
    ids: tuple[str, ...]

    def normals(self, label: int) -> str:
        """Deviates of the output's length, independent for each label."""
        return keyed.normals(f"size({self.output_vec})", keyed.key_words(self.seed, self.ids, label))


def honest(row: VariantInputs) -> str:
    return row.output_vec


def int4(row: VariantInputs) -> str:
    return vectors.int4_round_trip(row.output_vec)


def identity(row: VariantInputs) -> str:
    return row.input_vec


def noise(row: VariantInputs) -> str:
    values = f"transform({row.normals(3)}, no_z -> cast(no_s.mu + no_s.width * no_z as float))"
    return vectors.let(
        "no_s", f"struct({row.mu} as mu, greatest({row.std}, {MIN_NOISE_STD!r}D) as width)", values
    )


def perturbed(row: VariantInputs) -> str:
    moved = "cast(pt_x + cast(pt_w * pt_z as float) as float)"
    values = f"zip_with({row.output_vec}, {row.normals(4)}, (pt_x, pt_z) -> {moved})"
    return vectors.let(
        "pt_w", f"greatest({PERTURBATION_SHARE!r}D * {row.std}, {MIN_PERTURBATION_STD!r}D)", values
    )


Generator = Callable[[VariantInputs], str]
GENERATORS: dict[int, Generator] = {0: honest, 1: int4, 2: identity, 3: noise, 4: perturbed}


def variant_inputs(
    seed: int = SEED,
    input_vec: str = "input_vec",
    output_vec: str = "output_vec",
    ids: tuple[str, ...] = ("instruction_id", "layer_index"),
    mu: str | None = None,
    std: str | None = None,
) -> VariantInputs:
    return VariantInputs(
        input_vec, output_vec, mu or vectors.mean(output_vec), std or vectors.population_std(output_vec), seed, ids
    )


_ELEMENTS_AT_ONCE = 1 << 17
_COMPUTED = T.StructType([T.StructField(n, T.ArrayType(T.FloatType())) for n in ("int4", "noise", "perturbed")])


def _per_row(reduce: np.ufunc, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Reduce each row's run of ``flat``; empty rows give 0."""
    out = np.zeros(len(sizes), dtype=flat.dtype)
    filled = sizes > 0
    if filled.any():
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        out[filled] = reduce.reduceat(flat, starts[filled])
    return out


def _computed_variants(flat, sizes, a3, b3, a4, b4):
    """INT4, noise and perturbation values of rows laid end to end."""
    scale = _per_row(np.maximum, np.abs(flat), sizes) / np.float32(7)
    step = np.repeat(np.where(scale == 0, np.float32(1), scale), sizes)
    int4_values = np.clip(np.rint(flat / step), np.float32(-8), np.float32(7)) * step
    int4_values = np.where(np.repeat(scale == 0, sizes), flat, int4_values)

    wide = flat.astype(np.float64)
    n = np.maximum(sizes, 1)
    mu = _per_row(np.add, wide, sizes) / n
    gaps = wide - np.repeat(mu, sizes)
    std = np.sqrt(_per_row(np.add, gaps * gaps, sizes) / n)

    z = keyed.normals_flat(a3, b3, sizes)
    noise_values = np.repeat(mu, sizes) + np.repeat(np.maximum(std, MIN_NOISE_STD), sizes) * z
    z = keyed.normals_flat(a4, b4, sizes)
    shift = np.repeat(np.maximum(std * PERTURBATION_SHARE, MIN_PERTURBATION_STD), sizes) * z
    return int4_values.astype(np.float32), noise_values.astype(np.float32), flat + shift.astype(np.float32)


@F.arrow_udf(_COMPUTED)
def _computed(v: pa.Array, a3: pa.Array, b3: pa.Array, a4: pa.Array, b4: pa.Array) -> pa.Array:
    sizes = np.nan_to_num(v.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = v.flatten().to_numpy(zero_copy_only=False)
    keys = [k.to_numpy() for k in (a3, b3, a4, b4)]
    ends = np.cumsum(sizes)
    parts: list[tuple] = []
    row, at = 0, 0
    with np.errstate(over="ignore", invalid="ignore"):
        while row < len(sizes):
            stop = max(row + 1, int(np.searchsorted(ends, at + _ELEMENTS_AT_ONCE, side="right")))
            end = int(ends[stop - 1])
            parts.append(_computed_variants(flat[at:end], sizes[row:stop], *[k[row:stop] for k in keys]))
            row, at = stop, end
    offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
    mask = v.is_null() if v.null_count else None
    lists = [
        pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(values) if parts else flat), mask=mask)
        for values in (zip(*parts) if parts else [(), (), ()])
    ]
    return pa.StructArray.from_arrays(lists, names=["int4", "noise", "perturbed"])


def expand(
    states: DataFrame,
    seed: int = SEED,
    engine: str = "arrow",
    generators: dict[int, Generator] | None = None,
    names: dict[int, str] = LABELS,
    input_vec: str = "input_vec",
    output_vec: str = "output_vec",
    ids: tuple[str, ...] = ("instruction_id", "layer_index"),
    keep: tuple[str, ...] = (),
    vector: str = "vector",
) -> DataFrame:
    """One row per layer state and label: ids, kept columns, label, label_name, vector."""
    if engine not in ("arrow", "columns"):
        raise ValueError(f"unknown engine: {engine!r}")
    generators = dict(GENERATORS if generators is None else generators)
    unnamed = sorted(set(generators) - set(names))
    if unnamed:
        raise ValueError(f"labels without a name: {unnamed}")
    row = variant_inputs(seed, input_vec, output_vec, ids)
    if engine == "arrow":
        words = [
            F.expr(keyed.key_words(seed, ids, label))[word] for label in (3, 4) for word in ("a", "b")
        ]
        states = states.withColumn("_computed", _computed(F.col(output_vec), *words))
        made = {int4: "_computed.int4", noise: "_computed.noise", perturbed: "_computed.perturbed"}
    else:
        # The generate step keeps this projection below it, so both are computed once per row.
        states = states.withColumns({"_mu": F.expr(row.mu), "_std": F.expr(row.std)})
        row = variant_inputs(seed, input_vec, output_vec, ids, "_mu", "_std")
        made = {}
    structs = [
        f"struct({label} as label, '{names[label]}' as label_name, {made.get(make) or make(row)} as {vector})"
        for label, make in sorted(generators.items())
    ]
    return states.select(*ids, *keep, F.expr(f"inline(array({', '.join(structs)}))"))


def overflowing(row: VariantInputs) -> str:
    """True when a generated vector would hold a value beyond float32.

    No generator moves a value by more than eight times the largest magnitude,
    so the variants are only worked out for outputs beyond 1e37.
    """
    out = row.output_vec
    largest = f"greatest(array_max({out}), -array_min({out}))"
    made = ", ".join(make(row) for make in GENERATORS.values())
    return f"if({largest} > 1e37D, exists(array({made}), ov_v -> not {vectors.is_finite('ov_v')}), false)"


def vector_stats(df: DataFrame, vec: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Mean, population standard deviation and largest magnitude of each vector."""
    return df.select(
        *keep,
        F.expr(vectors.mean(vec)).alias("mean"),
        F.expr(vectors.population_std(vec)).alias("std"),
        F.expr(vectors.abs_max(vec)).cast("double").alias("abs_max"),
    )
