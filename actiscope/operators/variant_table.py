"""The five variants as a table function for SQL.

After ``register(spark)``, ``select * from expand_variants(table(select instruction_id, layer_index, input_vec, output_vec from
states))`` gives one row per layer state and label. Batches are Arrow on both sides and rows stay in their partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from actiscope.operators.variants import _computed_variants
from actiscope.schema import LABELS, SEED

RETURNS = "instruction_id int, layer_index int, label int, label_name string, vector array<float>"
INPUTS = ("instruction_id", "layer_index", "input_vec", "output_vec")

Generator = Callable[[pa.Array, pa.Array], pa.Array]
"""Vectors of one label from the input and the output vectors of a batch."""


def key_words(ids: list[tuple], label: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Both words of the noise key of each (instruction, layer), as ``keyed.key_words`` makes them."""
    digests = [hashlib.md5("|".join(map(str, (seed, *i, label))).encode()).digest() for i in ids]
    words = np.frombuffer(b"".join(digests), ">u4").reshape(-1, 4).astype(np.int64)
    return words[:, 0], words[:, 1]


def _batch_variants(batch: pa.RecordBatch, seed: int) -> list[pa.Array]:
    """Vectors of the labels 0 to 4; a null output gives null where the output is needed."""
    given, out = (batch.column(c).cast(pa.list_(pa.float32())) for c in ("input_vec", "output_vec"))
    sizes = np.nan_to_num(out.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = out.flatten().to_numpy(zero_copy_only=False)
    ids = list(zip(batch.column("instruction_id").to_pylist(), batch.column("layer_index").to_pylist()))
    with np.errstate(over="ignore", invalid="ignore"):
        made = _computed_variants(flat, sizes, *key_words(ids, 3, seed), *key_words(ids, 4, seed))
    offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
    mask = out.is_null() if out.null_count else None
    int4, noise, moved = (pa.ListArray.from_arrays(offsets, pa.array(values), mask=mask) for values in made)
    return [out, int4, given, noise, moved]


def variants_function(seed: int = SEED, generators: Mapping[int, tuple[str, Generator]] | None = None):
    """The table function; ``generators`` (label to name and vectors) adds labels or takes the place of one of the five."""
    own = dict(generators or {})
    names = LABELS | {label: name for label, (name, _) in own.items()}

    @F.arrow_udtf(returnType=RETURNS)
    class ExpandVariants:
        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            if not batch.num_rows:
                return
            vectors = dict(enumerate(_batch_variants(batch, seed)))
            for label, (_, make) in own.items():
                vectors[label] = make(batch.column("input_vec"), batch.column("output_vec"))
            for label, found in sorted(vectors.items()):
                n = batch.num_rows
                yield pa.table(
                    {
                        "instruction_id": batch.column("instruction_id").cast(pa.int32()),
                        "layer_index": batch.column("layer_index").cast(pa.int32()),
                        "label": pa.array([label] * n, pa.int32()),
                        "label_name": pa.array([names[label]] * n),
                        "vector": found.cast(pa.list_(pa.float32())),
                    }
                )

    return ExpandVariants


def register(spark: SparkSession, name: str = "expand_variants", seed: int = SEED, generators: Mapping[int, tuple[str, Generator]] | None = None) -> None:
    """Make the function known to SQL under a name."""
    spark.udtf.register(name, variants_function(seed, generators))
