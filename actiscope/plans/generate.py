"""From layer states to stored, labelled records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from actiscope.functions import text, vectors
from actiscope.operators import guards, variants
from actiscope.schema import RECORD_SCHEMA, SEED
from actiscope.sources.sinks import write_records


def failing_instructions(states: DataFrame, seed: int = SEED) -> DataFrame:
    """Instructions that cannot be processed as a whole, found in one narrow scan."""
    finite = f"{vectors.is_finite('input_vec')} and {vectors.is_finite('output_vec')}"
    fails = F.expr(
        f"case when not {vectors.same_shape('input_vec', 'output_vec')} then true "
        f"when not ({finite}) then false else {variants.overflowing(variants.variant_inputs(seed))} end"
    )
    return states.where(fails).select("instruction_id")


def assemble_records(variant_rows: DataFrame, model_name: str | Column) -> DataFrame:
    """The stored seven columns, in order and with the stored types."""
    name = F.lit(model_name) if isinstance(model_name, str) else model_name
    columns = {
        "sample_id": text.sample_id(F.col("instruction_id"), F.col("layer_index"), F.col("label")),
        "model_name": text.short_model_name(name),
        "hidden_state_vector": F.col("vector"),
    }
    return variant_rows.select(
        *[columns.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in RECORD_SCHEMA]
    )


def build_records(
    states: DataFrame, model_name: str = "model", seed: int = SEED, engine: str = "arrow"
) -> DataFrame:
    """Guard, expand, name and assemble: one lazy plan without a shuffle,
    after one scan that looks for instructions to leave out."""
    whole = guards.drop_groups(states, failing_instructions(states, seed), "instruction_id")
    expanded = variants.expand(guards.finite_guard(whole), seed, engine)
    return assemble_records(expanded, model_name)


@dataclass(frozen=True)
class RunCounts:
    """What a run wrote and left out, as counted by the job that wrote it."""

    n_records: int
    per_layer: list[tuple[int, int, int, int]]

    def drops(self, spark: SparkSession) -> DataFrame:
        """Rows seen and dropped per layer, as ``finite_drops`` has them."""
        return spark.createDataFrame(self.per_layer, "layer_index int, n_rows bigint, n_bad_input bigint, n_bad_output bigint")


def write_counted(states: DataFrame, sink: str, n_layers: int, model_name: str = "model", seed: int = SEED, engine: str = "arrow", **write) -> RunCounts:
    """Build and write the records of ``states``, and count as the rows pass: no second scan of states or sink.

    Rows of each of the layers 0 to ``n_layers`` - 1 are counted before anything is left out, records as they are written.
    """
    seen, made = Observation("states"), Observation("records")
    bad_in, bad_out = (~F.expr(vectors.is_finite(c)) for c in ("input_vec", "output_vec"))
    metrics = []
    for k in range(n_layers):
        here = F.col("layer_index") == k
        for name, what in (("rows", here), ("in", here & bad_in), ("out", here & ~bad_in & bad_out)):
            metrics.append(F.count_if(what).alias(f"{name}_{k}"))
    offenders = failing_instructions(states, seed)
    whole = guards.drop_groups(states.observe(seen, *metrics), offenders, "instruction_id")
    expanded = variants.expand(guards.finite_guard(whole), seed, engine)
    write_records(assemble_records(expanded, model_name).observe(made, F.count(F.lit(1)).alias("n")), sink, **write)
    counted = seen.get
    layers = [(k, *(counted[f"{name}_{k}"] for name in ("rows", "in", "out"))) for k in range(n_layers)]
    return RunCounts(made.get["n"], [row for row in layers if row[1]])


def drift_summary(states: DataFrame, seed: int = SEED, engine: str = "arrow") -> DataFrame:
    """Per layer and label: variants made and their mean distance to the honest output."""
    whole = guards.drop_groups(states, failing_instructions(states, seed), "instruction_id")
    expanded = variants.expand(guards.finite_guard(whole), seed, engine, keep=("output_vec",))
    distance = F.expr(vectors.l2_distance("output_vec", "vector"))
    return (
        expanded.select("layer_index", "label", "label_name", distance.alias("l2"))
        .groupBy("layer_index", "label", "label_name")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("l2").alias("mean_l2"))
    )


def run_totals(records: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """Records, instructions, layers and records per instruction in a sink.

    Given the layer states it was made from, also the instructions that left no
    record. Only ids are read, and counted per instruction before they are joined.
    """
    counted = records.groupBy("instruction_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("layer_index").alias("top_layer")
    )
    if states is not None:
        counted = states.select("instruction_id").distinct().join(counted, "instruction_id", "full_outer")
    totals = [
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_records"),
        F.count("n").alias("n_instructions"),
        (F.max("top_layer") + 1).alias("n_layers"),
        F.min("n").alias("min_records"),
        F.max("n").alias("max_records"),
        F.avg("n").alias("records_per_instruction"),
    ]
    if states is not None:
        totals.append(F.count_if(F.col("n").isNull()).alias("n_failed"))
    return counted.agg(*totals)
