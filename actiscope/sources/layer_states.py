"""Layer states and token states made from a table of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def layer_states_from_vectors(vectors: DataFrame, layers: int = 8, vec_id="vec_id", vec="embedding") -> DataFrame:
    """Read every ``layers + 1`` consecutive vectors as one pass through a stack.

    The first plays the embedding output; each later one is the output of a
    layer whose input is the vector before it. A group never holds more than
    ``layers + 1`` rows.
    """
    step = layers + 1
    placed = vectors.select(
        F.expr(f"cast({vec_id} div {step} as int)").alias("instruction_id"),
        F.expr(f"cast({vec_id} % {step} - 1 as int)").alias("layer_index"),
        F.col(vec).alias("output_vec"),
    )
    order = Window.partitionBy("instruction_id").orderBy("layer_index")
    return (
        placed.withColumn("input_vec", F.lag("output_vec").over(order))
        .where("layer_index >= 0")
        .select("instruction_id", "layer_index", "input_vec", "output_vec")
    )


def token_states_from_vectors(vectors: DataFrame, tokens: int = 4, vec_id="vec_id", vec="embedding") -> DataFrame:
    """Every ``tokens`` consecutive vectors as the tokens of one text, in order."""
    return (
        vectors.groupBy(F.expr(f"cast({vec_id} div {tokens} as int)").alias("instruction_id"))
        .agg(F.sort_array(F.collect_list(F.struct(vec_id, vec))).alias("rows"))
        .select("instruction_id", F.col(f"rows.{vec}").alias("states"))
    )
