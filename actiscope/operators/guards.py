"""Checks on captured layer states, applied before anything is generated.

A layer whose input or output is not finite loses that layer only. An
instruction with a layer of unequal input and output length, or with a variant
that overflows, is dropped as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actiscope.functions import vectors
from actiscope.session import BROADCAST_ROWS, stored


def drop_groups(df: DataFrame, offenders: DataFrame, key: str, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``df`` whose key is not among the offenders.

    The offenders are found in one pass that is written to the work folder, so
    the wide rows are not shuffled when there are none (no join) or few
    (counted, then broadcast). Only a long list costs a shuffle of ``df``.
    """
    bad = stored(offenders.select(key).distinct(), "offenders")
    n = bad.limit(max_rows + 1).count()
    if n == 0:
        return df
    return df.join(F.broadcast(bad) if n <= max_rows else bad, key, "left_anti")


def shape_offenders(states: DataFrame, input_vec="input_vec", output_vec="output_vec", key="instruction_id") -> DataFrame:
    return states.where(~F.expr(vectors.same_shape(input_vec, output_vec))).select(key)


def shape_guard(states: DataFrame, input_vec="input_vec", output_vec="output_vec", key="instruction_id") -> DataFrame:
    return drop_groups(states, shape_offenders(states, input_vec, output_vec, key), key)


def finite_guard(states: DataFrame, input_vec="input_vec", output_vec="output_vec") -> DataFrame:
    return states.where(F.expr(vectors.is_finite(input_vec)) & F.expr(vectors.is_finite(output_vec)))


def finite_drops(
    states: DataFrame, input_vec="input_vec", output_vec="output_vec", layer="layer_index"
) -> DataFrame:
    """Per layer: rows seen, rows dropped for a bad input, rows dropped for a bad output."""
    bad_in = ~F.expr(vectors.is_finite(input_vec))
    bad_out = ~F.expr(vectors.is_finite(output_vec))
    return states.groupBy(layer).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(bad_in).alias("n_bad_input"),
        F.count_if(~bad_in & bad_out).alias("n_bad_output"),
    )


def variant_finite_guard(records: DataFrame, vector="hidden_state_vector") -> tuple[DataFrame, DataFrame]:
    """Records fit to be stored, and the others for a quarantine table."""
    good = F.expr(vectors.is_finite(vector))
    return records.where(good), records.where(~good)


def last_tokens(token_states: DataFrame, states="states", out="vector") -> DataFrame:
    return token_states.withColumn(out, F.expr(vectors.last_token(states))).drop(states)
