"""The record schema, the label table and the default settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Label ids and names are part of the stored data.
LABELS = {
    0: "honest",
    1: "silent_precision_downgrade",
    2: "identity_forgery",
    3: "random_noise",
    4: "adversarial_perturbation",
}
LABEL_NAMES = list(LABELS.values())

# The seven stored columns, in order.
RECORD_SCHEMA = T.StructType(
    [
        T.StructField("sample_id", T.StringType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("instruction_id", T.IntegerType()),
        T.StructField("layer_index", T.IntegerType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("label_name", T.StringType()),
        T.StructField("hidden_state_vector", T.ArrayType(T.FloatType())),
    ]
)

LAYER_STATE_SCHEMA = T.StructType(
    [
        T.StructField("instruction_id", T.IntegerType()),
        T.StructField("layer_index", T.IntegerType()),
        T.StructField("input_vec", T.ArrayType(T.FloatType())),
        T.StructField("output_vec", T.ArrayType(T.FloatType())),
    ]
)

# Defaults a run uses when nothing else is asked for.
DATASET_SIZE = 5000
MAX_RECORDS_PER_FILE = 10_000
MAX_TOKENS = 2048
PCA_DIM = 128
VAL_SIZE = 0.15
TEST_SIZE = 0.15
SEED = 42
SAMPLE_SIZE = 100_000
EPOCHS = 50
BATCH_SIZE = 512
LEARNING_RATE = 1e-3
STOP_PATIENCE = 8
PLATEAU_PATIENCE = 3
PLATEAU_FACTOR = 0.5
MIN_CLASS_ROWS = 3


def label_name(label: Column) -> Column:
    """Name of a label id; an id outside the table fails the query.

    The table has five rows, so it travels as a literal map inside the
    projection and needs no join.
    """
    table = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    name = F.element_at(table, label.cast("int"))
    return F.coalesce(
        name,
        F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label.cast("string"), F.lit("null")))).cast(
            "string"
        ),
    )
