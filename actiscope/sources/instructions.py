"""Reading instruction texts in source order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from actiscope.functions.text import compose_prompt
from actiscope.schema import DATASET_SIZE
from actiscope.session import stored

TOP_K_ROWS = 100_000


def number_rows(df: DataFrame, key: str, out: str = "position") -> DataFrame:
    """Unique keys numbered from 0 in key order, without sorting them in one task.

    The keys are range-partitioned and written once, so every later step sees
    the same partitions; a key's number is its place within the partition plus
    the rows of the partitions before it.
    """
    ranged = df.select(key).repartitionByRange(key)
    keyed = stored(ranged.select(key, F.spark_partition_id().alias("_part")), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        keyed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    within = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return (
        keyed.withColumn("_within", within)
        .join(F.broadcast(starts), "_part")  # one row per partition
        .select(key, (F.col("_start") + F.col("_within") - 1).alias(out))
    )


def first_keys(df: DataFrame, key: str, n: int, out: str = "position") -> DataFrame:
    """The first ``n`` keys in order, numbered from 0."""
    if n <= TOP_K_ROWS:
        top = df.select(key).orderBy(key).limit(n)
        return top.select(key, (F.row_number().over(Window.orderBy(key)) - 1).cast("bigint").alias(out))
    return number_rows(df, key, out).where(F.col(out) < n)


def load_instructions(
    source: DataFrame,
    order_key: str,
    n: int = DATASET_SIZE,
    instruction: str = "instruction",
    extra: str = "input",
) -> DataFrame:
    """The first ``n`` instructions: ``instruction_id`` from 0 and the composed text.

    ``order_key`` must be unique. Only keys are ordered; texts join their
    number and never pass through one task.
    """
    ids = first_keys(source, order_key, n, "instruction_id")
    small = F.broadcast(ids) if n <= TOP_K_ROWS else ids
    text = compose_prompt(F.col(instruction), F.col(extra)).alias("text")
    return source.join(small, order_key).select(F.col("instruction_id").cast("int"), order_key, text)


def instructions_from_conversations(conversations: DataFrame) -> DataFrame:
    """One (conv_id, instruction, input) row per conversation: its first user
    turn, and the system turn where there is one."""
    user, turn = F.col("role") == "user", F.col("turn")
    first = F.min_by(F.when(user, F.col("text")), F.when(user, turn))
    system = F.max(F.when((F.col("role") == "system") & (turn == 0), F.col("text")))
    return conversations.groupBy("conv_id").agg(first.alias("instruction"), system.alias("input"))
