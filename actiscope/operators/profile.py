"""Counts that describe a set of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from actiscope.schema import LABEL_NAMES, MIN_CLASS_ROWS, label_name


def record_counts(df: DataFrame, vector: str = "hidden_state_vector", file_col: str | None = None) -> DataFrame:
    """Rows, vector length (smallest and largest) and, given a file column, files."""
    keys = [file_col] if file_col else []
    per_file = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.size(vector)).alias("lo"), F.max(F.size(vector)).alias("hi")
    )
    out = [F.sum("n").alias("n_records"), F.min("lo").alias("min_dim"), F.max("hi").alias("max_dim")]
    if file_col:
        out.append(F.count(F.lit(1)).alias("n_files"))
    return per_file.agg(*out)


def distinct_layers(df: DataFrame, layer: str = "layer_index") -> DataFrame:
    return df.select(layer).distinct().orderBy(layer)


def class_names(df: DataFrame, label: str = "label") -> DataFrame:
    classes = df.select(F.col(label).alias("label")).distinct()
    return classes.select("label", label_name(F.col("label")).alias("label_name")).orderBy("label")


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()  # one row per class
    return counts.withColumn("share", F.col("n") / F.sum("n").over(everything)).orderBy(label)


def layer_label_pivot(
    df: DataFrame, layer: str = "layer_index", name: str = "label_name", names: list[str] | None = None
) -> DataFrame:
    return df.groupBy(layer).pivot(name, names or LABEL_NAMES).count().orderBy(layer)


def eligible_layers(
    df: DataFrame, layer: str = "layer_index", label: str = "label", min_rows: int = MIN_CLASS_ROWS
) -> DataFrame:
    """Layers whose smallest class has enough rows to be split."""
    return (
        df.groupBy(layer, label)
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(layer)
        .agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_labels"), F.min("n").alias("smallest"))
        .where(F.col("smallest") >= min_rows)
    )


def n_classes(df: DataFrame, label: str = "label") -> DataFrame:
    return df.agg((F.max(label) + 1).alias("n_classes"))


def sample_share(total: DataFrame, sample: DataFrame) -> DataFrame:
    """Rows sampled, rows in all, and the share in per cent."""
    whole = total.agg(F.count(F.lit(1)).alias("n_total"))
    part = sample.agg(F.count(F.lit(1)).alias("n_sampled"))
    both = whole.select("n_total", F.lit(0).cast("bigint").alias("n_sampled")).unionByName(
        part.select(F.lit(0).cast("bigint").alias("n_total"), "n_sampled")
    )
    return both.agg(F.sum("n_sampled").alias("n_sampled"), F.sum("n_total").alias("n_total")).withColumn(
        "percent", 100 * F.col("n_sampled") / F.when(F.col("n_total") > 0, F.col("n_total"))
    )
