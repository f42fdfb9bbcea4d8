"""Records as a bucketed table, joined where they lie.

Rows of one instruction share a bucket, sorted by layer and label, so that looking for what is missing and
scoring read the stored side as it is: only the other side, of ids and predictions, is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actiscope.plans.generate import build_records
from actiscope.schema import LABELS, RECORD_SCHEMA, SEED
from actiscope.session import broadcast_if_small, stored

BUCKETS = 1024
KEY = "instruction_id"


def write_table(records: DataFrame, table: str, buckets: int = BUCKETS, mode: str = "append", path: str | None = None) -> None:
    """Append records; each task of the shuffle writes the files of its own buckets. A new table lies in ``path``, if given, else in the warehouse."""
    rows = records.select(*RECORD_SCHEMA.names).repartition(buckets, KEY)
    writer = rows.write.mode(mode).format("parquet").bucketBy(buckets, KEY).sortBy(KEY, "layer_index", "label")
    (writer if path is None else writer.option("path", path)).saveAsTable(table)


def scan_table(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table).select(*RECORD_SCHEMA.names)


def pending_in_table(states: DataFrame, table: str) -> DataFrame:
    """Ids (instruction_id, layer_index) whose layer lacks a label in the table. Vectors of neither side are read."""
    mine = states.select(KEY, "layer_index").distinct()
    if not states.sparkSession.catalog.tableExists(table):
        return mine
    # Grouped within the bucket and joined by its key alone; an instruction has few layers.
    whole = scan_table(states.sparkSession, table).groupBy(KEY, "layer_index").agg(F.count_distinct("label").alias("n")).where(F.col("n") == len(LABELS))
    held = whole.groupBy(KEY).agg(F.collect_list("layer_index").alias("held"))
    found = mine.join(held.hint("merge"), KEY, "left")
    return found.where(F.col("held").isNull() | ~F.array_contains("held", F.col("layer_index"))).select(KEY, "layer_index")


def resume_table(states: DataFrame, table: str, buckets: int = BUCKETS, model_name: str = "model", seed: int = SEED, engine: str = "arrow") -> None:
    """Add the records the table lacks, down to a single label of a layer."""
    spark = states.sparkSession
    todo = stored(pending_in_table(states, table), "pending")
    if todo.isEmpty():
        return
    records = build_records(states.join(broadcast_if_small(todo), [KEY, "layer_index"], "left_semi"), model_name, seed, engine)
    if spark.catalog.tableExists(table):
        there = stored(spark.table(table).select(KEY, "layer_index", "label").join(broadcast_if_small(todo), [KEY, "layer_index"], "left_semi"), "there")
        if not there.isEmpty():
            records = records.join(broadcast_if_small(there), [KEY, "layer_index", "label"], "left_anti")
    write_table(records, table, buckets)


def score_table(scored: DataFrame, table: str) -> DataFrame:
    """Predictions (instruction_id, sample_id, ...) that have a record in the table, with its ``layer_index`` and ``label``."""
    own = F.struct("sample_id", "layer_index", "label")
    truth = scored.sparkSession.table(table).groupBy(KEY).agg(F.collect_list(own).alias("_own"))
    found = scored.join(truth.hint("merge"), KEY).withColumn("_own", F.explode(F.filter("_own", lambda r: r["sample_id"] == F.col("sample_id"))))
    return found.select(*scored.columns, "_own.layer_index", "_own.label")
