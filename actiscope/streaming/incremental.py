"""Restartable generation: in batches, and as a stream of arriving files.

In batches, progress is what the sink holds: any layer that lacks a label there is processed,
including ones that failed before. A stream knows by keyed state which layers have come.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actiscope.operators.guards import drop_groups
from actiscope.plans.generate import build_records, failing_instructions
from actiscope.schema import LABELS, LAYER_STATE_SCHEMA, MAX_RECORDS_PER_FILE, RECORD_SCHEMA, SEED
from actiscope.session import BROADCAST_ROWS, broadcast_if_small, stored
from actiscope.sources.records import fetch_rows, scan_records
from actiscope.sources.sinks import write_records

LAYER = ("instruction_id", "layer_index")
ROW = (*LAYER, "label")


def pending_states(
    states: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("instruction_id",), max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Layer states whose key is not among the done ones.

    Keys are compared first, without vectors; the done side is cut to the range
    of the first key, which skips stored parts outside it. The wide rows are
    then filtered by the shorter of the two key lists when that is small enough
    to broadcast, and shuffled only when both are long.
    """
    mine = stored(states.select(*keys).distinct(), "keys")
    low, high = mine.agg(F.min(keys[0]), F.max(keys[0])).first()
    if low is None:
        return states
    near = done.where(F.col(keys[0]).between(low, high)).select(*keys)
    both = stored(near.join(broadcast_if_small(mine, max_rows), list(keys), "left_semi").distinct(), "done")
    n_both = both.limit(max_rows + 1).count()
    if n_both == 0:
        return states
    if n_both <= max_rows:
        return states.join(F.broadcast(both), list(keys), "left_anti")
    pending = stored(mine.join(both, list(keys), "left_anti"), "pending")
    if pending.limit(max_rows + 1).count() <= max_rows:
        return states.join(F.broadcast(pending), list(keys), "left_semi")
    return states.join(both, list(keys), "left_anti")


def sink_rows(spark: SparkSession, sink: str) -> DataFrame:
    """Instructions, layers and labels the sink holds; an absent or empty sink holds none."""
    try:
        return scan_records(spark, sink).select(*ROW)
    except FileNotFoundError:
        return spark.createDataFrame([], "instruction_id int, layer_index int, label int")


def lacking(states: DataFrame, sink: str, whole: bool = True) -> tuple[DataFrame, DataFrame]:
    """Layer states whose layer lacks a label in the sink, and the rows that exist of them.

    With ``whole`` all layers of such an instruction come back, so that a bad one among
    them is seen. Only ids of the sink are read.
    """
    spark = states.sparkSession
    rows = sink_rows(spark, sink)
    held = rows.groupBy(*LAYER).agg(F.count_distinct("label").alias("n")).where(F.col("n") == len(LABELS))
    todo = stored(pending_states(states.select(*LAYER), held, LAYER).distinct(), "todo")
    key = LAYER[:1] if whole else LAYER
    some = stored(todo.select(*key).distinct(), "some") if whole else todo
    near = broadcast_if_small(some)
    return states.join(near, list(key), "left_semi"), rows.join(near, list(key), "left_semi")


def resume_generation(
    states: DataFrame,
    sink: str,
    model_name: str = "model",
    seed: int = SEED,
    engine: str = "arrow",
    max_records: int = MAX_RECORDS_PER_FILE,
    whole: bool = True,
) -> None:
    """Generate and append the records the sink lacks, down to a single label of a layer.

    An instruction with a bad layer adds nothing, and a layer that isn't finite is
    looked at again in every run.
    """
    todo, there = lacking(states, sink, whole)
    there = stored(there.distinct(), "there")
    records = build_records(todo, model_name, seed, engine)
    if not there.isEmpty():
        records = records.join(broadcast_if_small(there), list(ROW), "left_anti")
    write_records(records, sink, max_records)


def once(states: DataFrame) -> DataFrame:
    """One row per (instruction, layer), of several the one with the smallest vectors.

    Keys are checked first, on ids alone; vectors are shuffled only when some key is doubled.
    """
    doubled = states.groupBy(*LAYER).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if doubled.isEmpty():
        return states
    return states.groupBy(*LAYER).agg(F.min(F.struct("input_vec", "output_vec")).alias("v")).select(*LAYER, "v.*")


def failed_folder(sink: str) -> str:
    return f"{sink.rstrip('/')}_failed"


def failed_instructions(spark: SparkSession, sink: str) -> DataFrame:
    """Instructions that a stream found a bad layer of."""
    try:
        return spark.read.schema("instruction_id int").parquet(failed_folder(sink)).distinct()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "instruction_id int")


def streamed_records(spark: SparkSession, sink: str) -> DataFrame:
    """What a stream has built: the records of its sink but for failed instructions, whose other layers may have come earlier."""
    failed = broadcast_if_small(stored(failed_instructions(spark, sink), "failed"))
    return scan_records(spark, sink).join(failed, "instruction_id", "left_anti").select(*RECORD_SCHEMA.names)


def _foreign(spark: SparkSession, sink: str, checkpoint: str) -> DataFrame | None:
    """Rows the sink held before the stream's first start: looked up then, and kept next to its checkpoint."""
    folder = f"{checkpoint.rstrip('/')}_held_before"
    schema = "instruction_id int, layer_index int, label int"
    try:
        held = spark.read.schema(schema).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        sink_rows(spark, sink).distinct().write.parquet(folder)
        held = spark.read.schema(schema).parquet(folder)
    return None if held.isEmpty() else held


def stream_generation(
    spark: SparkSession,
    source: str,
    sink: str,
    checkpoint: str,
    model_name: str = "model",
    seed: int = SEED,
    engine: str = "arrow",
    files_per_batch: int = 1000,
    max_records: int = MAX_RECORDS_PER_FILE,
    remember: str | None = None,
):
    """Process the layer-state files that arrived since the last call, then stop.

    The stream carries ids and addresses of rows. Which layers have come before is keyed state, so a layer that is delivered
    again, in any file, adds nothing; ``remember`` (such as "30 days" of file times) bounds that state, without it nothing is
    forgotten. The vectors of new layers are then fetched by address and never shuffled. The sink is read once
    per start, for its first batch, which may be a repetition of one that died while it wrote; rows that were there before
    the first start are kept as a list of ids. Layers of one instruction may arrive apart, in any files: one
    with a bad layer is listed in the failed folder, and ``streamed_records`` leaves all of it out,
    as a batch run does.
    """
    foreign, seen = _foreign(spark, sink, checkpoint), set()

    def process(batch: DataFrame, batch_id: int) -> None:
        new = stored(batch.select("file_path", "row_index"), "new")
        if new.isEmpty():
            return
        states = fetch_rows(spark, source, new, LAYER_STATE_SCHEMA)
        bad = stored(failing_instructions(states, seed).distinct(), "bad")
        if not bad.isEmpty():
            bad.write.mode("append").parquet(failed_folder(sink))
        good = drop_groups(states, failed_instructions(spark, sink), "instruction_id")
        if not seen:
            resume_generation(good, sink, model_name, seed, engine, max_records, whole=False)
        else:
            made = build_records(good, model_name, seed, engine)
            write_records(made if foreign is None else made.join(broadcast_if_small(foreign), list(ROW), "left_anti"), sink, max_records)
        seen.add(batch_id)

    arriving = (
        spark.readStream.schema(LAYER_STATE_SCHEMA)
        .option("pathGlobFilter", "*.parquet")
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(source)
        .select(*LAYER, "_metadata.file_path", "_metadata.row_index", F.col("_metadata.file_modification_time").alias("arrived"))
    )
    if remember is None:
        once_each = arriving.dropDuplicates(list(LAYER))
    else:
        once_each = arriving.withWatermark("arrived", remember).dropDuplicatesWithinWatermark(list(LAYER))
    query = (
        once_each.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
