"""Reading stored records."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actiscope.operators.sampling import stratified_sample
from actiscope.schema import RECORD_SCHEMA, SAMPLE_SIZE, SEED
from actiscope.session import broadcast_if_small, stored

MAX_FETCH_FILES = 100_000
PARTITION_BYTES = 128 << 20
CACHE_BYTES = 1 << 40


def scan_records(spark: SparkSession, path: str, schema: T.StructType = RECORD_SCHEMA, locate: bool = False) -> DataFrame:
    """All ``*.parquet`` files of a directory as one table.

    The schema is given, so no file is opened to infer it; other files next to
    the parts are ignored. A directory without parts is an error. With
    ``locate`` the columns ``file_path`` and ``row_index`` say where a row lies.
    """
    try:
        df = spark.read.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path)
        parts = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
        found = not parts.select("length").isEmpty()  # one row of the listing; no file is opened
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = False
    if not found:
        raise FileNotFoundError(f"no .parquet files in {path}")
    columns = [F.col(n) for n in schema.names]
    if locate:
        columns += [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
    return df.select(*columns)


def scan_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels and layers only; the vectors are not read."""
    return scan_records(spark, path).select("label", "layer_index")


def filter_layer(df: DataFrame, layer: int, layer_col: str = "layer_index") -> DataFrame:
    return df.where(F.col(layer_col) == layer)


def row_locator(spark: SparkSession, path: str, layer: int | None = None, schema: T.StructType = RECORD_SCHEMA) -> DataFrame:
    """Address and label of each row: file_path, row_index, sample_id, layer_index, label."""
    rows = scan_records(spark, path, schema, locate=True)
    if layer is not None:
        rows = filter_layer(rows, layer)
    return rows.select("file_path", "row_index", "sample_id", "layer_index", "label")


def fetch_rows(spark: SparkSession, path: str, addresses: DataFrame, schema: T.StructType = RECORD_SCHEMA) -> DataFrame:
    """Records at the given (file_path, row_index) addresses.

    When the addresses lie in few files only those are opened. The address
    list is broadcast only if it was counted to be small.
    """
    files = [r[0] for r in addresses.select("file_path").distinct().limit(MAX_FETCH_FILES + 1).collect()]
    if 0 < len(files) <= MAX_FETCH_FILES:
        rows = spark.read.schema(schema).option("basePath", path).parquet(*map(unquote, files))
        rows = rows.select(*schema.names, F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    else:
        rows = scan_records(spark, path, schema, locate=True)
    wanted = broadcast_if_small(addresses.select("file_path", "row_index"), 200_000)
    return rows.join(wanted, ["file_path", "row_index"], "left_semi").select(*schema.names)


def sample_records(
    spark: SparkSession, path: str, n_samples: int = SAMPLE_SIZE, seed: int = SEED, schema: T.StructType = RECORD_SCHEMA
) -> DataFrame:
    """A stratified sample of stored records that reads few vectors.

    The sample is drawn on ids and labels with their addresses; only the parts
    that hold a drawn row are then read in full.
    """
    drawn = stratified_sample(row_locator(spark, path, schema=schema), "sample_id", "label", n_samples, seed)
    return fetch_rows(spark, path, stored(drawn.select("file_path", "row_index"), "drawn"), schema)


def cached_records(df: DataFrame, layer: int | None = None) -> DataFrame:
    """Rows kept on the executors for several fits; what does not fit spills to disk."""
    return (df if layer is None else filter_layer(df, layer)).persist(StorageLevel.MEMORY_AND_DISK)


def training_rows(df: DataFrame, n_rows: int, row_bytes: int, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """Rows made ready for many passes: no more partitions than their size asks
    for (but one per core), and cached while they fit ``cache_bytes``. Larger
    sets are read from their source in every pass."""
    size = n_rows * row_bytes
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-size // PARTITION_BYTES))
    df = df.coalesce(parts)
    return cached_records(df) if size <= cache_bytes else df
