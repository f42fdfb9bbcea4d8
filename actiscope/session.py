"""Session settings, the shared work folder and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000
"""Rows a broadcast side may hold; all such sides here are a few numbers or a
short id per row, so this is well under 100 MB."""

_local_work_dirs: dict[str, str] = {}
_passing: ContextVar[str | None] = ContextVar("passing", default=None)


def build_session(master: str | None = None, app: str = "actiscope", shuffle_partitions: int | None = None, **conf) -> SparkSession:
    """A session with adaptive execution on and batches sized for wide vectors."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Both limits count rows; at 16 KB a vector the defaults make batches of 64-160 MB.
        .config("spark.sql.parquet.columnarReaderBatchSize", "1024")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def work_root(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, only
    a local session may fall back to a temporary folder: executors on other
    machines could not read it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = context.applicationId
    if app not in _local_work_dirs:
        _local_work_dirs[app] = tempfile.mkdtemp(prefix="actiscope-")
    return _local_work_dirs[app]


def new_work_dir(spark: SparkSession, purpose: str) -> str:
    """A path under the work folder that no other run uses."""
    return os.path.join(_passing.get() or work_root(spark), f"{purpose}-{uuid.uuid4().hex}")


@contextmanager
def passing_tables(spark: SparkSession, purpose: str) -> Iterator[None]:
    """Tables that are stored inside, unless at a path made outside, are deleted at the end: nothing that outlives it may read them."""
    path = new_work_dir(spark, purpose)
    token = _passing.set(path)
    try:
        yield
    finally:
        _passing.reset(token)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, purpose: str, path: str | None = None) -> DataFrame:
    """Write a small intermediate table, to a new folder unless ``path`` names one, and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = path or new_work_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast only when it was counted to be small.

    The count stops at ``max_rows + 1``. Beyond the limit the plain DataFrame
    comes back and Spark joins it by shuffling, so the result is the same.
    Pass tables that are cheap to read twice, such as the output of ``stored``.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
