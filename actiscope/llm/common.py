"""Registration of queries, table access and small helpers of the subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unit_hash(*parts: Column | str) -> Column:
    """A number in [0, 1) from the parts: 52 bits of MD5, the same in any SQL engine."""
    digest = F.md5(F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def slices(texts: Iterable, size: Callable = len, most: int = 1_000_000) -> Iterator[list]:
    """Runs of items of about ``most`` in total size; a larger item is a run of its own."""
    held, total = [], 0
    for item in texts:
        held.append(item)
        total += size(item)
        if total >= most:
            yield held
            held, total = [], 0
    if held:
        yield held


ROWS_AT_ONCE = 256


def rows_of(batches: Iterable[pa.RecordBatch], columns: int | None = None) -> Iterator[tuple]:
    """Rows as tuples, made a few at a time, since a row can hold a long text, a set or packed windows."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS_AT_ONCE):
            part = b.slice(at, ROWS_AT_ONCE)
            yield from zip(*(part.column(i).to_pylist() for i in range(columns or b.num_columns)))


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores until no column in ``taken`` has it in any case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def release_memory() -> None:
    """Give freed memory of a worker back to the system, where its C library can: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, after which its worker gives freed memory back."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        release_memory()

    return wrapped
