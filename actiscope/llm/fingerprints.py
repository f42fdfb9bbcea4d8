"""Document fingerprints by winnowing.

Every k code points give a rolling hash, every run of ``window`` hashes keeps its
smallest one (the rightmost of equals), with its position. Two texts that share
``window + k - 1`` consecutive characters therefore share a fingerprint, whose
positions say where.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actiscope.llm.common import shuffle_partitions

GRAM = 16
WINDOW = 33
BASE = np.uint64(0x9E3779B97F4A7C15)
FINGERPRINT = T.StructType(
    [T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("positions", T.ArrayType(T.IntegerType()))]
)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(BASE), n, 1 << 64))


def rolling_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """32-bit hashes of every run of k points, built from runs of doubled length."""
    run, have, h = points.astype(np.uint64) + np.uint64(1), 1, None
    done = 0
    with np.errstate(over="ignore"):
        while True:
            if k & have:
                h = run if h is None else h[: len(run) - done] * _power(have) + run[done:][: len(h)]
                done += have
                if done == k:
                    break
            run = run[:-have] * _power(have) + run[have:]
            have *= 2
            if h is not None:
                h = h[: len(points) - k + 1]
        h = h[: len(points) - k + 1]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return (h ^ (h >> np.uint64(32))) & np.uint64(0xFFFFFFFF)


def winnow(text: str, k: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of a text, by position.

    A text shorter than k is one gram; one with fewer than ``window`` grams is one
    window; an empty one has no fingerprint.
    """
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(points)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    hashes = rolling_hashes(points, min(k, n))
    # Smallest hash first, of equals the rightmost.
    least = (hashes << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(len(hashes), dtype=np.uint64))
    if len(least) <= window:
        least = least.min(keepdims=True)
    else:
        have = 1
        while 2 * have <= window:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < window:
            least = np.minimum(least[: have - window], least[window - have :])
        least = least[np.concatenate(([True], least[1:] != least[:-1]))]
    return least >> np.uint64(32), (np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes; two empty ones are alike, an empty one is unlike any other."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    a, b = np.unique(a), np.unique(b)
    both = len(a) + len(b) - len(np.unique(np.concatenate((a, b))))
    return both / (len(a) + len(b) - both)


def written(hashes: np.ndarray, positions: np.ndarray) -> str:
    """A fingerprint as text: Base64 of pairs of 32-bit hash and position, big-endian."""
    pairs = np.empty((len(hashes), 2), ">u4")
    pairs[:, 0], pairs[:, 1] = hashes, positions
    return base64.b64encode(pairs.tobytes()).decode()


def fingerprints(docs: DataFrame, k: int = GRAM, window: int = WINDOW, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with a column of hashes and positions; a null text is an empty one. Nothing moves.

    A column that is already called ``out`` is replaced.
    """

    @F.pandas_udf(FINGERPRINT)
    def of(texts: pd.Series) -> pd.DataFrame:
        found = [winnow(t or "", k, window) for t in texts]
        return pd.DataFrame({"hashes": [h.astype(np.int64) for h, _ in found], "positions": [p.astype(np.int32) for _, p in found]})

    return docs.withColumn(out, of(F.col(text)))


def matches(marked: DataFrame, other: DataFrame, id_col: str = "doc_id", fingerprint: str = "fingerprint") -> DataFrame:
    """Places that two sets of fingerprinted documents share: ``id_a, id_b, position_a, position_b``.

    Identical occurrences are all listed, so the result has as many rows as there are matches.
    """

    def places(df: DataFrame, side: str) -> DataFrame:
        f = F.col(fingerprint)
        pairs = df.select(F.col(id_col).alias(f"id_{side}"), F.explode(F.arrays_zip(f["hashes"].alias("h"), f["positions"].alias("p"))).alias("x"))
        return pairs.select(f"id_{side}", F.col("x.h").alias("hash"), F.col("x.p").alias(f"position_{side}"))

    return places(marked, "a").join(places(other, "b"), "hash").drop("hash")


def in_order_with_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``bucket, tail, id, text`` dealt by ranges of ids and sorted in each partition.

    A bucket is a range of ids; the first document of the next one (of the first, after
    the last) follows it as its tail, so that each row finds its successor behind it.
    A null id counts as the smallest; rows that share an id follow each other by text.
    Only the bounds and first ids of the buckets, one per shuffle partition, reach the driver.
    """
    spark = docs.sparkSession
    lowest = -(1 << 63)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(lowest)).alias("rank"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = shuffle_partitions(spark)
    cuts = np.array(rows.select("rank").approxQuantile("rank", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else [])
    cuts = np.unique(cuts)

    @F.pandas_udf("int")
    def bucket(rank: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, rank.to_numpy(), "right").astype(np.int32))

    starts = {r.b: r.s for r in rows.groupBy(bucket("rank").alias("b")).agg(F.min("rank").alias("s")).collect()}
    order = sorted(starts)
    before = {b: order[i - 1] for i, b in enumerate(order)}

    @F.pandas_udf("array<int>")
    def places(rank: pd.Series) -> pd.Series:
        found = np.searchsorted(cuts, rank.to_numpy(), "right")
        return pd.Series([[b, before[b]] if starts.get(b) == r else [b] for b, r in zip(found.tolist(), rank.tolist())])

    return (
        rows.withColumn("to", places("rank"))
        .select(F.posexplode("to").alias("tail", "bucket"), "rank", "id", "text")
        .repartitionById(n, "bucket")  # one bucket a task, where a hash would put several into some
        .sortWithinPartitions("bucket", "tail", "rank", "text")
    )


def edited_texts(text: str, following: str) -> str:
    """The text with its last quarter replaced by as many of the first characters of another."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def fingerprint_edits(docs: DataFrame, k: int = GRAM, window: int = WINDOW, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint of every document and of its edited text, and their likeness.

    Columns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``. A null text is an empty one; likeness of two empty texts is 1, of an empty
    and another 0. A table of one document follows itself; an empty table gives no rows.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_chars", T.LongType())])
    for name in ("edited_sha256", "fingerprint", "edited_fingerprint"):
        schema.add(name, "string")
    schema.add("near_edited", "double").add("near_next", "double")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("bucket", "tail", "id", "text")))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        last = None
        for bucket, tail, doc, content in rows(batches):
            mark = None
            if last and last[0] == bucket and not last[1]:
                mark = winnow(content, k, window)
                yield last[2], last[3], content, last[4], mark
            if not tail:
                last = (bucket, tail, doc, content, mark or winnow(content, k, window))
            else:
                last = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for doc, content, following, mark, next_mark in scored(batches):
            edited = edited_texts(content, following)
            other = winnow(edited, k, window)
            out.append(
                (doc, len(content), hashlib.sha256(edited.encode()).hexdigest(), written(*mark), written(*other), likeness(mark[0], other[0]), likeness(mark[0], next_mark[0]))
            )
            size += len(content)
            if size > 4_000_000:
                yield _batch(out, schema)
                out, size = [], 0
        if out:
            yield _batch(out, schema)

    return in_order_with_next(docs, id_col, text).select("bucket", "tail", "id", "text").mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

