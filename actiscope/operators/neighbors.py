"""Exact nearest neighbours by blocks.

Queries and base rows are dealt by hash into blocks whose bytes and rows are bounded, and every
block of queries meets every block of base rows once. A pair of blocks returns at
most k rows per query, found by matrix multiplication; pairs of rows are never written
out. The work is that of brute force: bound it by the base, whose rows are labelled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 9
"""Squared distances are compared after rounding to this many places; ties go
to the smaller base id."""

BLOCK_BYTES = 32 << 20
"""Bytes of vectors in a block of either side."""
BLOCK_ROWS = 16_384
"""Rows in a block of either side: short vectors are few bytes, but the work of a pair of blocks is the product of their rows."""
PAIRS_PER_CORE = 6
"""Pairs of blocks for each core, from which on blocks hold more rows: every row travels once per block of the other side."""
PRODUCT_CELLS = 500_000
"""Distances held at once."""
FIRST_ROWS, SLICE_ROWS = 256, 4_096
"""Base rows of a block that are looked at together, at first and then: later ones need be no further away than the k nearest so far."""
TASKS_PER_PAIR, TASKS_PER_CORE = 4, 64
"""Tasks that pairs of blocks are dealt to by hash, so that most have one of their own, and the most of them for each core."""


def block_rows(width: int, block_bytes: int = BLOCK_BYTES, most: int = 0) -> int:
    """Rows of vectors of ``width`` values that make a block: ``BLOCK_ROWS``, or ``most`` if that is more, as far as the bytes allow."""
    return max(1, min(max(BLOCK_ROWS, most), block_bytes // (8 * max(1, width))))


def _matrix(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    if not len(lists):
        return np.zeros((0, 0))
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(lists), -1)


def _meetings(asked: pa.ChunkedArray, slots: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each slot the places of the queries whose bits in ``asked`` have it, and of its base rows."""
    bits = np.frombuffer(b"".join(asked.to_pylist()), np.uint8).reshape(len(asked), -1)
    order = np.argsort(slots, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(slots[order])) + 1):
        slot = int(slots[rows[0]])
        yield np.flatnonzero(bits[:, slot >> 3] >> (slot & 7) & 1), rows


def _improve(found: np.ndarray, near: np.ndarray, q: np.ndarray, b: np.ndarray, sums: tuple[np.ndarray, np.ndarray], asks: np.ndarray, rows: np.ndarray) -> None:
    """Look among the base ``rows`` for what is nearer to the queries ``asks`` than the k distances ``found`` so far, at the places ``near``."""
    k = found.shape[1]
    q_sums, b_sums = sums
    # The expansion of the square can be off by rounding; what is within the slack is computed exactly.
    slack, unit = 1e-12 * (q_sums[asks].max() + b_sums[rows].max()), 10.0**-DIGITS
    width = min(SLICE_ROWS, len(rows))
    step = max(1, PRODUCT_CELLS // width)
    room = np.empty(step * width)  # one for all products: fresh pages would cost as much as they do
    for mine in np.split(rows, range(FIRST_ROWS, len(rows), SLICE_ROWS)):
        base, most = b[mine], min(k, len(mine)) - 1
        doubled = np.vstack((-2 * base.T, b_sums[mine]))
        for at in range(0, len(asks), step):
            who = asks[at : at + step]
            part = q[who]
            rough = room[: len(who) * len(mine)].reshape(len(who), -1)
            np.matmul(np.column_stack((part, np.ones(len(who)))), doubled, out=rough)  # squared distances, less the query's own sum
            last = found[who, -1]
            fewer = np.flatnonzero(last == np.inf)
            if len(fewer):
                last[fewer] = np.partition(rough[fewer], most, axis=1)[:, most] + q_sums[who[fewer]]
            # A found distance is rounded: what equals it is off by half a unit at most, what is less by more, and the equal counts where its place is less.
            last += slack + np.where(near[who, -1] > mine[0], 0.6, -0.4) * unit
            last[fewer] += 0.6 * unit
            row, col = np.divmod(np.flatnonzero(rough <= (last - q_sums[who])[:, None]), len(mine))
            exact = np.empty(len(row))
            cells = max(1, PRODUCT_CELLS // b.shape[1])
            for c in range(0, len(row), cells):
                some = slice(c, c + cells)
                exact[some] = ((base[col[some]] - part[row[some]]) ** 2).sum(1).round(DIGITS)
            nearer = (exact < found[who[row], -1]) | (exact == found[who[row], -1]) & (mine[col] < near[who[row], -1])
            row, col, exact = row[nearer], col[nearer], exact[nearer]
            if len(row) > 4 * k * len(part):  # many within the slack: only those up to the last distance are put in order
                rough[:] = np.inf
                rough[row, col] = exact
                last = np.partition(rough, most, axis=1)[:, most]
                row, col = np.nonzero((rough <= last[:, None]) & (rough < np.inf))
                exact = rough[row, col]
            if not len(row):
                continue
            order = np.lexsort((mine[col], exact, row))
            row, col, exact = row[order], col[order], exact[order]
            first = np.flatnonzero(np.diff(row, prepend=-1))
            nth = np.arange(len(row)) - np.repeat(first, np.diff(first, append=len(row)))
            own = np.repeat(np.arange(len(first)), np.diff(first, append=len(row)))
            keep = nth < k
            better = who[row[first]]
            distances, places = np.full((len(first), 2 * k), np.inf), np.full((len(first), 2 * k), len(b))
            distances[:, :k], places[:, :k] = found[better], near[better]
            distances[own[keep], k + nth[keep]], places[own[keep], k + nth[keep]] = exact[keep], mine[col[keep]]
            order = np.lexsort((places, distances), axis=1)[:, :k]
            found[better], near[better] = np.take_along_axis(distances, order, 1), np.take_along_axis(places, order, 1)


def _nearest_in_block(k: int):
    """The k nearest rows of a block for each query. Where base rows have a ``slot``, a query meets those whose bit is set in its ``slots``."""

    def search(queries: pa.Table, base: pa.Table) -> pa.Table:
        q, b = _matrix(queries["vec"]), _matrix(base["vec"])
        order = np.zeros(0, np.int64)
        found, near = np.full((len(q), k), np.inf), np.full((len(q), k), len(b))
        if len(q) and len(b):
            order = np.argsort(np.asarray(pa.compute.rank(base["id"].combine_chunks(), tiebreaker="first").to_numpy()))
            b = b[order]
            sums = (q * q).sum(1), (b * b).sum(1)
            if "slot" in base.column_names:
                met = _meetings(queries["slots"], base["slot"].to_numpy()[order])
            else:
                met = [(np.arange(len(q)), np.arange(len(b)))]
            for asks, rows in met:
                if len(asks):
                    _improve(found, near, q, b, sums, asks, rows)
        row, nth = np.nonzero(near < len(b))
        pick_q, pick_b = pa.array(row), pa.array(order[near[row, nth]])
        return pa.table(
            {
                "query_id": queries["id"].take(pick_q),
                "base_id": base["id"].take(pick_b),
                "label": base["label"].take(pick_b),
                "distance2": pa.array(found[row, nth]),
            }
        )

    return search


def nearest_in_pairs(q: DataFrame, b: DataFrame, key: tuple[str, ...], pairs: int, k: int, out: T.StructType) -> DataFrame:
    """What every pair of blocks finds, each pair under its own ``key``. Pairs are few bytes and much work, so
    they are dealt to tasks by number and not by size."""
    tasks = max(1, min(TASKS_PER_PAIR * pairs, TASKS_PER_CORE * q.sparkSession.sparkContext.defaultParallelism))
    q, b = (df.repartition(tasks, *key).groupBy(*key) for df in (q, b))
    return q.cogroup(b).applyInArrow(_nearest_in_block(k), out)


def nearest_neighbors(
    queries: DataFrame,
    base: DataFrame,
    k: int = 5,
    id_col: str = "sample_id",
    vec: str = "hidden_state_vector",
    label: str = "label",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The k nearest base rows of each query: query_id, base_id, label, distance2, rank.

    Rows with a null vector take no part. A base row travels once per block of queries and a query once
    per block of base rows.
    """
    array = F.col(vec).cast("array<double>").alias("vec")
    q = queries.select(F.col(id_col).alias("id"), array).where("vec is not null")
    b = base.select(F.col(id_col).alias("id"), F.col(label).alias("label"), array).where("vec is not null")
    sizes = [df.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first() for df in (q, b)]
    if not sizes[1][0]:
        raise ValueError("no base rows")
    most = PAIRS_PER_CORE * queries.sparkSession.sparkContext.defaultParallelism
    rows = block_rows(sizes[1][1], block_bytes, math.isqrt(sizes[0][0] * sizes[1][0] // most))
    chunks, blocks = (max(1, math.ceil(n / rows)) for n, _ in sizes)
    own = F.xxhash64("id")

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    q = q.select("id", "vec", F.pmod(own, F.lit(chunks)).cast("int").alias("chunk")).withColumn("block", every(blocks))
    b = b.select("id", "label", "vec", F.pmod(own, F.lit(blocks)).cast("int").alias("block")).withColumn("chunk", every(chunks))
    out = T.StructType(
        [
            T.StructField("query_id", queries.schema[id_col].dataType),
            T.StructField("base_id", base.schema[id_col].dataType),
            T.StructField("label", base.schema[label].dataType),
            T.StructField("distance2", T.DoubleType()),
        ]
    )
    candidates = nearest_in_pairs(q, b, ("block", "chunk"), chunks * blocks, k, out)
    ranked = Window.partitionBy("query_id").orderBy("distance2", "base_id")
    return candidates.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def vote(neighbors: DataFrame) -> DataFrame:
    """Most frequent label among a query's neighbours; ties go to the smaller label."""
    return (
        neighbors.groupBy("query_id", "label")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("query_id")
        .agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("y_pred"))
    )


def knn_classify(queries: DataFrame, base: DataFrame, k: int = 5, **options) -> DataFrame:
    return vote(nearest_neighbors(queries, base, k, **options))
