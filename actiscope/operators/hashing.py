"""Nearest neighbours through hash tables of random projections, for a large base.

A table tells a vector by on which side of a few cuts its projections lie; the directions are
differences of random pairs of base rows, the cuts medians. A base row lies in one bucket per table. A query
looks into its own bucket and those across the cuts nearest to it, and the distances of what lies there are exact.
How many tables and buckets it takes for a recall is measured on some base rows whose neighbours are found exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actiscope.operators import neighbors
from actiscope.schema import SEED
from actiscope.session import broadcast_if_small, stored

BUCKET_ROWS = 4_096
"""Base rows a bucket holds on average."""
FIT_ROWS = 8_192
"""Base rows from which directions and cuts are drawn."""
PROBE_ROWS = 256
"""Base rows on which recall is measured."""
MOST_TABLES = 8
MOST_BITS = 24
SLOT_BITS = 8
"""Buckets, as a power of two, that a query asks for at once where it looks into some only."""
PROBE_CELLS = 250_000
"""Buckets that are put in order at once; vectors are taken up a few at a time for it."""


@dataclass(frozen=True)
class HashTables:
    """Directions (table, bit, position), their cuts (table, bit), and buckets a query looks into in each table."""

    directions: np.ndarray
    cuts: np.ndarray
    probes: int
    recall: float | None = None

    @property
    def bits(self) -> int:
        return self.cuts.shape[1]

    def margins(self, rows: np.ndarray) -> np.ndarray:
        """Signed distances from the cuts: (table, row, bit)."""
        return np.einsum("nd,tbd->tnb", rows, self.directions) - self.cuts[:, None, :]

    def buckets(self, rows: np.ndarray) -> np.ndarray:
        """Bucket of each row in each table: (table, row)."""
        return ((self.margins(rows) > 0) << np.arange(self.bits)).sum(axis=2)

    def looked_into(self, rows: np.ndarray, probes: int | None = None) -> np.ndarray:
        """Buckets in order of the least way to them: (table, row, probe), the row's own first."""
        probes = self.probes if probes is None else probes
        margins = self.margins(rows)
        own = ((margins > 0) << np.arange(self.bits)).sum(axis=2)
        return own[:, :, None] ^ nearest_flips(np.abs(margins), probes)

    def first(self, tables: int, probes: int, recall: float | None) -> HashTables:
        return HashTables(self.directions[:tables], self.cuts[:tables], probes, recall)


def nearest_flips(margins: np.ndarray, probes: int) -> np.ndarray:
    """Masks of the bits to flip, in order of the sum of their squared margins; the empty mask comes first.

    Bits join one at a time, least margin first. A set among the ``probes`` best of all bits has its best
    ``probes`` prefixes kept at each step, so keeping that many is enough.
    """
    cost = np.zeros((*margins.shape[:-1], 1))
    mask = np.zeros((*margins.shape[:-1], 1), np.int64)
    order = np.argsort(margins, axis=-1, kind="stable")
    for i in range(margins.shape[-1]):
        bit = order[..., i : i + 1]
        more = cost + np.take_along_axis(margins, bit, -1) ** 2
        cost, mask = np.concatenate((cost, more), -1), np.concatenate((mask, mask | (1 << bit)), -1)
        if cost.shape[-1] > probes:
            kept = np.argsort(cost, axis=-1, kind="stable")[..., :probes]
            cost, mask = np.take_along_axis(cost, kept, -1), np.take_along_axis(mask, kept, -1)
    kept = np.argsort(cost, axis=-1, kind="stable")
    return np.take_along_axis(mask, kept, -1)


def _vectors(df: DataFrame, id_col: str, vec: str, *columns: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), *columns, F.col(vec).cast("array<double>").alias("vec")).where("vec is not null")


def _some(df: DataFrame, most: int, seed: int) -> list:
    """At most ``most`` rows, the first by hash: the same rows however they are stored."""
    return df.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(most).collect()


def draw_tables(rows: np.ndarray, tables: int, bits: int, seed: int = SEED) -> HashTables:
    """Tables from sampled rows; a pair of equal rows gives way to a random direction."""
    draw = np.random.default_rng(seed)
    d = rows.shape[1]
    directions = np.zeros((tables, bits, d))
    for t in range(tables):
        for b in range(bits):
            i, j = draw.integers(len(rows), size=2)
            way = rows[i] - rows[j]
            if not np.any(way):
                way = draw.normal(size=d)
            directions[t, b] = way / np.linalg.norm(way)
    cuts = np.median(np.einsum("nd,tbd->tnb", rows, directions), axis=1)
    return HashTables(directions, cuts, 1)


def fit_tables(
    base: DataFrame,
    k: int = 5,
    recall: float = 0.95,
    id_col: str = "sample_id",
    vec: str = "hidden_state_vector",
    bucket_rows: int = BUCKET_ROWS,
    tables: int = MOST_TABLES,
    fit_rows: int = FIT_ROWS,
    probe_rows: int = PROBE_ROWS,
    seed: int = SEED,
) -> HashTables:
    """Tables and the number of buckets to look into, so that ``recall`` of the k nearest was found for sampled rows.

    Of all ways to reach it, the one that looks into the fewest buckets is taken; where none does, all buckets of one
    table are, which is exact. The driver holds ``fit_rows`` vectors and the neighbours of ``probe_rows``.
    """
    rows = _vectors(base, id_col, vec)
    n = rows.count()
    if not n:
        raise ValueError("no base rows")
    bits = min(MOST_BITS, max(1, round(math.log2(max(2, n / bucket_rows)))))
    drawn = draw_tables(np.array([r.vec for r in _some(rows, fit_rows, seed)]), tables, bits, seed)

    asked = _some(rows, probe_rows, seed + 1)
    spark = base.sparkSession
    queries = spark.createDataFrame(asked, rows.schema)
    exact = neighbors.nearest_neighbors(queries, rows.withColumn("label", F.lit(0)), k + 1, "id", "vec", "label").where("query_id != base_id")
    near = stored(exact.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance2", "base_id"))).where(F.col("rank") <= k), "exact")
    pairs = near.select("query_id", "base_id").collect()
    if not pairs:
        return drawn.first(1, 1, 1.0)
    found = {r.id: r.vec for r in rows.join(F.broadcast(near.select(F.col("base_id").alias("id")).distinct()), "id", "left_semi").collect()}
    own = {r.id: i for i, r in enumerate(asked)}
    queries_at = np.array([own[p.query_id] for p in pairs])
    there = drawn.buckets(np.array([found[p.base_id] for p in pairs]))
    probes = 1 << min(bits, 10)
    looked = drawn.looked_into(np.array([r.vec for r in asked]), probes)[:, queries_at]
    hit = looked == there[:, :, None]
    place = np.where(hit.any(axis=2), hit.argmax(axis=2), probes)  # probe at which each table finds the pair
    best = None
    for t in range(1, tables + 1):
        firsts = np.sort(place[:t].min(axis=0))
        p = int(firsts[math.ceil(recall * len(firsts)) - 1]) + 1
        if p <= probes and (best is None or t * p < best[0] * best[1]):
            best = (t, p, float((firsts < p).mean()))
    return drawn.first(*best) if best else drawn.first(1, 1 << bits, 1.0)


def _by_group(keys: np.ndarray, together: int) -> pa.ListArray:
    """Keys (row, key) as a list per row of (bucket, slots): the groups of 2^``together`` keys they lie in, and a bit for each."""
    keys = np.sort(keys, axis=1)
    group, slot = keys >> together, keys & ((1 << together) - 1)
    new = np.ones(keys.shape, bool)
    new[:, 1:] = group[:, 1:] != group[:, :-1]
    width = max(1, (1 << together) >> 3)
    bits = np.zeros((np.count_nonzero(new), width), np.uint8)
    np.bitwise_or.at(bits, (new.ravel().cumsum() - 1, slot.ravel() >> 3), (1 << (slot.ravel() & 7)).astype(np.uint8))
    ends = pa.py_buffer(np.arange(0, bits.size + 1, width, dtype=np.int32))
    slots = pa.Array.from_buffers(pa.binary(), len(bits), [None, ends, pa.py_buffer(bits)])
    offsets = np.concatenate(([0], new.sum(axis=1).cumsum())).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(group[new]), slots], names=["bucket", "slots"]))


def _in_buckets(df: DataFrame, tables: HashTables, probe: bool, *columns: str, together: int | None = None) -> DataFrame:
    """``df`` (id, ..., vec) with its buckets: one row per table, for queries one per table and probe.

    With ``together``, one row, with the list of groups of 2^``together`` buckets and the bits of the buckets in each.
    """
    names = ["id", *columns, "vec"]
    probes = tables.probes if probe else 1
    step = max(1, PROBE_CELLS // (len(tables.directions) * min(2 * probes, 1 << tables.bits)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                rows = neighbors._matrix(part.column("vec"))
                found = tables.looked_into(rows) if probe else tables.buckets(rows)[:, :, None]
                keys = np.moveaxis(found + (np.arange(len(found))[:, None, None] << tables.bits), 0, 1).reshape(len(rows), -1)
                offsets = pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())) if together is None else _by_group(keys, together)
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*names, "buckets"])

    df = df.select(names)
    kind = T.LongType() if together is None else T.StructType([T.StructField("bucket", T.LongType()), T.StructField("slots", T.BinaryType())])
    found = df.mapInArrow(find, T.StructType([*df.schema.fields, T.StructField("buckets", T.ArrayType(kind))]))
    return found.select(*names, F.explode("buckets").alias("bucket")) if together is None else found


def hashed_neighbors(
    queries: DataFrame,
    base: DataFrame,
    tables: HashTables,
    k: int = 5,
    id_col: str = "sample_id",
    vec: str = "hidden_state_vector",
    label: str = "label",
    block_bytes: int = neighbors.BLOCK_BYTES,
) -> DataFrame:
    """The k nearest of the base rows that share a bucket with each query: query_id, base_id, label, distance2, rank.

    Neighbouring buckets are put together as far as a block holds their rows. A base row travels once per table, a query once to each
    group of buckets that has one it looks into, with a bit for each of these. A group of more rows than a block
    holds, such as one of equal vectors, is cut into blocks on either side, and those meet in pairs. Rows with a null vector take no part.
    """
    q = _vectors(queries, id_col, vec)
    b = _in_buckets(_vectors(base, id_col, vec, F.col(label).alias("label")), tables, False, "label")
    n_tables, some = len(tables.directions), tables.probes < 1 << tables.bits
    held = stored(b.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "sizes")
    n, asked = held.agg(F.sum("n")).first()[0] or 0, q.count()
    most = neighbors.PAIRS_PER_CORE * queries.sparkSession.sparkContext.defaultParallelism
    # Of a pair of blocks only what shares a bucket is looked at, so that blocks may hold more rows for the same work.
    share = tables.probes / (1 << tables.bits)
    larger = min(int(neighbors.BLOCK_ROWS / math.sqrt(share)), 2 * n // most) if some else math.isqrt(asked * (n // n_tables) // most)
    block = neighbors.block_rows(tables.directions.shape[2], block_bytes, larger)
    pieces = lambda rows, name: F.ceil(rows / block).cast("int").alias(name)
    mean = max(1, n // (n_tables << tables.bits))
    together = min(tables.bits, max(0, (block // mean).bit_length() - 1), SLOT_BITS if some else MOST_BITS)
    group = F.shiftright("bucket", together).alias("bucket")
    met = held.groupBy(group).agg(pieces(F.sum("n"), "blocks"))
    if some:
        q = stored(_in_buckets(q, tables, True, together=together), "asked").select("id", "vec", F.inline("buckets"))
        met = met.join(q.groupBy("bucket").agg(pieces(F.count(F.lit(1)), "chunks")), "bucket")
        b = b.withColumn("slot", F.col("bucket").bitwiseAND((1 << together) - 1).cast("int"))
    else:
        met = met.withColumn("chunks", F.lit(max(1, -(-asked // block))))
        q = q.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit((n_tables << tables.bits >> together) - 1)).cast("array<long>")))
    b = b.withColumn("bucket", group)
    met = stored(met, "buckets")
    pairs = met.agg(F.sum(F.col("chunks").cast("long") * F.col("blocks"))).first()[0] or 0
    met = broadcast_if_small(met)
    own = F.xxhash64("id")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = q.join(met, "bucket").select("bucket", "id", "vec", *["slots"] * some, F.pmod(own, "chunks").cast("int").alias("chunk"), every("blocks").alias("block"))
    b = b.join(met, "bucket").select("bucket", "id", "label", "vec", *["slot"] * some, F.pmod(own, "blocks").cast("int").alias("block"), every("chunks").alias("chunk"))
    out = T.StructType(
        [
            T.StructField("query_id", queries.schema[id_col].dataType),
            T.StructField("base_id", base.schema[id_col].dataType),
            T.StructField("label", base.schema[label].dataType),
            T.StructField("distance2", T.DoubleType()),
        ]
    )
    key = ("bucket", "block", "chunk")
    found = neighbors.nearest_in_pairs(q, b, key, pairs, k, out)
    if n_tables > 1:
        found = found.repartition("query_id").groupBy("query_id", "base_id").agg(F.first("label").alias("label"), F.first("distance2").alias("distance2"))
    ranked = Window.partitionBy("query_id").orderBy("distance2", "base_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def find_neighbors(
    queries: DataFrame, base: DataFrame, k: int = 5, recall: float = 0.95, exact_rows: int | None = None, id_col: str = "sample_id", vec: str = "hidden_state_vector", label: str = "label"
) -> DataFrame:
    """Exact neighbours, whatever the size of the base. Only a caller that names ``exact_rows`` gets, beyond so many base rows, what hash tables of the given recall find."""
    if exact_rows is None or base.limit(exact_rows + 1).count() <= exact_rows:
        return neighbors.nearest_neighbors(queries, base, k, id_col, vec, label)
    return hashed_neighbors(queries, base, fit_tables(base, k, recall, id_col, vec), k, id_col, vec, label)


def measured_recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact (query_id, base_id) pairs that were found."""
    hit = exact.select("query_id", "base_id").join(found.select("query_id", "base_id").distinct(), ["query_id", "base_id"], "left_semi").count()
    return hit / max(1, exact.count())
