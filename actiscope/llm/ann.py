"""Nearest neighbours from randomly rotated one-bit codes.

A vector, less the mean of all, is turned by a random rotation into more dimensions and
kept as one bit for each, with its length and a correction. Inner products estimated from the bits
come with an error bound. The vectors lie beside their codes: a task takes them up in order of their smallest
possible distance, computes distances in full, and stops where no vector left can be among the nearest. Codes
and bounds decide which vectors are looked at; distances are those of the vectors as given. Equal vectors are searched once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from actiscope.session import stored

BITS = 512
ERROR = 2.5
"""Standard deviations that the error bound covers."""
ROUNDING = 1e-5
"""Share of the squared lengths by which a bound may be off from single precision."""
BLOCK_ROWS = 4_096
QUERY_ROWS = 1_024
CELL_ROWS = 65_536
"""Codes that one task meets a block of queries with."""
LOOK = 64
"""Vectors of a block whose distance to a query is computed between two looks at the bounds."""
SEED = 7


def rotation(dim: int, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """Orthonormal columns that turn ``dim`` dimensions into ``bits`` (at least as many)."""
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(max(bits, dim), dim)))[0].astype(np.float32)


def directions(vectors: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length of what is left of the centre, and its direction; a length beyond all numbers has none."""
    with np.errstate(over="ignore", invalid="ignore"):
        rest = vectors - centre
        length = np.linalg.norm(rest, axis=1)
        known = np.isfinite(length) & (length > 0)
        return length, np.where(known[:, None], rest / np.where(known, length, 1)[:, None], 0).astype(np.float32)


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed bits, length of what is left of the centre, and the code's inner product with its own direction."""
    length, way = directions(vectors, centre)
    turned = way @ turn.T
    own = np.abs(turned).sum(axis=1, dtype=np.float64) / np.sqrt(len(turn))
    return np.packbits(turned > 0, axis=1), length, np.where(own > 0, own, 1)


def bounds(queries: np.ndarray, centre: np.ndarray, turn: np.ndarray, bits: np.ndarray, length: np.ndarray, fit: np.ndarray, error: float = ERROR) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest likely squared distance of every query (rows) and code (columns)."""
    d = len(turn)
    q_length, way = directions(queries, centre)
    q_length = q_length[:, None]
    signs = np.unpackbits(bits, axis=1, count=d).astype(np.float32) * 2 - 1
    with np.errstate(over="ignore", invalid="ignore"):
        product = ((way @ turn.T) @ signs.T).astype(np.float64) / np.sqrt(d) / fit * length * q_length
        slack = error * np.sqrt(np.maximum(0, 1 - fit * fit)) / fit / np.sqrt(d - 1) * length * q_length
        whole = length * length + q_length * q_length
        low, high = whole * (1 - ROUNDING) - 2 * (product + slack), whole * (1 + ROUNDING) - 2 * (product - slack)
    known = np.isfinite(low)
    return np.where(known, low, -np.inf), np.where(known, high, np.inf)


def usable(vectors: DataFrame, vec: str) -> DataFrame:
    """Rows whose vector has the commonest length, only finite components and a component that isn't zero."""
    v = F.col(vec)
    good = vectors.where(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    lengths = good.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return good.where(F.size(v) == (lengths.n if lengths else 0))


def classes(rows: DataFrame, most: int) -> DataFrame:
    """Distinct vectors: a number ``class``, ``v``, up to ``most`` smallest ``ids`` and of those the ``least``. To be stored before use.

    No more of them can be among the nearest of anything. Equal rows count once. Ranks are cut before and after the
    shuffle, so a vector that a third of all rows share sends ``most`` ids a task.
    """
    place = F.row_number().over(W.partitionBy("v").orderBy("id"))
    few = rows.distinct().withColumn("place", place).where(F.col("place") <= most)
    lists = few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return lists.select(F.monotonically_increasing_id().alias("class"), F.col("ids")[0].alias("least"), "v", "ids")


def code_blocks(base: DataFrame, centre: np.ndarray, turn: np.ndarray) -> DataFrame:
    """Codes of ``base`` (class, least, v) beside their vectors, in blocks of bounded size, built where the rows are."""
    names = ["ids", "least", "bits", "length", "fit", "raw"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                vectors = part.column(2).flatten().to_numpy().reshape(part.num_rows, -1)
                data = [*(part.column(i).to_numpy().astype("<i8") for i in range(2)), *encode(vectors, centre, turn), vectors]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in data], names=names)

    return base.select("class", "least", "v").mapInArrow(run, ", ".join(f"{n} binary" for n in names))


def distances(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Euclidean distances, with the squares added up from the first component to the last."""
    with np.errstate(over="ignore"):
        return np.sqrt(np.cumsum((others - one) ** 2, axis=1)[:, -1])


class Nearest:
    """The ``most`` nearest classes of every query of a block so far as (score, least id, class), ties to the smaller id."""

    def __init__(self, queries: np.ndarray, most: int):
        self.queries, self.most = queries, most
        self.found = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries]

    def limit(self, i: int) -> float:
        score = self.found[i][0]
        return float(score[-1]) if len(score) == self.most else np.inf

    def look(self, low: np.ndarray, least: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Take up vectors in order of their lower bounds (query, vector) until those of a query lie beyond its farthest."""
        for i, query in enumerate(self.queries):
            with np.errstate(over="ignore"):
                left = np.flatnonzero(low[i] <= np.square(self.limit(i)))
                left = left[np.argsort(low[i, left], kind="stable")]
                for at in range(0, len(left), LOOK):
                    if low[i, left[at]] > np.square(self.limit(i)):
                        break
                    some = left[at : at + LOOK]
                    new = distances(query, vectors[some]), least[some], ids[some]
                    joined = [np.concatenate(pair) for pair in zip(self.found[i], new)]
                    order = np.lexsort((joined[1], joined[0]))[: self.most]
                    self.found[i] = tuple(x[order] for x in joined)


def nearest_classes(blocks: DataFrame, n_codes: int, queries: DataFrame, n_queries: int, most: int, centre: np.ndarray, turn: np.ndarray) -> DataFrame:
    """``query, class, least, score``: per query block and cell of codes, the ``most`` nearest classes of each query."""
    groups = max(1, -(-n_queries // QUERY_ROWS))
    spread = max(1, -(-n_codes // CELL_ROWS))
    ask = queries.withColumn("q", F.pmod(F.xxhash64("class"), F.lit(groups)).cast("int")).groupBy("q").agg(F.collect_list("class").alias("q_ids"), F.flatten(F.collect_list("v")).alias("q_vectors"))
    ask = ask.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    side = blocks.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(spread)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    both = side.join(ask, ["q", "salt"]).select("q", "q_ids", "q_vectors", "ids", "least", "bits", "length", "fit", "raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, near = None, None

        def done() -> pa.RecordBatch:
            score, least, ids = (np.concatenate([f[i] for f in near.found]) for i in range(3))
            columns = np.repeat(now, [len(f[0]) for f in near.found]), ids, least, score
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "class", "least", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                cell = {name: batch.column(name)[i] for name in batch.schema.names}
                q_ids = cell["q_ids"].values.to_numpy()
                if now is None or len(now) != len(q_ids) or (now != q_ids).any():
                    if now is not None:
                        yield done()
                    now = q_ids
                    near = Nearest(cell["q_vectors"].values.to_numpy().reshape(len(q_ids), -1), most)
                ids, least = (np.frombuffer(cell[c].as_py(), "<i8") for c in ("ids", "least"))
                bits = np.frombuffer(cell["bits"].as_py(), np.uint8).reshape(len(ids), -1)
                length, fit, raw = (np.frombuffer(cell[c].as_py()) for c in ("length", "fit", "raw"))
                near.look(bounds(near.queries, centre, turn, bits, length, fit)[0], least, ids, raw.reshape(len(ids), -1))
        if now is not None:
            yield done()

    return both.sortWithinPartitions("q").mapInArrow(run, "query bigint, class bigint, least bigint, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec: str = "embedding", bits: int = BITS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows nearest to each query by Euclidean distance in double precision, itself left out.

    Ties go to the smaller id. ``queries`` are rows of ``vectors``. Vectors that are null, zero, of another length
    than the commonest (no distance is defined between lengths), or hold nulls or numbers that aren't finite take no part; other
    columns are not read. Equal rows count once; an id with several vectors is listed once, at its nearest, and asks with
    each of them, so its list may be shorter. An empty table gives no rows.
    """
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    take = lambda df, name: df.select(F.col(id_col).cast("long").alias(name), F.col(vec).cast("array<double>").alias("v"))
    found = stored(classes(usable(take(vectors, "id").where("id is not null"), "v"), k + 1), "classes")
    means = found.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x")).orderBy("i").collect()  # one row per dimension
    if not means:
        return vectors.sparkSession.createDataFrame([], schema)
    centre = np.array([m.x if np.isfinite(m.x) else 0.0 for m in means])
    turn = rotation(len(centre), bits)
    asked = stored(take(queries, "query_id").join(found.select("v", "class"), "v").select("query_id", "class").distinct(), "asked")
    ask = stored(found.join(asked.select("class").distinct(), "class", "left_semi").select("class", "v"), "queries")
    near = nearest_classes(code_blocks(found, centre, turn), found.count(), ask, ask.count(), k + 1, centre, turn)
    closest = F.row_number().over(W.partitionBy("query").orderBy("score", "least"))
    top = near.withColumn("place", closest).where(F.col("place") <= k + 1).drop("place")
    listed = top.join(found.select("class", "ids"), "class").select("query", "score", F.explode("ids").alias("vec_id"))
    pairs = asked.join(listed, F.col("class") == F.col("query")).where("vec_id != query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
