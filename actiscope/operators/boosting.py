"""Boosted trees for several classes, grown from histograms.

Values are cut into bins once. A round grows one tree per class from the gradients of the
softmax loss; a pass over the rows adds up gradients per (class, node, feature, bin) for all
classes and all nodes that are new, and where the sums meet the best cut of each is found, so the driver
sees one row per node and group of features. Trees grow leaf-wise: the best leaves are cut first. Rows
keep their bins and the scores of the trees so far; both can be made again from the
stored bins and the trees.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actiscope.operators.saving import Saver
from actiscope.schema import SEED
from actiscope.session import stored

# Defaults of the boosted model.
ROUNDS, LEAVES, RATE = 200, 63, 0.1
MIN_ROWS, MIN_HESSIAN = 20, 1e-3

BINS = 64
EDGE_BYTES = 64 << 20
"""Bytes of rows up to which the driver finds the bin edges; beyond, tasks find the same ones."""
BLOCK_BYTES = 4 << 20
"""Bytes of bins in one stored block of rows."""
SUM_BYTES = 256 << 20
"""Bytes of sums that a task holds; nodes beyond it take another pass."""
GROUP = 256
"""Features whose sums travel together."""
KEPT_ROUNDS = 10
"""Rounds after which the scores of the rows are brought up to date."""
ROW_BYTES = 16
"""What a row takes to pass besides its bins, in bins."""
GROWN_BYTES = 2 << 20
"""Bytes of bins up to which one task grows all trees: its time is that of all rounds."""
PARTITION_BYTES = 4 << 20
"""Bytes of bins that a task passes over otherwise."""


@dataclass
class Tree:
    """Nodes in order of their making; a leaf has feature -1. A value of at most the cut's goes left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        left, right = len(self.feature), len(self.feature) + 1
        self.feature[node], self.bin[node], self.left[node], self.right[node] = feature, cut, left, right
        for column, new in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            column += [new, new]
        return left, right

    def leaves_of(self, bins: np.ndarray) -> np.ndarray:
        """Leaf of each row of bins."""
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.bin, self.left, self.right))
        node = np.zeros(len(bins), np.int64)
        at = np.arange(len(bins))
        while len(at):
            at = at[feature[node[at]] >= 0]
            here = node[at]
            node[at] = np.where(bins[at, feature[here]] <= cut[here], left[here], right[here])
        return node


def scores_of(bins: np.ndarray, rounds: list[list[Tree]], scores: np.ndarray) -> np.ndarray:
    """``scores`` (row, class) and what the rounds add to them."""
    for trees in rounds:
        for c, tree in enumerate(trees):
            if len(tree.feature) > 1 or tree.value[0]:
                scores[:, c] += np.array(tree.value)[tree.leaves_of(bins)]
    return scores


def chances(scores: np.ndarray) -> np.ndarray:
    raised = np.exp(scores - scores.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def bin_edges(rows: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Up to ``bins - 1`` rising edges per column, each halfway between two values.

    Sorted values are cut into runs of equal number and every run gives the middle of its widest gap, so that bins
    hold about as many values and a gap between groups of values is never inside one.
    """
    edges = []
    for column in rows.T:
        held = np.sort(column[np.isfinite(column)])
        distinct = np.unique(held)
        if len(distinct) <= bins:
            edges.append((distinct[:-1] + distinct[1:]) / 2)
            continue
        gaps = np.diff(held)
        starts = np.linspace(0, len(gaps), bins).astype(np.int64)[:-1]
        widest = [a + int(gaps[a:b].argmax()) for a, b in zip(starts, np.append(starts[1:], len(gaps)))]
        edges.append(np.array([(held[i] + held[i + 1]) / 2 for i in widest if gaps[i] > 0]))
    return edges


class Gaps:
    """``bin_edges`` of one column whose finite values, ``n`` of them, come in order and in parts."""

    def __init__(self, n: int, bins: int):
        self.bins, self.starts = bins, np.linspace(0, n - 1, bins).astype(np.int64)[:-1]
        self.last, self.at, self.more = np.zeros(0), 0, True
        self.distinct = np.zeros(0)  # up to one more than there are bins
        self.widest, self.edges = np.zeros(bins - 1), np.zeros(bins - 1)

    def add(self, values: np.ndarray) -> None:
        if len(self.distinct) <= self.bins:
            self.distinct = np.unique(np.concatenate((self.distinct, values)))[: self.bins + 1]
        held = np.concatenate((self.last, values))
        gaps = np.diff(held)
        runs = np.searchsorted(self.starts, self.at + np.arange(len(gaps)), "right") - 1
        firsts = np.flatnonzero(np.diff(runs, prepend=-1))
        for a, z in zip(firsts, np.append(firsts[1:], len(gaps))):
            i = a + int(gaps[a:z].argmax())
            if gaps[i] > self.widest[runs[a]]:
                self.widest[runs[a]], self.edges[runs[a]] = gaps[i], (held[i] + held[i + 1]) / 2
        self.last, self.at = held[-1:], self.at + len(gaps)

    def found(self) -> np.ndarray:
        if len(self.distinct) <= self.bins:
            return (self.distinct[:-1] + self.distinct[1:]) / 2
        return self.edges[self.widest > 0]


def edges_in_tasks(rows: DataFrame, d: int, bins: int) -> list[np.ndarray]:
    """``bin_edges`` of all rows (v): the values of each feature pass through one task in order, which holds a batch of them."""
    values = rows.select(F.posexplode("v").alias("i", "x")).where(~F.isnan("x") & (F.abs("x") < float("inf")))
    counts = {r.i: r.n for r in values.groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Gaps] = {}
        for batch in batches:
            of, x = (batch.column(c).to_numpy() for c in (0, 1))
            firsts = np.flatnonzero(np.diff(of, prepend=-1))
            for a, z in zip(firsts, np.append(firsts[1:], len(of))):
                i = int(of[a])
                held.setdefault(i, Gaps(counts[i], bins)).add(x[a:z])
        for i, gaps in held.items():
            yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "edges": pa.array([gaps.found()], pa.list_(pa.float64()))})

    found = {r.i: np.array(r.edges, float) for r in values.repartition("i").sortWithinPartitions("i", "x").mapInArrow(run, "i int, edges array<double>").collect()}
    return [found.get(i, np.zeros(0)) for i in range(d)]


def binned(rows: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin of each value: the edges below it. What is not a number lies above all edges."""
    return np.column_stack([np.searchsorted(e, rows[:, i], "left") for i, e in enumerate(edges)]).astype(np.uint8)


@dataclass
class BoostedModel:
    """Trees of every round and class over binned values; adds ``probability`` and ``prediction``."""

    edges: list[np.ndarray]
    start: np.ndarray
    rounds: list[list[Tree]]
    inp: str

    def transform(self, df: DataFrame) -> DataFrame:
        edges, start, rounds = self.edges, self.start, self.rounds

        def score(v: pa.Array) -> pa.Array:
            rows = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) if len(v) else np.zeros((0, len(edges)))
            found = chances(scores_of(binned(rows, edges), rounds, np.tile(start, (len(rows), 1)))) if len(v) else np.zeros((0, len(start)))
            return pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, len(start), dtype=np.int32)), pa.array(found.ravel()))

        made = df.withColumn("_p", F.arrow_udf(score, T.ArrayType(T.DoubleType()))(vector_to_array(self.inp)))
        best = (F.array_position("_p", F.array_max("_p")) - 1).cast("double")
        return made.withColumn("probability", array_to_vector("_p")).withColumn("prediction", best).drop("_p")

    def write(self) -> Saver:
        return Saver(self.save)

    def save(self, path: str, mode: str = "error") -> None:
        spark = SparkSession.active()
        rows = [(r, c, json.dumps(vars(t))) for r, trees in enumerate(self.rounds) for c, t in enumerate(trees)]
        spark.createDataFrame(rows, "round int, class int, tree string").write.mode(mode).parquet(f"{path}/trees")
        edges = [(i, e.tolist()) for i, e in enumerate(self.edges)]
        spark.createDataFrame(edges, "feature int, edges array<double>").write.mode(mode).parquet(f"{path}/edges")
        spark.createDataFrame([(self.start.tolist(), self.inp)], "start array<double>, inp string").write.mode(mode).parquet(f"{path}/start")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedModel:
        start = spark.read.parquet(f"{path}/start").first()
        edges = [np.array(r.edges) for r in spark.read.parquet(f"{path}/edges").orderBy("feature").collect()]
        rounds: list[list[Tree]] = []
        for r in spark.read.parquet(f"{path}/trees").orderBy("round", "class").collect():
            if r["class"] == 0:
                rounds.append([])
            rounds[-1].append(Tree(**json.loads(r.tree)))
        return cls(edges, np.array(start.start), rounds, start.inp)


def _distinct(rows: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """Rows (v, y) as distinct (bins, y) and their number ``n``: equal ones have equal gradients in every round."""
    d = len(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)
                ends = np.arange(0, values.size + 1, d, dtype=np.int32)
                bins = pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(ends), pa.py_buffer(binned(values, edges))])
                yield pa.RecordBatch.from_arrays([bins, batch.column(1)], names=["bins", "y"])

    return rows.mapInArrow(run, "bins binary, y int").groupBy("bins", "y").agg(F.count(F.lit(1)).alias("n"))


BLOCK = "bins binary, labels binary, counts binary"


def _blocks(distinct: DataFrame, d: int) -> DataFrame:
    """Distinct rows (bins, y, n) as blocks of bins, labels and numbers."""
    most = max(1, BLOCK_BYTES // d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def block() -> pa.RecordBatch:
            bins, labels, counts = zip(*held)
            return pa.RecordBatch.from_pydict(
                {"bins": [b"".join(bins)], "labels": [np.concatenate(labels).astype("<i4").tobytes()], "counts": [np.concatenate(counts).astype("<i8").tobytes()]}
            )

        for batch in batches:
            if batch.num_rows:
                held.append((b"".join(batch.column(0).to_pylist()), batch.column(1).to_numpy(), batch.column(2).to_numpy()))
                n += batch.num_rows
            if n >= most:
                yield block()
                held, n = [], 0
        if n:
            yield block()

    return distinct.mapInArrow(run, BLOCK)


def _held(one: dict, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins, labels and numbers of a block."""
    return np.frombuffer(one["bins"], np.uint8).reshape(-1, d), np.frombuffer(one["labels"], "<i4"), np.frombuffer(one["counts"], "<i8")


def _scored(blocks: DataFrame, d: int, start: np.ndarray, rounds: list[list[Tree]]) -> DataFrame:
    """Blocks with the scores of the rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.slice(0).to_pylist():
                bins = np.frombuffer(one["bins"], np.uint8).reshape(-1, d)
                scores = scores_of(bins, rounds, np.tile(start, (len(bins), 1)))
                yield pa.RecordBatch.from_pydict({**{k: [v] for k, v in one.items()}, "scores": [scores.tobytes()]})

    return blocks.mapInArrow(run, f"{BLOCK}, scores binary")


SPLIT = "key int, feature int, bin int, gain double, g double, h double, n double, left_g double, left_h double, left_n double"


def best_cut(sums: np.ndarray, min_rows: int = MIN_ROWS, min_hessian: float = MIN_HESSIAN) -> tuple | None:
    """(feature, bin, gain, g, h, n, left g, left h, left n) of the best cut by sums (feature, bin, 3); None when none is allowed or gains."""
    left = sums.cumsum(axis=1)
    whole = left[:, -1:, :]
    right = whole - left
    allowed = (left[..., 2] >= min_rows) & (right[..., 2] >= min_rows) & (left[..., 1] >= min_hessian) & (right[..., 1] >= min_hessian)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[..., 0] ** 2 / left[..., 1] + right[..., 0] ** 2 / right[..., 1] - whole[..., 0] ** 2 / whole[..., 1]
    gain = np.where(allowed, gain, -np.inf)
    f, b = divmod(int(gain.argmax()), gain.shape[1])
    if not gain[f, b] > 1e-12:
        return None
    return f, b, float(gain[f, b]), *map(float, whole[f, 0]), *map(float, left[f, b])


def add_sums(sums: np.ndarray, bins: np.ndarray, labels: np.ndarray, counts: np.ndarray, scores: np.ndarray, trees: list[Tree], nodes: list[tuple[int, int]]) -> None:
    """Add what some distinct rows give to ``sums`` (node, feature and bin, 3): their gradients, second derivatives and numbers in the leaves asked for."""
    d, k = bins.shape[1], scores.shape[1]
    p = chances(scores)
    for c in range(k):
        wanted = {n: i for i, (at, n) in enumerate(nodes) if at == c}
        if not wanted:
            continue
        place = np.full(len(trees[c].feature), -1)
        place[list(wanted)] = list(wanted.values())
        of = place[trees[c].leaves_of(bins)]
        at = np.flatnonzero(of >= 0)
        g, h = counts[at] * (p[at, c] - (labels[at] == c)), counts[at] * (k / (k - 1) * p[at, c] * (1 - p[at, c]))
        for i in np.unique(of[at]):
            mine = np.flatnonzero(of[at] == i)
            cells = (bins[at[mine]] + np.arange(d) * BINS).ravel()
            for j, weight in enumerate((g[mine], h[mine], counts[at[mine]])):
                sums[i, :, j] += np.bincount(cells, np.repeat(weight, d), minlength=d * BINS)


def _cuts(scored: DataFrame, d: int, k: int, new_rounds: list[list[Tree]], trees: list[Tree], nodes: list[tuple[int, int]], tasks: int, limits: tuple) -> list:
    """The best cut of each (class, node), one row per group of features that has one."""
    out = T.StructType.fromDDL(SPLIT)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        sums = np.zeros((len(nodes), d * BINS, 3))
        for batch in batches:
            for one in batch.to_pylist():
                bins, labels, counts = _held(one, d)
                scores = scores_of(bins, new_rounds, np.frombuffer(one["scores"]).reshape(-1, k).copy())
                add_sums(sums, bins, labels, counts, scores, trees, nodes)
        yield sums.reshape(len(nodes), d, BINS, 3)

    def best(key: int, group: int, sums: np.ndarray) -> list:
        cut = best_cut(sums, *limits)
        return [] if cut is None else [(key, cut[0] + group * GROUP, *cut[1:])]

    def records(rows: list) -> pa.RecordBatch:
        kinds = [pa.int32()] * 3 + [pa.float64()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * len(kinds), kinds)], names=out.names)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sums in add(batches):
            for key in range(len(nodes)):
                for g in range(0, d, GROUP):
                    yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.int32()), "group": pa.array([g // GROUP], pa.int32()), "sums": [sums[key, g : g + GROUP].tobytes()]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for one in batch.to_pylist():
                mine, new = (one["key"], one["group"]), np.frombuffer(one["sums"])
                found[mine] = found[mine] + new if mine in found else new
        yield records([r for (key, group), sums in sorted(found.items()) for r in best(key, group, sums.reshape(-1, BINS, 3))])

    parts = scored.mapInArrow(partial, "key int, group int, sums binary")
    return parts.repartition(min(tasks, len(nodes) * -(-d // GROUP)), "key", "group").mapInArrow(merge, out).collect()


class Growth:
    """One tree while it grows: sums of its leaves and the best cut found for each."""

    def __init__(self, g: float, h: float, n: float):
        self.tree = Tree()
        self.sums = {0: (g, h, n)}
        self.cuts: dict[int, tuple] = {}
        self.new = [0]

    def open(self, leaves: int, min_rows: int, min_hessian: float) -> list[int]:
        """New leaves that may be cut, while the tree may have more."""
        if len(self.sums) >= leaves:
            return []
        return [n for n in self.new if self.sums[n][2] >= 2 * min_rows and self.sums[n][1] >= 2 * min_hessian]

    def grow(self, leaves: int) -> None:
        """Cut the best leaves, at most half as many as are still allowed, and one at least."""
        order = sorted(self.cuts, key=lambda n: (-self.cuts[n][2], n))
        self.new = []
        for node in order[: max(1, -(-(leaves - len(self.sums)) // 2))]:
            if len(self.sums) >= leaves:
                break
            feature, cut, _, g, h, n, left_g, left_h, left_n = self.cuts.pop(node)
            left, right = self.tree.split(node, feature, cut)
            del self.sums[node]
            self.sums[left], self.sums[right] = (left_g, left_h, left_n), (g - left_g, h - left_h, n - left_n)
            self.new += [left, right]

    def finish(self, rate: float) -> Tree:
        for node, (g, h, _) in self.sums.items():
            self.tree.value[node] = -rate * g / h if h > 0 else 0.0
        return self.tree


def grow_trees(k: int, n: int, leaves: int, rate: float, limits: tuple[int, float], at_once: int, cuts_of: Callable[[list[Tree], list], list]) -> list[Tree]:
    """One tree per class. ``cuts_of`` gives, for unfinished trees and some of their leaves, rows of (place of the leaf, cut)."""
    growing = [Growth(0.0, np.inf, n) for _ in range(k)]
    while open_nodes := [(c, node) for c, g in enumerate(growing) for node in g.open(leaves, *limits)]:
        for at in range(0, len(open_nodes), at_once):
            nodes = open_nodes[at : at + at_once]
            for key, *cut in cuts_of([g.tree for g in growing], nodes):
                c, node = nodes[key]
                held = growing[c].cuts.get(node)
                if held is None or (cut[2], -cut[0]) > (held[2], -held[0]):
                    growing[c].cuts[node] = tuple(cut)
        for g in growing:
            g.grow(leaves)
    return [g.finish(rate) for g in growing]


def _grown_in_task(blocks: DataFrame, d: int, start: np.ndarray, n: int, rounds: int, leaves: int, rate: float, limits: tuple[int, float], at_once: int) -> list[list[Tree]]:
    """All rounds inside the one task that holds all rows, by the same steps."""
    k = len(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_held(one, d) for b in batches for one in b.to_pylist()]
        if not held:
            return
        bins, labels, counts = (np.concatenate(x) for x in zip(*held))
        scores = np.tile(start, (len(bins), 1))

        def cuts_of(trees: list[Tree], nodes: list) -> list:
            sums = np.zeros((len(nodes), d * BINS, 3))
            add_sums(sums, bins, labels, counts, scores, trees, nodes)
            found = ((key, best_cut(one.reshape(d, BINS, 3), *limits)) for key, one in enumerate(sums))
            return [(key, *cut) for key, cut in found if cut]

        for r in range(rounds):
            trees = grow_trees(k, n, leaves, rate, limits, at_once, cuts_of)
            if all(len(t.feature) == 1 for t in trees):
                return
            scores_of(bins, [trees], scores)
            yield pa.RecordBatch.from_pydict({"round": pa.array([r], pa.int32()), "trees": [json.dumps([vars(t) for t in trees])]})

    rows = blocks.mapInArrow(run, "round int, trees string").collect()
    return [[Tree(**t) for t in json.loads(r.trees)] for r in sorted(rows)]


def fit_boosted(
    train: DataFrame,
    inp: str = "features",
    label: str = "label",
    rounds: int = ROUNDS,
    leaves: int = LEAVES,
    rate: float = RATE,
    min_rows: int = MIN_ROWS,
    min_hessian: float = MIN_HESSIAN,
    bins: int = BINS,
    seed: int = SEED,
    tasks: int | None = None,
) -> BoostedModel:
    """Multiclass boosted trees; labels are 0, 1, ... and rows with a null vector or label take no part.

    Fitting ends early when no tree of a round finds a cut. Rows with the same bins and label are held once with their number. Each pass
    reads them once for all classes; where they are few enough for one task (``GROWN_BYTES``), that task grows the trees itself.
    """
    if not 1 < bins <= BINS:
        raise ValueError(f"bins must be from 2 to {BINS}")
    rows = train.where(F.col(inp).isNotNull() & F.col(label).isNotNull()).select(vector_to_array(inp).alias("v"), F.col(label).cast("int").alias("y"))
    counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        raise ValueError("no rows to fit on")
    k, n = max(2, max(counts) + 1), sum(counts.values())
    d = len(rows.first().v)
    share = np.array([counts.get(c, 0) / n for c in range(k)])
    start = np.log(np.maximum(share, 1e-15))
    most = max(1, EDGE_BYTES // (8 * d))
    edges = bin_edges(np.array([r.v for r in rows.select("v").toLocalIterator()]), bins) if n <= most else edges_in_tasks(rows, d, bins)
    distinct = stored(_distinct(rows, edges), "distinct")
    if not tasks:
        size = distinct.count() * (d + ROW_BYTES)
        most = 10 * train.sparkSession.sparkContext.defaultParallelism
        tasks = 1 if size <= GROWN_BYTES else max(2, min(-(-size // PARTITION_BYTES), most))
    blocks = stored(_blocks(distinct.repartition(tasks), d), "bins").coalesce(tasks)
    at_once = max(1, SUM_BYTES // (d * BINS * 24))
    limits = (min_rows, min_hessian)
    if tasks == 1:
        return BoostedModel(edges, start, _grown_in_task(blocks, d, start, n, rounds, leaves, rate, limits, at_once), inp)
    done: list[list[Tree]] = []
    scored, kept = None, 0
    try:
        while len(done) < rounds:
            if scored is None or len(done) - kept >= KEPT_ROUNDS:
                if scored is not None:
                    scored.unpersist()
                scored, kept = _scored(blocks, d, start, list(done)).persist(StorageLevel.MEMORY_AND_DISK), len(done)
            trees = grow_trees(k, n, leaves, rate, limits, at_once, lambda trees, nodes: _cuts(scored, d, k, done[kept:], trees, nodes, tasks, limits))
            if all(len(t.feature) == 1 for t in trees):
                break
            done.append(trees)
    finally:
        if scored is not None:
            scored.unpersist()
    return BoostedModel(edges, start, done, inp)
