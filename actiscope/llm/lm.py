"""A gated recurrent language model with a class-factored softmax, in numpy under Spark.

Counts of all words come from a shuffle with partial sums. The most frequent words are
learned: each has a class (runs of the frequency list of about equal weight), and the network
gives the class and the word within it. All others, down to unseen words, fall into classes by their
first two bytes, within which a word has its smoothed share. Training goes over every document, in rounds
of tasks whose weights are averaged; scoring carries the state through each whole document.
"""

from __future__ import annotations

import heapq
import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actiscope.llm.common import slices
from actiscope.session import new_work_dir, stored

FREQUENT = 200_000
"""Words whose counts every task holds; the rest are looked up by a join."""
LEARNED = 2_048
CLASSES = 32
REST_CLASSES = 32
HIDDEN = 16
WINDOW = 32
LEAST_LANES, MOST_LANES = 16, 512
STEPS = 256
"""Updates a training task should take: a small one reads in fewer lanes, and with smaller steps."""
SCORE_LANES = 256
SAFE_EXP = 60.0
"""Powers of e up to this neither overflow, in sums too, nor vanish in single precision."""
TRAIN_TOKENS = 4_000_000
"""Tokens a training task gets, about."""
LEAST_ROUNDS = 4
"""Rounds of training at least; with the input, rounds and tasks of a round grow alike."""
RATE = 0.03
"""Step length with the most lanes; with fewer it falls as their root."""
COUNTED_WORDS = 1_000_000
"""Distinct words a counting task holds before it hands them on."""
SLICE_CHARS = 12_000_000
"""Characters of documents that are scored together; the more, the fuller the lanes."""
DEALT_CHARS = 2_000_000
"""Characters of documents that go to one round of training together."""


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode().lower().split()


def rest_class(word: bytes) -> int:
    return zlib.crc32(word[:2]) % REST_CLASSES


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, n`` over all texts, summed in the task first, so that frequent words travel once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for content in b.column(0).to_pylist():
                counts.update(words_of(content))
                if len(counts) > COUNTED_WORDS:
                    yield batch()
                    counts = Counter()
        if counts:
            yield batch()

    return docs.select(text).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Frequent words by falling count, and what the model needs to know of the others."""

    words: list[bytes]
    counts: np.ndarray
    ends: int
    tokens: int
    types: int
    rest_mass: np.ndarray

    def __post_init__(self) -> None:
        learned = min(LEARNED - 1, len(self.words))
        order = int(np.searchsorted(-self.counts[:learned], -self.ends, "right"))
        mass = np.insert(self.counts[:learned].astype(float), order, self.ends) + 0.5
        self.end = order
        weight = np.cumsum(np.sqrt(mass))
        self.class_of = np.minimum((weight - np.sqrt(mass)) / weight[-1] * CLASSES, CLASSES - 1).astype(np.int64)
        _, self.class_of = np.unique(self.class_of, return_inverse=True)
        self.starts = np.flatnonzero(np.append(True, np.diff(self.class_of) != 0))
        self.class_mass = np.add.reduceat(mass, self.starts)
        self.mass = mass
        # Target of each frequent word: its place among the learned ones, or its class of the rest after them.
        self.size = len(mass)
        target = np.array([self.size + rest_class(w) for w in self.words] or [0], np.int64)
        place = np.arange(learned)
        target[:learned] = place + (place >= order)
        self.target = target
        self.log_count = np.log10(np.append(self.counts, 0) + 0.5)

    @property
    def log_total(self) -> float:
        return float(np.log10(self.tokens + 0.5 * (self.types + 1)))


def build_vocabulary(counts: DataFrame, n_docs: int) -> Vocabulary:
    """From stored counts: at most FREQUENT words reach the driver, cut at a count that a histogram of 512 steps gives."""
    step = F.floor(F.log2("n") * 8)
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    held, least = 0, None
    for r in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        if held + r["count"] > FREQUENT:
            break
        held, least = held + r["count"], r.step
    rows = sorted(((r.n, bytes(r.word)) for r in counts.where(step >= least).collect()), key=lambda r: (-r[0], r[1])) if held else []
    words, n = [w for _, w in rows], np.array([c for c, _ in rows], np.int64)
    learned = words[: LEARNED - 1]
    kind = F.crc32(F.substring("word", 1, 2)) % REST_CLASSES
    mass = np.full(REST_CLASSES, 0.5)
    for r in counts.groupBy(kind.cast("int").alias("c")).agg(F.sum(F.col("n") + 0.5).alias("m")).collect():
        mass[r.c] += r.m
    for w, c in zip(learned, n.tolist()):
        mass[rest_class(w)] -= c + 0.5
    return Vocabulary(words, n, n_docs, (total.n or 0) + n_docs, total.v + (n_docs > 0), np.maximum(mass, 0.5))


@dataclass
class Network:
    """Input rows (learned, rest classes, start) x 3H, recurrent weights, class and word outputs."""

    embed: np.ndarray
    recur: np.ndarray
    class_out: np.ndarray
    class_bias: np.ndarray
    word_out: np.ndarray
    word_bias: np.ndarray

    @classmethod
    def initial(cls, v: Vocabulary, seed: int = 0) -> Network:
        """Small random weights, and biases that give the shares of the counts."""
        draw = np.random.default_rng(seed)
        masses = np.concatenate((v.class_mass, v.rest_mass))
        return cls(
            draw.normal(0, 0.1, (v.size + REST_CLASSES + 1, 3 * HIDDEN)).astype(np.float32),
            draw.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 3 * HIDDEN)).astype(np.float32),
            draw.normal(0, 0.02, (HIDDEN, len(masses))).astype(np.float32),
            np.log(masses / masses.sum()).astype(np.float32),
            draw.normal(0, 0.02, (v.size, HIDDEN)).astype(np.float32),
            np.log(v.mass / v.class_mass[v.class_of]).astype(np.float32),
        )

    def parts(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    @classmethod
    def from_flat(cls, flat: np.ndarray, like: Network) -> Network:
        cuts = np.cumsum([p.size for p in like.parts()])[:-1]
        return cls(*(x.reshape(p.shape).astype(np.float32) for x, p in zip(np.split(flat, cuts), like.parts())))


def advance(net: Network, h: np.ndarray, given: np.ndarray) -> tuple[np.ndarray, tuple]:
    """One step of the gated recurrent unit, with what its gradient needs.

    A column is a lane, so that each gate is one block of memory; ``given`` are the lanes' input rows.
    """
    own = net.recur.T @ h
    gates = given[: 2 * HIDDEN] + own[: 2 * HIDDEN]
    np.exp(np.negative(gates, out=gates), out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    z, r = gates[:HIDDEN], gates[HIDDEN:]
    new = r * own[2 * HIDDEN :]
    new += given[2 * HIDDEN :]
    np.tanh(new, out=new)
    after = h - new
    after *= z
    after += new
    return after, (h, z, r, new, own[2 * HIDDEN :])


def step(net: Network, h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, tuple]:
    """``advance`` for states and inputs by rows."""
    after, kept = advance(net, h.T, net.embed[x].T)
    return after.T, kept


def given_rows(net: Network, x: np.ndarray) -> np.ndarray:
    """Input rows of a window, as (steps, 3H, lanes)."""
    return np.ascontiguousarray(net.embed[x].transpose(0, 2, 1))


def log_softmax_at(logits: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log probability of the chosen row of every column, and all probabilities as parts of a total."""
    if not (logits.min() > -SAFE_EXP and logits.max() < SAFE_EXP):
        logits -= logits.max(axis=0)
    chosen = logits[at, np.arange(len(at))]
    np.exp(logits, out=logits)
    total = logits.sum(axis=0)
    chosen -= np.log(total)
    return chosen, logits, total


def word_groups(v: Vocabulary, target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """Rows whose target is a learned word of a class with several, ordered by class; and for each class its run of these rows and of words."""
    ends = np.append(v.starts, v.size)
    learned = np.flatnonzero(target < v.size)
    kind = v.class_of[target[learned]]
    several = (np.diff(ends) > 1)[kind]
    learned, kind = learned[several], kind[several]
    order = np.argsort(kind, kind="stable")
    rows, kind = learned[order], kind[order]
    edge = np.flatnonzero(np.append(True, kind[1:] != kind[:-1])) if len(rows) else np.empty(0, np.int64)
    c = kind[edge]
    return rows, list(zip(edge.tolist(), np.append(edge[1:], len(rows)).tolist(), ends[c].tolist(), ends[c + 1].tolist()))


def class_target(v: Vocabulary, target: np.ndarray) -> np.ndarray:
    """Class of each target: of a learned word, or one of the rest after those."""
    known = np.append(v.class_of, np.arange(REST_CLASSES) + len(v.starts))
    return known[target]


def class_logits(net: Network, h: np.ndarray) -> np.ndarray:
    """A column for each row of states."""
    logits = net.class_out.T @ h.T
    logits += net.class_bias[:, None]
    return logits


def word_logits(net: Network, h: np.ndarray, a: int, b: int) -> np.ndarray:
    logits = net.word_out[a:b] @ h.T
    logits += net.word_bias[a:b, None]
    return logits


def output_log_p(net: Network, v: Vocabulary, h: np.ndarray, target: np.ndarray) -> np.ndarray:
    out = log_softmax_at(class_logits(net, h), class_target(v, target))[0].astype(np.float64)
    rows, runs = word_groups(v, target)
    own_h, own_target, found = h[rows], target[rows], np.empty(len(rows))
    for i, j, a, b in runs:
        found[i:j] = log_softmax_at(word_logits(net, own_h[i:j], a, b), own_target[i:j] - a)[0]
    out[rows] += found
    return out


def lanes_of(lengths: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Deal documents to lanes of about equal length, longest first; lanes by falling length, as (order of documents, lane lengths)."""
    heap = [(0, i) for i in range(min(lanes, len(lengths)))]
    held: list[list[int]] = [[] for _ in heap]
    total = np.zeros(len(heap), np.int64)
    for d in np.argsort(-lengths, kind="stable").tolist():
        used, i = heapq.heappop(heap)
        held[i].append(d)
        total[i] += lengths[d]
        heapq.heappush(heap, (used + int(lengths[d]), i))
    order = np.argsort(-total, kind="stable")
    return np.array(list(itertools.chain.from_iterable(held[i] for i in order)), np.int64), total[order]


def windows(v: Vocabulary, docs: list[np.ndarray], lanes: int, window: int) -> Iterator[tuple]:
    """Runs of ``window`` steps over all lanes: inputs, targets, starts of documents and places, each (steps, active lanes).

    A lane that ends inside a run is padded; its places are then -1. ``docs`` hold targets.
    """
    lengths = np.array([len(d) for d in docs], np.int64)
    order, total = lanes_of(lengths, lanes)
    flat = np.concatenate([docs[d] for d in order])
    own = np.cumsum(lengths) - lengths
    place = np.repeat(own[order], lengths[order]) + np.arange(len(flat)) - np.repeat(np.cumsum(lengths[order]) - lengths[order], lengths[order])
    begins = np.zeros(len(flat), bool)
    begins[np.cumsum(lengths[order]) - lengths[order]] = True
    before = np.append(0, flat[:-1])
    before[begins] = v.size + REST_CLASSES
    first = np.cumsum(total) - total
    for t in range(0, int(total[0]), window):
        active = int((total > t).sum())
        at = np.arange(t, t + window)[:, None]
        inside = at < total[None, :active]
        idx = np.where(inside, first[None, :active] + np.minimum(at, total[None, :active] - 1), 0)
        yield before[idx], flat[idx], begins[idx], np.where(inside, place[idx], -1)


def score_documents(net: Network, v: Vocabulary, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each document's targets, the state carried to its end."""
    lengths = np.array([len(d) for d in docs], np.int64)
    out = np.zeros(int(lengths.sum()))
    h = np.zeros((HIDDEN, min(SCORE_LANES, len(docs))), np.float32)
    for x, target, begins, place in windows(v, docs, SCORE_LANES, WINDOW):
        h = h[:, : x.shape[1]]
        given = given_rows(net, x)
        states = np.empty((len(x), *h.shape), np.float32)
        for t in range(len(x)):
            if begins[t].any():
                h = h * ~begins[t]
            h, _ = advance(net, h, given[t])
            states[t] = h
        real = place >= 0
        out[place[real]] = output_log_p(net, v, states.transpose(0, 2, 1)[real], target[real])
    return np.add.reduceat(out, np.cumsum(lengths) - lengths)


def window_gradient(net: Network, v: Vocabulary, h: np.ndarray, x: np.ndarray, target: np.ndarray, begins: np.ndarray, real: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, float]:
    """Gradient of the mean loss over one window, back to its first step; the state after it; the loss."""
    given, h = given_rows(net, x), h.T
    before, z, r, new, own, states = (np.empty((len(x), *h.shape), given.dtype) for _ in range(6))
    for t in range(len(x)):
        if begins[t].any():
            h = h * ~begins[t]
        h, (before[t], z[t], r[t], new[t], own[t]) = advance(net, h, given[t])
        states[t] = h
    n = max(1, int(real.sum()))
    hs, ts = states.transpose(0, 2, 1)[real], target[real]
    grads = [np.zeros_like(p) for p in net.parts()]
    d_embed, d_recur, d_class, d_class_bias, d_word, d_word_bias = grads
    kinds = class_target(v, ts)
    log_p, p, total = log_softmax_at(class_logits(net, hs), kinds)
    loss = -float(log_p.sum())
    p /= total * n
    p[kinds, np.arange(len(ts))] -= 1 / n
    d_class += (p @ hs).T
    d_class_bias += p.sum(axis=1)
    dh_out = p.T @ net.class_out.T
    rows, runs = word_groups(v, ts)
    own_h, own_target = hs[rows], ts[rows]
    dh_own = np.empty_like(own_h)
    for i, j, a, b in runs:
        log_p, p, total = log_softmax_at(word_logits(net, own_h[i:j], a, b), own_target[i:j] - a)
        loss -= float(log_p.sum())
        p /= total * n
        p[own_target[i:j] - a, np.arange(j - i)] -= 1 / n
        d_word[a:b] = p @ own_h[i:j]
        d_word_bias[a:b] = p.sum(axis=1)
        dh_own[i:j] = p.T @ net.word_out[a:b]
    dh_out[rows] += dh_own
    d_all = np.zeros_like(states)
    d_all.transpose(0, 2, 1)[real] = dh_out
    # What the gradients of the gates are multiples of, for all steps at once.
    of_new, of_z, of_r = (1 - z) * (1 - new * new), (before - new) * z * (1 - z), own * r * (1 - r)
    into, inner = np.empty_like(given), np.empty_like(given)
    dh = np.zeros_like(h)
    for t in range(len(x) - 1, -1, -1):
        dh += d_all[t]
        d_new = np.multiply(dh, of_new[t], out=into[t, 2 * HIDDEN :])
        np.multiply(dh, of_z[t], out=into[t, :HIDDEN])
        np.multiply(d_new, of_r[t], out=into[t, HIDDEN : 2 * HIDDEN])
        inner[t, : 2 * HIDDEN] = into[t, : 2 * HIDDEN]
        np.multiply(d_new, r[t], out=inner[t, 2 * HIDDEN :])
        dh *= z[t]
        dh += net.recur @ inner[t]
        if begins[t].any():
            dh *= ~begins[t]
    d_recur += np.matmul(before, inner.transpose(0, 2, 1)).sum(axis=0)
    # Gradients of one input row lie together after sorting and are added up as runs.
    order = np.argsort(x.astype(np.uint16), axis=None, kind="stable")
    rows = x.ravel()[order]
    edge = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    by_gate = into.transpose(1, 0, 2).reshape(3 * HIDDEN, -1)
    d_embed[rows[edge]] = np.add.reduceat(np.take(by_gate, order, axis=1), edge, axis=1).T
    return grads, h.T, loss / n


def train(net: Network, v: Vocabulary, docs: list[np.ndarray], rate: float | None = None) -> tuple[Network, list[float]]:
    """One pass of truncated backpropagation through time with Adam, the state carried from window to window."""
    lanes = min(MOST_LANES, max(LEAST_LANES, sum(map(len, docs)) // (WINDOW * STEPS)))
    rate = RATE * math.sqrt(lanes / MOST_LANES) if rate is None else rate
    net = Network(*(p.copy() for p in net.parts()))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parts()]
    h, log = np.zeros((min(lanes, len(docs)), HIDDEN), np.float32), []
    for n, (x, target, begins, place) in enumerate(windows(v, docs, lanes, WINDOW), 1):
        grads, h, loss = window_gradient(net, v, h[: x.shape[1]], x, target, begins, place >= 0)
        log.append(loss)
        # Windows with few lanes left count by their tokens.
        share = rate * min(1.0, float((place >= 0).sum()) / (lanes * WINDOW))
        for part, g, (m, s) in zip(net.parts(), grads, moments):
            m *= 0.9
            m += 0.1 * g
            s *= 0.99
            g *= g
            g *= 0.01
            s += g
            size = np.sqrt(s, out=g)
            size *= 1 / math.sqrt(1 - 0.99**n)
            size += 1e-6
            change = np.divide(m, size, out=size)
            change *= share / (1 - 0.9**n)
            part -= change
    return net, log


class Reader:
    """Texts as targets, for one task."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.index = {w: i for i, w in enumerate(v.words)}

    def targets(self, text: str | None) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Targets with the end, index of each frequent word (-1 for others), and the other words."""
        words = words_of(text)
        at = np.fromiter(map(self.index.get, words, itertools.repeat(-1)), np.int64, len(words))
        target = np.append(self.v.target[at], self.v.end)
        other = np.flatnonzero(at < 0).tolist()
        rare = [words[i] for i in other]
        if rare:
            target[other] = [self.v.size + rest_class(w) for w in rare]
        return target, at, rare


def _dealt(docs: DataFrame, shared, text: str, rounds: int) -> DataFrame:
    """``round, n, targets`` of every document, written once; a task deals runs of its documents to the rounds in turn, so that
    it writes no more files than it has runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        read, at = Reader(shared.value), TaskContext.get().partitionId()
        for b in batches:
            for texts in slices(b.column(0).to_pylist(), lambda t: len(t or "") + 8, DEALT_CHARS):
                found = [read.targets(t)[0] for t in texts]
                turn = np.full(len(found), at % rounds)
                at += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(turn, pa.int32()), pa.array([len(f) for f in found], pa.int64()), pa.array([f.astype(np.uint16).tobytes() for f in found], pa.binary())],
                    names=["round", "n", "targets"],
                )

    spark, path = docs.sparkSession, new_work_dir(docs.sparkSession, "targets")
    schema = "n bigint, targets binary, round int"
    docs.select(text).mapInArrow(run, "round int, n bigint, targets binary").write.partitionBy("round").parquet(path)
    return spark.read.schema(schema).parquet(path)


def fit(docs: DataFrame, v: Vocabulary, text: str = "text") -> Network:
    """Train on every document, each in one of several rounds.

    In a round, tasks of about equal size start from one network, and their weights are averaged by tokens,
    thirty-two at a time, until one network is left; the next round starts from it. Without documents the start comes back.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(v)
    rows = _dealt(docs, shared, text, max(LEAST_ROUNDS, math.isqrt(v.tokens // TRAIN_TOKENS)))
    net = Network.initial(v)
    for r in rows.groupBy("round").agg(F.sum("n").alias("n")).orderBy("round").collect():
        net = _round(rows.where(F.col("round") == r["round"]), net, shared, max(1, round(r.n / TRAIN_TOKENS)))
    return net


def _round(rows: DataFrame, start: Network, shared, tasks: int) -> Network:
    given = rows.sparkSession.sparkContext.broadcast(start)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = [np.frombuffer(t, np.uint16).astype(np.int64) for b in batches for t in b.column(0).to_pylist()]
        if docs:
            net, _ = train(given.value, shared.value, docs)
            yield _weights(net.flat().astype(np.float32), sum(map(len, docs)))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, tokens = None, 0
        for b in batches:
            for raw, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = np.frombuffer(raw, np.float32).astype(np.float64) * n
                total, tokens = (part if total is None else total + part), tokens + n
        if tokens:
            yield _weights((total / tokens).astype(np.float32), tokens)

    nets = rows.select("targets").repartition(tasks).mapInArrow(learn, "weights binary, n bigint")
    while tasks > 1:
        tasks = -(-tasks // 32)
        nets = nets.repartition(tasks).mapInArrow(merge, "weights binary, n bigint")
    found = nets.collect()  # one row
    given.unpersist()
    return Network.from_flat(np.frombuffer(found[0].weights, np.float32), start)


def _weights(flat: np.ndarray, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([flat.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["weights", "n"])


def log_likelihood(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every document.

    Counts and network come from the rows outside ``held_out``; a null text is an empty one, whose only
    token is the end. Scores are base-10 logarithms. Repeated rows are scored alike, and with
    no training rows every word has the share of an unseen one. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), held_out.alias("held_out"))
    seen = rows.where("not held_out")
    counts = stored(word_counts(seen), "counts")
    v = build_vocabulary(counts, seen.count())
    net = fit(seen, v)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((v, net))
    schema = f"row bigint, doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, rare array<binary>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v, net = shared.value
        read, row = Reader(v), TaskContext.get().partitionId() << 33
        log_rest = np.log10(np.append(v.mass, v.rest_mass))
        for b in batches:
            at = 0
            for texts in slices(b.column(1).to_pylist(), lambda t: len(t or "") + 8, SLICE_CHARS):
                found = [read.targets(t) for t in texts]
                score = score_documents(net, v, [f[0] for f in found]) / np.log(10)
                known, base = np.empty(len(texts), np.int64), np.empty(len(texts))
                for i, (target, index, rare) in enumerate(found):
                    common = index[index >= 0]
                    known[i] = len(common) + (v.ends > 0)
                    base[i] = v.log_count[common].sum() + np.log10(v.ends + 0.5)
                    rest = target >= v.size
                    score[i] -= log_rest[target[rest]].sum()
                    score[i] += v.log_count[common[v.target[common] >= v.size]].sum()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + len(texts))), b.column(0).slice(at, len(texts)), b.column(2).slice(at, len(texts)),
                        pa.array([len(f[0]) for f in found], pa.int64()), pa.array(known), pa.array(base), pa.array(score),
                        pa.array([f[2] for f in found], pa.list_(pa.binary())),
                    ],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare"],
                )
                row += len(texts)
                at += len(texts)

    scored = stored(rows.select("doc_id", "text", "held_out").mapInArrow(run, schema), "scored")
    rare = scored.select("row", F.explode("rare").alias("word"))
    found = rare.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    more = found.groupBy("row").agg(F.sum(F.log10(F.col("n") + 0.5)).alias("more"), F.count_if(F.col("n") > 0).alias("known"))
    out = scored.drop("rare").join(more, "row", "left")
    extra = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + extra - F.col("n_tokens") * v.log_total).alias("base_score"), (F.col("score") + extra).alias("score"),
    )
