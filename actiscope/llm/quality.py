"""A byte-level convolutional quality classifier, trained and applied in numpy.

Learned filters slide over all bytes of a text. Their responses are max-pooled over
chunks of ``2 * HALF`` bytes that overlap by half, and the largest and the mean response of
each filter over all chunks are combined into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actiscope.llm.common import release_memory, slices, trimmed

WIDTH = 6
FILTERS = 16
HALF = 128
TRAIN_ROWS = 4_000
"""Labelled documents that a classifier learns from at most, chosen by hash."""
TRAIN_BYTES = 24_000_000
"""Bytes of text it learns from at most; whole documents, in hash order."""
STEPS = 1_000
"""Batches that training takes, whatever the number of rows."""
FOLDS = 5
HELD_OUT = 0
THRESHOLD = 0.3


@dataclass
class ByteConvNet:
    """Filters (width x 256 x filters), their biases, output weights (2 x filters) and bias."""

    filters: np.ndarray
    offset: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    @classmethod
    def initial(cls, seed: int = 0) -> ByteConvNet:
        draw = np.random.default_rng(seed)
        return cls(
            draw.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32),
            draw.normal(0, 0.1, 2 * FILTERS).astype(np.float32), np.zeros(1, np.float32),
        )

    def parts(self) -> list[np.ndarray]:
        return [self.filters, self.offset, self.output, self.bias]

    def pairs(self) -> np.ndarray:
        """Responses to two bytes at a time (width / 2 x 65536 x filters), for fast scoring."""
        f = self.filters
        return (f[0::2, :, None, :] + f[1::2, None, :, :]).reshape(WIDTH // 2, 65536, FILTERS)


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each after WIDTH zeros and padded with zeros to whole half chunks, and each one's number of halves.

    A filter at the end of one text so meets zeros, never the next text.
    """
    halves = np.array([max(1, -(-(len(t) + WIDTH) // HALF)) for t in texts])
    data = np.zeros(int(halves.sum()) * HALF + WIDTH, np.uint8)
    for text, at in zip(texts, (np.cumsum(halves) - halves) * HALF + WIDTH):
        data[at : at + len(text)] = np.frombuffer(text, np.uint8)
    return data, halves


def pooled(responses: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: largest and mean over its overlapping chunks; per chunk its maxima."""
    single = halves == 1
    first = np.cumsum(halves) - halves
    pair = np.maximum(responses, np.concatenate((responses[1:], responses[-1:])))
    last = first + halves - 1
    pair[last[single]] = responses[last[single]]
    chunks = np.maximum(1, halves - 1)
    keep = np.ones(len(responses), bool)
    keep[last[~single]] = False
    pair = pair[keep]
    starts = np.cumsum(chunks) - chunks
    return np.maximum.reduceat(pair, starts), np.add.reduceat(pair, starts) / chunks[:, None], pair


def score(net: ByteConvNet, pairs: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Probability of label 1 for each text; an empty one is a chunk of zeros."""
    data, halves = laid_out(texts)
    two = data[:-1].astype(np.int32) * 256 + data[1:]
    n = len(data) - WIDTH
    maxima = np.empty((n // HALF, FILTERS), np.float32)
    step = 256 * HALF
    for at in range(0, n, step):
        end = min(n, at + step)
        x = pairs[0].take(two[at:end], axis=0)
        for j in range(1, WIDTH // 2):
            x += pairs[j].take(two[at + 2 * j : end + 2 * j], axis=0)
        maxima[at // HALF : end // HALF] = x.reshape(-1, HALF, FILTERS).max(axis=1)
    maxima = np.maximum(maxima + net.offset, 0)
    largest, mean, _ = pooled(maxima, halves)
    z = np.concatenate((largest, mean), axis=1).astype(np.float64) @ net.output + float(net.bias[0])
    return 1 / (1 + np.exp(-z))


def gradient(net: ByteConvNet, texts: list[bytes], labels: np.ndarray) -> tuple[list[np.ndarray], float]:
    """Gradient of the mean log loss; only the bytes under a maximum get a share."""
    data, halves = laid_out(texts)
    n = len(data) - WIDTH
    x = np.zeros((n, FILTERS), np.float32)
    for j in range(WIDTH):
        x += net.filters[j].take(data[j : j + n], axis=0)
    x = x.reshape(-1, HALF, FILTERS)
    where = x.argmax(axis=1)
    raw = np.take_along_axis(x, where[:, None, :], axis=1)[:, 0] + net.offset
    maxima = np.maximum(raw, 0)
    largest, mean, pair = pooled(maxima, halves)
    features = np.concatenate((largest, mean), axis=1)
    p = 1 / (1 + np.exp(-(features @ net.output + net.bias[0])))
    dz = ((p - labels) / len(texts)).astype(np.float32)
    d_output, d_features = features.T @ dz, dz[:, None] * net.output[None, :]

    # Down to half chunks: the mean shares out evenly, the largest goes to the first chunk that has it.
    chunks = np.maximum(1, halves - 1)
    doc = np.repeat(np.arange(len(texts)), chunks)
    d_pair = d_features[doc, FILTERS:] / chunks[doc, None]
    top = pair == largest[doc]
    begin = np.cumsum(chunks) - chunks
    before = np.cumsum(top, axis=0)
    base = before[begin] - top[begin]
    top &= before - base[doc] == 1
    d_pair += top * d_features[doc, :FILTERS]
    left = np.arange(len(doc)) + doc * 1  # one half more than chunks in every text ...
    extra = np.cumsum((halves == 1).astype(int)) - (halves == 1)
    left -= extra[doc]  # ... but in those of one chunk
    right = np.where(halves[doc] == 1, left, left + 1)
    d_max = np.zeros_like(maxima)
    to_left = maxima[left] >= maxima[right]
    np.add.at(d_max, left, d_pair * to_left)
    np.add.at(d_max, right, d_pair * ~to_left)
    d_max *= raw > 0

    half, f = np.nonzero(d_max)
    value, at = d_max[half, f], half * HALF + where[half, f]
    d_filters = np.zeros_like(net.filters)
    for j in range(WIDTH):
        d_filters[j] = np.bincount(data[at + j].astype(np.int64) * FILTERS + f, value, 256 * FILTERS).reshape(256, FILTERS)
    loss = -np.mean(np.where(labels > 0, np.log(p + 1e-9), np.log(1 - p + 1e-9)))
    return [d_filters, d_max.sum(axis=0), d_output, np.array([dz.sum()], np.float32)], float(loss)


def train(texts: list[bytes], labels: np.ndarray, steps: int = STEPS, rate: float = 0.02, batch: int = 32, seed: int = 0) -> ByteConvNet:
    """Adam on batches of whole texts, the rate falling to zero; without rows, a classifier that says one half."""
    net = ByteConvNet.initial(seed)
    if not len(texts):
        net.output[:] = 0
        return net
    share = float(np.clip(np.mean(labels), 0.02, 0.98))
    net.bias[0] = np.log(share / (1 - share))
    draw, step = np.random.default_rng(seed), 0
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parts()]
    while step < steps:
        order = draw.permutation(len(texts))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            grads, _ = gradient(net, [texts[i] for i in rows], labels[rows])
            step += 1
            now = rate * max(0.0, 1 - step / (steps + 1))
            for part, g, (m, v) in zip(net.parts(), grads, moments):
                m *= 0.9
                m += 0.1 * g
                v *= 0.98
                v += 0.02 * g * g
                part -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-6)
    return net


def fold(id_col: str = "doc_id", folds: int = FOLDS):
    """Remainder of the CRC-32 of an id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text: str = "text", max_rows: int = TRAIN_ROWS, max_bytes: int = TRAIN_BYTES) -> ByteConvNet:
    """Train on labelled documents outside the held-out fold.

    At most ``max_rows`` of them, those with the smallest hashes of their ids, and of these
    whole texts up to ``max_bytes``; one task trains and only the weights come back. Rows with a
    null id or label, and labelled ids without a document, teach nothing; an id
    labelled twice takes the larger label.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col) != HELD_OUT))
    chosen = (
        known.groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(max_rows)
    )
    # The chosen side is bounded by max_rows ids.
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.withColumn("order", F.xxhash64("id")).repartition(1).sortWithinPartitions("order", "id", "text")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks, size = [], [], 0
        for batch in batches:
            for content, mark in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                content = content.encode()
                if size + len(content) <= max_bytes and len(texts) < max_rows:
                    texts.append(content)
                    marks.append(mark)
                    size += len(content)
        net = train(texts, np.array(marks, np.float32))
        yield pa.RecordBatch.from_arrays([pa.array([p.tobytes() for p in net.parts()], pa.binary())], names=["part"])

    found = [np.frombuffer(r.part, np.float32).copy() for r in rows.select("text", "label").mapInArrow(trimmed(learn), "part binary").collect()]
    if not found:  # no rows, so no task
        return train([], np.empty(0))
    blank = ByteConvNet.initial().parts()
    return ByteConvNet(*(f.reshape(b.shape) for f, b in zip(found, blank)))


def with_quality(docs: DataFrame, net: ByteConvNet, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability that a text is good, from its whole bytes. A null text is an empty one.

    Rows stay where they are; a column already called ``out`` is replaced.
    """
    parts = net.parts()

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = ByteConvNet(*parts)
        pairs = model.pairs()
        for texts in batches:
            data = [(t or "").encode() for t in texts]
            found = np.concatenate([score(model, pairs, s) for s in slices(data)] or [np.empty(0)])
            del data
            release_memory()
            yield pd.Series(found)

    return docs.withColumn(out, of(F.col(text)))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with their own columns."""
    column = "_quality_score"
    while column in docs.columns:
        column += "_"
    return with_quality(docs, fit(docs, labels), out=column).where(F.col(column) >= threshold).drop(column)
