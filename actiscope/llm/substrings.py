"""Exact removal of repeated word windows by super-k-mer partitioning.

Each window of ``window`` words has a minimiser, the smallest hash of its runs of
``gram`` words. Consecutive windows with the same minimiser travel to its bucket as one
packed string of words, so equal windows always meet. A bucket sorts its windows and
compares equal-looking ones word by word. Windows that repeat within a task's slice of
documents are settled there and only the earliest travels, so a passage that
a third of all documents hold reaches its bucket once per slice.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actiscope.llm.common import free_name, release_memory, rows_of, shuffle_partitions, slices, trimmed

WINDOW = 20
GRAM = 4
SLICE_CHARS = 6_000_000
"""Characters of text whose windows a task holds at once."""
BUCKETS_PER_PARTITION = 2
COMMON = 65_536
"""Words that packed strings name by number; others are spelled. This is about size, not about results."""
COMMON_SHARE = 64
"""One in so many documents, by hash of the text, gives the counts that choose them."""
LOWEST = -(1 << 63)
SPANS = "doc bigint, key bigint, starts binary"
SENT = f"bucket int, settled boolean, {SPANS}"


HANDED_BYTES = 8 << 20
"""Bytes of marked starts that a task hands on together."""


def words_of(text: str) -> list[bytes]:
    """Runs of bytes other than space and the five ASCII control spaces."""
    return text.encode().split()


class Words:
    """Documents of a slice as numbers of words, with each word's hash; read one at a time, so that no other document's words are held."""

    def __init__(self, docs: Iterable[list[bytes]]):
        number: dict[bytes, int] = {}
        own = [np.fromiter((number.setdefault(w, len(number)) for w in d), np.int32, len(d)) for d in docs]
        self.ids = np.concatenate(own) if own else np.empty(0, np.int32)
        self.words = list(number)
        self.lengths = np.array([len(d) for d in own], np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.hashes = word_hashes(self.words)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n values; runs may cross documents and are then not used."""
    base, total, have, done, run = 0x9E3779B97F4A7C15, None, 1, 0, h
    with np.errstate(over="ignore"):
        while done < n:
            if n & have:
                rest = run[done:] if done else run
                size = len(h) - done - have + 1
                if total is None:
                    total = rest[:size]
                else:
                    total = total[:size] * np.uint64(pow(base, have, 1 << 64))
                    total += rest[:size]
                done += have
            if done < n:
                longer = run[:-have] * np.uint64(pow(base, have, 1 << 64))
                longer += run[have:]
                run = longer
                have *= 2
        return _mixed(total)


def window_starts(lengths: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and document of every window that lies within one document."""
    count = np.maximum(0, lengths - window + 1)
    kind = np.int32 if int(lengths.sum()) < 1 << 31 else np.int64
    places = np.repeat((first - np.cumsum(count) + count).astype(kind), count)
    places += np.arange(len(places), dtype=kind)
    return places, np.repeat(np.arange(len(lengths), dtype=kind), count)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    have = 1
    while 2 * have <= n:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (n - have)], x[n - have :]) if have < n else x


def repeated(ids: np.ndarray, places: np.ndarray, rank: tuple[np.ndarray, np.ndarray], window: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window: whether an equal one has a smaller rank (doc, start), and whether it stands for its class.

    ``hashes`` brings equal windows together; the words themselves decide. The one that
    stands for a class has its smallest rank.
    """
    if not len(places):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.lexsort((rank[1], rank[0], hashes))
    same = np.zeros(len(order), bool)
    by_hash = hashes[order]
    same[1:] = by_hash[1:] == by_hash[:-1]
    del by_hash
    row = np.flatnonzero(same)
    if len(row):
        a, b = places[order[row]], places[order[row - 1]]
        equal = np.ones(len(row), bool)
        for j in range(window):
            equal &= ids[a + j] == ids[b + j]
        if not equal.all():  # different words under one hash: order by the words as well
            columns = [ids[places + j] for j in range(window - 1, -1, -1)]
            order = np.lexsort((rank[1], rank[0], *columns))
            at = places[order]
            same[1:] = np.logical_and.reduce([ids[at[1:] + j] == ids[at[:-1] + j] for j in range(window)])
    # The first of a class has none before it; each other is compared with the first.
    row = np.flatnonzero(same)
    head = np.flatnonzero(~same)
    own, least = order[row], order[head[np.searchsorted(head, row) - 1]]
    earlier = np.zeros(len(order), bool)
    earlier[own] = (rank[0][own] > rank[0][least]) | (rank[1][own] > rank[1][least])
    del row, head, own, least
    stands = np.empty(len(order), bool)
    stands[order] = ~same
    return earlier, stands


def _runs(marks: np.ndarray, doc: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Per document the marked starts, as pairs of first start and number of consecutive ones."""
    at = np.flatnonzero(marks)
    if not len(at):
        return
    at = at[np.lexsort((start[at], doc[at]))]
    d, s = doc[at], start[at]
    new = np.ones(len(at), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1] + 1)
    begin = np.flatnonzero(new)
    pairs = np.column_stack((s[begin], np.diff(np.append(begin, len(at))))).astype("<u4")
    owner = d[begin]
    edge = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    for i, j in zip(edge, np.append(edge[1:], len(owner))):
        yield int(owner[i]), pairs[i:j].tobytes()


def common_words(docs: DataFrame, text: str = "text") -> list[bytes]:
    """At most COMMON frequent words of a share of the documents, the most frequent first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter(w for b in batches for t in b.column(0).to_pylist() for w in words_of(t))
        if counts:
            yield _batch(list(counts.items()), (pa.binary(), pa.int64()), ["word", "n"])

    some = docs.select(F.col(text).alias("t")).where(F.col("t").isNotNull() & (F.pmod(F.xxhash64("t"), F.lit(COMMON_SHARE)) == 0))
    counts = some.mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    return [bytes(r.word) for r in counts.orderBy(F.desc("n"), "word").limit(COMMON).collect()]


def pack_super_kmers(w: Words, doc_ids: np.ndarray, keys: np.ndarray, window: int, gram: int, buckets: int, common: dict[bytes, int]):
    """Settle repeats inside the slice and pack the windows that must travel.

    Returns the marked starts per document, and (bucket, blob) pairs.
    """
    places, doc = window_starts(w.lengths, w.first, window)
    start = places - w.first[doc]
    if not len(places):
        return [], []
    h = w.hashes[w.ids]
    rank = np.unique(doc_ids, return_inverse=True)[1].astype(np.int32)[doc]
    earlier, stands = repeated(w.ids, places, (rank, start), window, run_hashes(h, window)[places])
    del rank
    settled = [(doc_ids[d], keys[d], runs) for d, runs in _runs(earlier, doc, start)]
    del earlier
    least = sliding_min(run_hashes(h, gram), window - gram + 1)[places]
    del h
    joined = np.zeros(len(places), bool)
    joined[1:] = stands[1:] & stands[:-1] & (least[1:] == least[:-1]) & (doc[1:] == doc[:-1])
    head = np.flatnonzero(stands & ~joined)
    bucket = (least[head] % np.uint64(buckets)).astype(np.int64)
    # A row's length: the windows that travel between its head and the next.
    length = np.diff(np.append(np.cumsum(stands, dtype=np.int32)[head], int(stands.sum()) + 1)) + window - 1
    del least, joined, stands
    code = np.fromiter((common.get(x, -1) for x in w.words), np.int64, len(w.words))
    blobs = []
    order = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)) if len(order) else []
    for i, j in zip(edge, np.append(edge[1:], len(order))) if len(order) else ():
        rows = order[i:j]
        begin, size = places[head[rows]], length[rows]
        take = np.arange(int(size.sum())) + np.repeat(begin - np.cumsum(size) + size, size)
        content = w.ids[take]
        coded = code[content]
        rare, place = np.unique(content[coded < 0], return_inverse=True)
        coded[coded < 0] = len(common) + place
        owner, which = np.unique(doc[head[rows]], return_inverse=True)
        parts = [doc_ids[owner], keys[owner], which, start[head[rows]], size, coded]
        raw = b"".join(map(planes, parts)) + b" ".join([w.words[k] for k in rare.tolist()])
        blobs.append((int(bucket[rows[0]]), zstandard.ZstdCompressor(level=3).compress(raw)))
    return settled, blobs


def planes(values: np.ndarray) -> bytes:
    """Whole numbers as their lowest bytes, then their next, as far as they differ from zero."""
    data = np.ascontiguousarray(values, "<i8").view(np.uint8).reshape(-1, 8)
    width = max([i + 1 for i in range(8) if data[:, i].any()], default=0)
    return struct.pack("<qq", len(data), width) + data[:, :width].T.tobytes()


def unpack_planes(raw: bytes, at: int) -> tuple[np.ndarray, int]:
    n, width = struct.unpack_from("<qq", raw, at)
    data = np.zeros((n, 8), np.uint8)
    data[:, :width] = np.frombuffer(raw, np.uint8, n * width, at + 16).reshape(width, n).T
    return data.view("<i8").ravel(), at + 16 + n * width


def unpack_super_kmers(blobs: list[bytes], n_common: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """All super-k-mers of a bucket: rows (doc, key, start, words), their words as numbers, and the spelled words, numbered after the common ones."""
    number: dict[bytes, int] = {}
    headers, contents = [], []
    for blob in blobs:
        raw, at, parts = zstandard.ZstdDecompressor().decompress(blob), 0, []
        for _ in range(6):
            part, at = unpack_planes(raw, at)
            parts.append(part)
        doc, key, which, start, size, content = parts
        headers.append(np.column_stack((doc[which], key[which], start, size)))
        own = np.array([n_common + number.setdefault(x, len(number)) for x in raw[at:].split(b" ") if x], np.int32)
        content, spelled = content.astype(np.int32), content >= n_common
        content[spelled] = own[content[spelled] - n_common]
        contents.append(content)
    return np.concatenate(headers), np.concatenate(contents), list(number)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in words), np.uint64, len(words))


def settle_bucket(blobs: list[bytes], window: int, common: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Windows of a bucket that start earlier elsewhere, as runs of starts per document; ``common`` are the hashes of the common words."""
    headers, ids, words = unpack_super_kmers(blobs, len(common))
    first = np.cumsum(headers[:, 3]) - headers[:, 3]
    places, row = window_starts(headers[:, 3], first, window)
    start = headers[row, 2] + places - first[row]
    hashes = np.concatenate((common, word_hashes(words)))
    earlier, _ = repeated(ids, places, (headers[row, 0], start), window, run_hashes(hashes[ids], window)[places])
    # One document has one (doc, key); number the pairs that are marked.
    row, start = row[earlier], start[earlier]
    pair, owner = np.unique(headers[row, :2], axis=0, return_inverse=True)
    return [(*pair[d].tolist(), runs) for d, runs in _runs(np.ones(len(row), bool), owner.ravel(), start)]


def repeated_starts(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, key, starts``: the windows of each document that also start earlier, as runs of starts.

    A document may have several rows. ``doc`` is the id (the smallest number for null) and
    ``key`` a hash of the text, which tells apart rows that share an id. Rows with
    the same id and text are one document; of different texts under one id neither is the earlier at equal starts.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    buckets = parts * BUCKETS_PER_PARTITION
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("doc"), F.xxhash64(text).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    shared = spark.sparkContext.broadcast(common_words(docs, text))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = {x: i for i, x in enumerate(shared.value)}

        for part in slices(rows_of(batches), lambda r: len(r[2]), SLICE_CHARS):
            w = Words(words_of(r[2]) for r in part)
            doc_ids, keys = (np.array([r[i] for r in part], np.int64) for i in (0, 1))
            part.clear()
            settled, blobs = pack_super_kmers(w, doc_ids, keys, window, gram, buckets, common)
            rows = [(int(d) % buckets, True, d, k, runs) for d, k, runs in settled] + [(b, False, None, None, blob) for b, blob in blobs]
            if rows:
                yield _batch(rows, (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()), ["bucket", "settled", "doc", "key", "starts"])
            del w, settled, blobs, rows
            release_memory()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, common = [], None, word_hashes(shared.value)
        spans = (pa.int64(), pa.int64(), pa.binary()), ["doc", "key", "starts"]
        done, size = [], 0
        for bucket, settled, doc, key, data in rows_of(batches):
            if settled:
                done.append((doc, key, data))
                size += len(data)
            else:
                if held and bucket != now:
                    done += settle_bucket(held, window, common)
                    size, held = HANDED_BYTES, []
                now = bucket
                held.append(data)
            if size >= HANDED_BYTES and done:
                yield _batch(done, *spans)
                done, size = [], 0
                release_memory()
        if done:
            yield _batch(done, *spans)
        if held and (done := settle_bucket(held, window, common)):
            yield _batch(done, *spans)

    sent = rows.mapInArrow(trimmed(cut), SENT).repartition(parts, "bucket").sortWithinPartitions("bucket")
    return sent.mapInArrow(trimmed(settle), SPANS)


def _batch(rows: list[tuple], kinds: tuple, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def covered(n: int, starts: list[bytes], window: int) -> np.ndarray:
    """Which of n words a marked window covers."""
    edge = np.zeros(n + 1, np.int64)
    for runs in starts:
        pairs = np.frombuffer(runs, "<u4").reshape(-1, 2).astype(np.int64)
        np.add.at(edge, pairs[:, 0], 1)
        np.add.at(edge, np.minimum(n, pairs[:, 0] + pairs[:, 1] + window - 1), -1)
    return np.cumsum(edge[:n]) > 0


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept_text``: the words outside repeated windows, joined by one space.

    A word goes when a window that covers it has the same words as one that starts earlier
    (smaller id, or earlier in the same document). Null texts have no words; texts shorter than a window
    lose none. The three columns replace others of those names.
    """
    names = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_text")]
    starts = repeated_starts(docs, window, gram, id_col, text)
    doc, key, begun, made = (free_name(n, names) for n in ("_doc", "_key", "_starts", "_kept"))
    # Copies of a row mark the same starts, which are kept once.
    marks = starts.groupBy(F.col("doc").alias(doc), F.col("key").alias(key)).agg(F.collect_set("starts").alias(begun))
    keyed = docs.select(*names).withColumns({doc: F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)), key: F.xxhash64(text)})
    joined = keyed.join(marks, [doc, key], "left")

    @F.pandas_udf("n_words long, n_removed long, kept_text string")
    def kept(texts: pd.Series, marked: pd.Series) -> pd.DataFrame:
        out = []
        for content, runs in zip(texts, marked):
            words = words_of(content or "")
            gone = covered(len(words), list(runs), window) if runs is not None else np.zeros(len(words), bool)
            stay = [w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words
            out.append((len(words), len(words) - len(stay), b" ".join(stay).decode()))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept_text"])

    return joined.withColumn(made, kept(F.col(text), F.col(begun))).select(*names, f"{made}.*")


def cut_repeats(docs: DataFrame, **settings) -> DataFrame:
    """The documents with repeated windows cut out; a text that loses nothing stays as it is.

    A text that changes has its kept words joined by one space, and its new ``n_chars``.
    """
    out = without_repeats(docs, **settings)
    changed = F.col("n_removed") > 0
    columns = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(changed, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(columns).select(*docs.columns)
