"""Best-two-fit packing of token sequences.

Texts are tokenized where they are read; only one short row per piece moves.
Pieces are dealt at random into groups of bounded size and every group is packed
on its own, which costs at most one part-filled sequence per group.
"""

from __future__ import annotations

import array
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actiscope.llm.common import slices
from actiscope.session import stored

MAX_TOKENS = 2048
GROUP_PIECES = 16_384
"""Pieces packed together; a few hundred KB in a task."""
CACHED_CHARS = 8_000_000
"""Characters of words, and of pre-tokens, whose ids a worker keeps between texts."""
# Byte-level pre-tokens of a word without spaces inside, and the characters for which
# these classes are the same in every Unicode version.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
PLAIN_WORD = re.compile(f"[\\t\\n\\r!-~{LETTERS[6:]}]*")
PLAIN_TEXT = re.compile(f"[\\t\\n\\r -~{LETTERS[6:]}]*")
PRE_TOKENS = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[0-9]+| ?[^\\s{LETTERS}0-9]+|\\s+(?!\\S)|\\s+")


def byte_names() -> dict[int, str]:
    """The character by which a byte-level vocabulary names each byte: its own where it can be seen, else one from 256 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Ids(dict):
    """Token ids by text, as little-endian 32-bit bytes, made at the first look and kept up to a number of characters."""

    def __init__(self, make, most: int):
        self.make, self.most, self.chars = make, most, 0

    def __missing__(self, text: str) -> bytes:
        self.chars += len(text)
        if self.chars > self.most:
            self.clear()
            self.chars = len(text)
        ids = self[text] = self.make(text)
        return ids


class WordCache:
    """Token ids of texts, as little-endian 32-bit bytes, with each pre-token or word encoded once.

    A text of common characters alone is cut into its pre-tokens. For others words are kept:
    Byte-level pre-tokenization never joins a space to what stands before it, and
    joins it to what follows unless that is white space. A text can so be cut before
    every space that has no white space on both sides, and the parts encoded alone. A new
    word of common letters is put together from its pre-tokens, which are kept as well. Texts
    that hold the string of an added token are encoded whole.
    """

    inside_run = re.compile(r"\s \s|  ")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join([*map(re.escape, added), self.inside_run.pattern]))
        self.added = added
        self.names = byte_names()
        self.pre_tokens, self.words = Ids(self._pre_token, CACHED_CHARS), Ids(self._word, CACHED_CHARS)

    def _pre_token(self, text: str) -> bytes:
        if text.isascii() and text[1:].isprintable() and " " not in text[1:] and text[0] >= " ":
            named = self.names[32] + text[1:] if text[0] == " " else text
        else:
            named = text.encode().decode("latin-1").translate(self.names)
        return array.array("I", [t.id for t in self.tokenizer.model.tokenize(named)]).tobytes()

    def _part(self, text: str) -> bytes:
        if PLAIN_WORD.fullmatch(text, text.startswith(" ")):
            return b"".join(map(self.pre_tokens.__getitem__, PRE_TOKENS.findall(text)))
        return self._text(text)

    def _word(self, word: str) -> bytes:
        return self._part(" " + word)

    def _text(self, text: str) -> bytes:
        return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode_one(self, text: str) -> bytes:
        if PLAIN_TEXT.fullmatch(text) and not any(map(text.__contains__, self.added)):
            return b"".join(map(self.pre_tokens.__getitem__, PRE_TOKENS.findall(text)))
        if self.whole.search(text):
            return self._text(text)
        head, *rest = text.split(" ")
        return self._part(head) + b"".join(map(self.words.__getitem__, rest))

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self.encode_one(t) for t in texts]


_caches: dict[str, WordCache] = {}


def encoder(path: str) -> WordCache:
    """The worker's encoder, kept from task to task."""
    if path not in _caches:
        _caches[path] = WordCache(path)
    return _caches[path]


def piece_lengths(n: int, most: int) -> list[int]:
    """Lengths of the pieces of n tokens: full ones, after a first one that takes the rest."""
    rest = n % most
    return ([rest] if rest else []) + [most] * (n // most)


def tokenize(
    docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, keep_ids: bool = False, end_id: int = 0,
    id_col: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32`` and, if kept, ``ids``.

    A null text is an empty one, and every document ends with ``end_id``, so each row
    gives a piece at least. Rows with a null or repeated id are documents of their own.
    Other columns are not read.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType)])
    for name, kind in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())):
        schema.add(name, kind)
    if keep_ids:
        schema.add("ids", T.ArrayType(T.IntegerType()))
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            at = 0
            for texts in slices((t or "" for t in batch.column(1).to_pylist())):
                rows, out, ids = [], [], []
                for row, data in enumerate(encode.encode(texts), at):
                    data += end
                    start = 0
                    for piece, length in enumerate(piece_lengths(len(data) // 4, max_tokens)):
                        part = data[4 * start : 4 * (start + length)]
                        rows.append(row)
                        out.append((piece, start, length, zlib.crc32(part)))
                        if keep_ids:
                            ids.append(np.frombuffer(part, "<u4").astype(np.int32))
                        start += length
                at += len(texts)
                columns = [batch.column(0).take(pa.array(rows, pa.int64()))]
                columns += [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                if keep_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(F.col(id_col), F.col(text)).mapInArrow(run, schema)


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every length, none of which exceeds ``capacity``.

    A bin is filled with the longest items that still fit. When none fits, its
    smallest item makes room for the two unpacked ones that, together longer than
    it, come closest to the room it leaves. Equal lengths go in their given order.
    """
    lengths = np.asarray(lengths)
    order = np.argsort(lengths, kind="stable")[::-1]
    waiting: dict[int, list[int]] = {}
    for i in order.tolist():
        waiting.setdefault(int(lengths[i]), []).append(i)
    count = np.zeros(capacity + 1, np.int64)
    for size, items in waiting.items():
        count[size] = len(items)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left, number = len(lengths), 0
    while left:
        room, content = capacity, []
        sizes = np.flatnonzero(count)
        while room > 0:
            i = int(np.searchsorted(sizes, room, "right")) - 1
            if i < 0:
                break
            size = int(sizes[i])
            take = min(room // size, int(count[size]))
            content += [waiting[size].pop() for _ in range(take)]
            count[size] -= take
            room -= take * size
            sizes = sizes[:i]
        if room > 0:
            small = int(lengths[content[-1]])
            pair = _closest_pair(count, room + small, small)
            if pair:
                waiting[small].append(content.pop())
                count[small] += 1
                for size in pair:
                    content.append(waiting[size].pop())
                    count[size] -= 1
        at = 0
        for i in content:
            bins[i], offsets[i] = number, at
            at += int(lengths[i])
        left -= len(content)
        number += 1
    return bins, offsets


def _closest_pair(count: np.ndarray, room: int, above: int) -> tuple[int, int] | None:
    """Two waiting lengths with the largest sum in (above, room]."""
    sizes = np.flatnonzero(count[: room + 1])
    if not len(sizes):
        return None
    partner = np.searchsorted(sizes, room - sizes, "right") - 1
    alone = (partner >= 0) & (sizes[partner] == sizes) & (count[sizes] < 2)
    partner = np.where(alone, partner - 1, partner)
    total = np.where(partner >= 0, sizes + sizes[partner], 0)
    best = int(total.argmax())
    if total[best] <= above:
        return None
    return int(sizes[best]), int(sizes[partner[best]])


def pack(pieces: DataFrame, max_tokens: int = MAX_TOKENS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: sequences without gaps, filled by best-two-fit.

    ``pieces`` needs ``length``, between 1 and ``max_tokens``; all its columns are kept. It is
    written to the work folder once, so that what is counted is what is dealt out. Rows
    are dealt in turn, whatever they hold, so repeated rows cannot fill one group.
    """
    kept = stored(pieces, "pieces")
    groups = max(1, -(-kept.count() // group_pieces))
    schema = T.StructType([*kept.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at = kept.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        table = pa.Table.from_batches(held).combine_chunks()
        bins, offsets = best_two_fit(table.column(at).to_numpy(), max_tokens)
        first = TaskContext.get().partitionId() << 32
        table = table.append_column("sequence_id", pa.array(bins + first)).append_column("offset", pa.array(offsets))
        yield from table.to_batches(max_chunksize=10_000)

    return kept.repartition(groups).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, keep_ids: bool = False, **names) -> DataFrame:
    """Tokenize, cut and pack: one row per piece of each document. An empty table gives no rows."""
    return pack(tokenize(docs, tokenizer, max_tokens, keep_ids, **names), max_tokens)


def sequences(packed: DataFrame) -> DataFrame:
    """Token ids of every sequence, from pieces that kept their ids; a sequence is bounded by its length."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
