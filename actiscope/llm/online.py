"""Sum-of-squares packing of token sequences, online.

Each task packs its documents as it reads them. A window is open while it is partly filled; the
number of open windows of each fill level is held in one array. A document goes to the level that
makes the sum of the squared counts least. At the end of a task (or when very many windows are open)
what is open is joined, and where that leaves room also cut, into full windows and a few whose length is
a power of two, which need no padding. No row is shuffled, so no key can be hot.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actiscope.llm.common import slices
from actiscope.llm.packing import encoder

WINDOW_TOKENS = 1024
OPEN_WINDOWS = 4096
"""Windows a task holds open: 16 MB of ids at most."""


def padded(length: int, size: int = WINDOW_TOKENS) -> int:
    """Tokens a sequence takes: its own at a power of two, else ``size``."""
    return length if length & (length - 1) == 0 else size


class Levels:
    """How many open windows there are of each fill level."""

    def __init__(self, size: int = WINDOW_TOKENS):
        self.size = size
        self.count = np.zeros(size + 1, np.int64)

    def choose(self, n: int) -> int:
        """Level of the window that takes ``n`` tokens, 0 for a new one: the one that makes the sum of squared
        counts least, of equals the fullest. ``n`` is below the window's size."""
        before, after = self.count[1 : self.size - n + 1], self.count[n + 1 :]
        # Taking one from before and adding one to after; a window that gets full is in no count.
        change = 2 * (after - before) + 2
        change[-1] -= 1
        change = np.where(before > 0, change, np.iinfo(np.int64).max)
        level = len(change) - int(change[::-1].argmin())
        return level if change[level - 1] <= 2 * self.count[n] + 1 else 0

    def move(self, level: int, n: int) -> None:
        """A window goes from ``level`` to ``level + n``; neither empty nor full windows are counted."""
        if level:
            self.count[level] -= 1
        if level + n < self.size:
            self.count[level + n] += 1


Piece = tuple[object, int, int, bytes]  # id, start in its document, tokens of the document, ids


class Packer:
    """Windows of one task. ``add`` and ``close`` give the windows that are done, as lists of pieces."""

    def __init__(self, size: int = WINDOW_TOKENS, most_open: int = OPEN_WINDOWS):
        self.size, self.most_open = size, most_open
        self.levels = Levels(size)
        self.windows: dict[int, list[list[Piece]]] = {}
        self.n_open = 0

    def add(self, doc_id, ids: bytes) -> Iterator[list[Piece]]:
        total, step = len(ids) // 4, 4 * self.size
        whole = len(ids) - len(ids) % step
        for at in range(0, whole, step):
            yield [(doc_id, at // 4, total, ids[at : at + step])]
        if whole < len(ids):
            yield from self._place((doc_id, whole // 4, total, ids[whole:]))

    def _place(self, piece: Piece) -> Iterator[list[Piece]]:
        n = len(piece[3]) // 4
        level = self.levels.choose(n)
        self.levels.move(level, n)
        window = self.windows[level].pop() if level else []
        window.append(piece)
        self.n_open += not level
        if level + n == self.size:
            self.n_open -= 1
            yield window
        else:
            self.windows.setdefault(level + n, []).append(window)
        if self.n_open >= self.most_open:
            yield from self.close()

    def close(self) -> Iterator[list[Piece]]:
        """All open windows without padding. The fullest takes the fullest others that still fit; then those that are
        full or at a power of two go as they are, and the pieces of the others are cut where a window is
        full and, at the end, into powers of two."""
        rest: list[Piece] = []
        held = sorted(level for level, windows in self.windows.items() if windows)
        while held:
            window, room = [], self.size
            while (i := bisect_right(held, room)) and room:
                level = held[i - 1]
                window += self.windows[level].pop()
                room -= level
                if not self.windows[level]:
                    held.pop(i - 1)
            if padded(self.size - room, self.size) == self.size - room:
                yield window
            else:
                rest += window
        self.windows, self.n_open, self.levels = {}, 0, Levels(self.size)
        yield from filled(rest, self.size)


def filled(pieces: Iterable[Piece], size: int) -> Iterator[list[Piece]]:
    """Pieces in order, cut into windows of ``size`` and at last of falling powers of two."""
    pieces = list(pieces)
    left = sum(len(p[3]) for p in pieces) // 4
    window, room = [], 0
    for doc_id, start, total, ids in pieces:
        while ids:
            if not room:
                room = size if left >= size else 1 << (left.bit_length() - 1)
            part, ids = ids[: 4 * room], ids[4 * room :]
            window.append((doc_id, start, total, part))
            n = len(part) // 4
            start, room, left = start + n, room - n, left - n
            if not room:
                yield window
                window = []


def pack_online(
    docs: DataFrame, tokenizer: str, size: int = WINDOW_TOKENS, keep_ids: bool = False, end_id: int = 0, most_open: int = OPEN_WINDOWS,
    id_col: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, if kept, ``ids``.

    A null text is an empty one, and every document ends with ``end_id``. A document longer than
    ``size`` fills windows of its own first; what is left of it is placed like any other. Only the
    windows that a task leaves open are cut further. Rows with a null or repeated id are documents of their
    own. Other columns are not read; an empty table gives no rows.
    """
    if not size > 1 or size & (size - 1):
        raise ValueError(f"a window of {size} tokens is no power of two")
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType)])
    for name in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"):
        schema.add(name, T.LongType())
    if keep_ids:
        schema.add("ids", T.ArrayType(T.IntegerType()))
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, packer = encoder(tokenizer), Packer(size, most_open)
        number, rows, kept = TaskContext.get().partitionId() << 32, [], []

        def take(windows: Iterable[list[Piece]]) -> None:
            nonlocal number
            for window in windows:
                offset = 0
                for doc_id, start, total, ids in window:
                    n = len(ids) // 4
                    rows.append((doc_id, start, n, zlib.crc32(ids), total, number, offset))
                    if keep_ids:
                        kept.append(np.frombuffer(ids, "<u4").astype(np.int32))
                    offset += n
                number += 1

        def batch_of() -> pa.RecordBatch:
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), [id_type] + 6 * [pa.int64()])]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
            rows.clear()
            kept.clear()
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            id_type, at = batch.schema.types[0], 0
            for texts in slices(t or "" for t in batch.column(1).to_pylist()):
                ids = batch.column(0).slice(at, len(texts)).to_pylist()
                at += len(texts)
                for doc_id, one in zip(ids, texts):
                    take(packer.add(doc_id, encode.encode_one(one) + end))
                if rows:
                    yield batch_of()
        take(packer.close())
        if rows:
            yield batch_of()

    return docs.select(F.col(id_col), F.col(text)).mapInArrow(run, schema)
