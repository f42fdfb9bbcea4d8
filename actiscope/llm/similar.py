"""Near-duplicate classes by an exact Jaccard join of word shingles with signature trees.

Equal sets are one node. Two sets above the threshold share several of their few smallest
shingle hashes (their prefixes), so sets with enough shared prefix hashes meet under them. Under each hash a
tree of OR-combined bitmaps and size ranges is traversed against itself, and pairs of nodes that cannot
overlap enough, or lie in one component already, are skipped. First every set is compared
under its smallest shared hash only, then under its largest one whose sets are still in different
components; the hashes that remain open after that are looked at by bitmaps, and what these leave
is verified on the sets. Of a set's shared hashes the most frequent ones need not be looked at: as
many as two linked sets share, less one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from actiscope.llm.common import release_memory, rows_of, shuffle_partitions, slices, trimmed
from actiscope.llm.graph import components
from actiscope.llm.substrings import Words, planes, run_hashes, unpack_planes
from actiscope.session import broadcast_if_small, new_work_dir, passing_tables, stored

SLICE_CHARS = 2_000_000
GROUP_SETS = 4_096
"""Sets of a group that one task compares; larger groups are dealt to cells."""
FANOUT = 4
PAIR_WORDS = 2_000_000
"""64-bit words of bitmaps that one step of a traversal reads."""


@dataclass(frozen=True)
class Rule:
    """Shingle length and threshold in percent."""

    shingle: int = 5
    percent: int = 80

    def least_shared(self, n):
        """Prefix hashes that two linked sets share, if the smaller has n shingles."""
        return 1 + (n - -(-n * self.percent // 100)) // 2

    def prefix(self, n: int) -> int:
        """Smallest hashes of a set of n that are looked at: those beyond the least intersection, and as many as must be shared."""
        return n - -(-n * self.percent // 100) + self.least_shared(n)

    def linked(self, both: int, a: int, b: int) -> bool:
        return 100 * both >= self.percent * (a + b - both)

    def needed(self, total):
        """Least intersection of two sets whose sizes add up to ``total``."""
        return -(-self.percent * total // (100 + self.percent))

    def size_class(self, n):
        """Sizes in one of two neighbouring classes can link, others can't."""
        return F.floor(F.log(n.cast("double")) / math.log(100 / self.percent) + 1e-9).cast("int")


def shingle_sets(texts: list[str], rule: Rule) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles: all its words for a text of fewer than one shingle's, none without words."""
    w = Words(t.encode().lower().split() for t in texts)
    h = w.hashes[w.ids]
    runs = run_hashes(h, rule.shingle) if len(h) >= rule.shingle else np.empty(0, np.uint64)
    out = []
    for first, n in zip(w.first.tolist(), w.lengths.tolist()):
        if n >= rule.shingle:
            out.append(np.unique(runs[first : first + n - rule.shingle + 1]))
        elif n:
            out.append(np.array([xxhash.xxh3_64_intdigest(h[first : first + n].tobytes(), seed=n)], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signature(values: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(values.tobytes())
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _batch(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    named = [part.split() for part in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), named)], names=[n for n, _ in named])


def sets_of(docs: DataFrame, rule: Rule, columns: str, emit) -> DataFrame:
    """Run ``emit`` over (id, set, signature) of slices of documents; ``docs`` is (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(rows_of(batches), lambda r: len(r[1]), SLICE_CHARS):
            sets = shingle_sets([r[1] for r in part], rule)
            found = emit([r[0] for r in part], sets, [signature(s) for s in sets])
            if found:
                yield _batch(found, columns)
            del found, sets
            release_memory()

    return docs.mapInArrow(trimmed(run), columns)


def shared_hashes(docs: DataFrame, rule: Rule, buckets: int, parts: int) -> DataFrame:
    """``hash, s1, s2``: prefix hashes that sets of different signatures share, with those sets.

    A slice sends the prefix of each distinct set once, as packed numbers in one row per bucket.
    """

    def emit(_, sets, signs):
        sets = list({s: x for s, x in zip(signs, sets) if len(x)}.items())
        if not sets:
            return []
        prefix = [x[: rule.prefix(len(x))] for _, x in sets]
        owner = np.repeat(np.arange(len(sets)), [len(p) for p in prefix])
        hashes, names = np.concatenate(prefix), np.array([s for s, _ in sets], np.int64)
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edge = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0))
        out = []
        for i, j in zip(edge, np.append(edge[1:], len(order))):
            used, which = np.unique(owner[order[i:j]], return_inverse=True)
            parts = names[used, 0], names[used, 1], which, hashes[order[i:j]].view(np.int64)
            out.append((int(bucket[order[i]]), b"".join(map(planes, parts))))
        return out

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held):
            tables = []
            for raw in held:
                at, parts = 0, []
                for _ in range(4):
                    part, at = unpack_planes(raw, at)
                    parts.append(part)
                tables.append(np.column_stack((parts[3], parts[0][parts[2]], parts[1][parts[2]])))
            table = np.concatenate(tables)
            table = table[np.lexsort((table[:, 2], table[:, 1], table[:, 0]))]
            new = np.append(True, (table[1:] != table[:-1]).any(axis=1))
            table = table[new]
            same = np.append(False, table[1:, 0] == table[:-1, 0])
            table = table[same | np.append(same[1:], False)]
            if len(table):
                yield pa.RecordBatch.from_arrays([pa.array(table[:, i]) for i in range(3)], names=["hash", "s1", "s2"])

        held, now = [], None
        for bucket, blob in rows_of(batches):
            if held and bucket != now:
                yield from done(held)
                held = []
            now = bucket
            held.append(blob)
        if held:
            yield from done(held)

    sent = sets_of(docs, rule, "bucket int, blob binary", emit)
    return sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(keep), "hash bigint, s1 bigint, s2 bigint")


def bitmap(values: np.ndarray) -> np.ndarray:
    """Bits of hashes, at least four for each of them, in a power of two of 64-bit words."""
    words = 1 << max(0, (4 * len(values) - 1).bit_length() - 6)
    bits = np.zeros(words * 64, bool)
    bits[(values % np.uint64(words * 64)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    while len(bits) > words:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


class Tree:
    """Levels over sets ordered by size: bitmaps, size ranges, lost bits (size less set bits) and whether one component holds a node."""

    def __init__(self, sizes: np.ndarray, bits: list[np.ndarray], label: np.ndarray):
        words = min(len(b) for b in bits)
        self.parent = np.unique(label, return_inverse=True)[1].ravel().astype(np.int64)
        first = {}
        for i, c in enumerate(self.parent.tolist()):
            first.setdefault(c, i)
        self.parent = np.array([first[c] for c in self.parent.tolist()], np.int64)
        own = np.stack([folded(b, words) for b in bits])
        lost = sizes - np.bitwise_count(own).sum(axis=1).astype(np.int64)
        self.levels = [(own, sizes, sizes, lost)]
        while len(self.levels[-1][0]) > 1:
            own, low, high, lost = self.levels[-1]
            at = np.arange(0, len(own), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(own, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(lost, at)))
        self.dirty = True

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return int(i)

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)
        self.dirty = True

    def labels(self, level: int) -> np.ndarray:
        """Component of each node of a level, or -1 where it holds several."""
        if self.dirty:
            p = self.parent
            while (p[p] != p).any():
                p = p[p]
            self.parent = p
            self.of = [p]
            for own, *_ in self.levels[1:]:
                below = self.of[-1]
                at = np.arange(0, len(below), FANOUT)
                low, high = np.minimum.reduceat(below, at), np.maximum.reduceat(below, at)
                self.of.append(np.where(low == high, low, -1))
            self.dirty = False
        return self.of[level]

    def pairs(self, rule: Rule) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of sets (first before second) that bitmaps and sizes allow to link and that no component joins yet."""
        top = len(self.levels) - 1
        most = max(1, PAIR_WORDS // self.levels[0][0].shape[1])
        stack = [(top, top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            lu, lv, u, v = stack.pop()
            if len(u) > most:
                stack.append((lu, lv, u[most:], v[most:]))
                u, v = u[:most], v[:most]
            keep = self._possible(rule, lu, lv, u, v)
            u, v = u[keep], v[keep]
            if not len(u):
                continue
            if lu == lv == 0:
                yield u, v
            elif lu == lv:
                # The first side goes down alone, then the second: a set against a node of sets prunes best.
                a, b = self._children(lu, u, v)
                stack.append((lu - 1, lv, a, b))
            else:
                b, a = self._children(lv, v, u)
                ordered = a < b if lu == lv - 1 == 0 else a <= b
                stack.append((lu, lv - 1, a[ordered], b[ordered]))

    def _children(self, level: int, nodes: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        child = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        inside = child < len(self.levels[level - 1][0])
        return child[inside], np.repeat(others, FANOUT)[inside]

    def _possible(self, rule: Rule, lu: int, lv: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        (own_u, low_u, high_u, lost_u), (own_v, low_v, high_v, lost_v) = self.levels[lu], self.levels[lv]
        keep = (100 * high_u[u] >= rule.percent * low_v[v]) & (100 * high_v[v] >= rule.percent * low_u[u])
        a, b = self.labels(lu)[u], self.labels(lv)[v]
        keep &= (a != b) | (a < 0)
        at = np.flatnonzero(keep)
        both = np.bitwise_count(own_u[u[at]] & own_v[v[at]]).sum(axis=1).astype(np.int64)
        # A set's overlap is at most its bits in common and what its bits don't show.
        room = both + np.minimum(lost_u[u[at]], lost_v[v[at]]) if lu == lv == 0 else both + lost_u[u[at]]
        keep[at] = room >= rule.needed(low_u[u[at]] + low_v[v[at]])
        return keep


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def linked_sets(nodes: np.ndarray, sets: list[np.ndarray], label: np.ndarray, rule: Rule) -> list[tuple[int, int]]:
    """Links that connect what a group's links connect and its labels don't: along the order of sizes first, then by the tree."""
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), nodes[i]))
    sets, nodes, label = [sets[i] for i in order], nodes[order], label[order]
    sizes = np.array([len(s) for s in sets], np.int64)
    out: list[tuple[int, int]] = []
    tree = Tree(sizes, [bitmap(s) for s in sets], label)

    def check(a: int, b: int) -> None:
        if tree.root(a) != tree.root(b) and rule.linked(overlap(sets[a], sets[b]), len(sets[a]), len(sets[b])):
            tree.join(a, b)
            out.append((int(nodes[a]), int(nodes[b])))

    for i in range(1, len(sets)):
        check(i - 1, i)
    hub = len(sets) // 2
    for i in range(len(sets)):
        check(hub, i)
    for a, b in tree.pairs(rule):
        for i, j in zip(a.tolist(), b.tolist()):
            check(i, j)
    return out


def _groups(rows: Iterator[tuple], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    held, now = [], None
    for row in rows:
        if held and row[:width] != now:
            yield now, held
            held = []
        now = row[:width]
        held.append(row[width:])
    if held:
        yield now, held


def classes_of(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """``row, doc_id, n_shingles, component_id, component`` for every row of ``docs``.

    Two documents link when their shingle sets reach the rule's Jaccard similarity; a component's id is the
    smallest id that links reach, and ``component`` its smallest row number, which no other component has. Null and
    empty texts have no shingles, no ``component`` and link with nothing. Rows that repeat an id are documents of their own;
    a null id is never the smallest unless all are null. ``row`` names a column of written row numbers; without
    it, rows are numbered here. Other columns are not read.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    content = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # Numbered before they are written: numbers made while reading would follow the file splits of each read.
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    numbered = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), number.alias("row"))
    named = "row bigint, id bigint, n bigint, s1 bigint, s2 bigint"
    both = numbered.select(F.struct("row", "id").alias("id"), "text")
    rows = stored(sets_of(both, rule, named, lambda ids, sets, signs: [(i["row"], i["id"], len(x), *s) for i, x, s in zip(ids, sets, signs)]), "rows")
    # Equal sets are one node, named by its first row.
    nodes = stored(rows.where("n > 0").groupBy("s1", "s2").agg(F.min("row").alias("node"), F.min("id").alias("least"), F.first("n").alias("n")), "nodes")
    keys = stored(shared_hashes(content, rule, parts, parts).join(nodes, ["s1", "s2"]).select("hash", "node", "n"), "keys")
    for _ in range(2):  # the second time without hashes that only dropped sets shared
        keys = stored(_enough_shared(keys, rule), "keys")
    alive = keys.select("node").distinct()
    ids = stored(rows.join(alive.withColumnRenamed("node", "row"), "row", "left_semi").select("id").distinct(), "ids")
    some = content.join(broadcast_if_small(ids.withColumnRenamed("id", "wanted")), F.col("id").cast("long").eqNullSafe(F.col("wanted")), "left_semi")
    sets = sets_of(some, rule, "s1 bigint, s2 bigint, content binary", lambda _, sets, signs: [(*s, x.tobytes()) for s, x in {s: x for s, x in zip(signs, sets) if len(x)}.items()])
    sets = stored(sets.join(nodes.join(alive, "node", "left_semi"), ["s1", "s2"]).groupBy("node").agg(F.first("content").alias("content")), "sets")
    own = keys.groupBy("node").agg(F.min("hash").alias("hash")).select("hash", F.lit(0).alias("kind"), "node", F.col("node").alias("component"))
    links = _hash_links(own, sets, rule, parts, "first")
    few = stored(_rarest(keys, rule), "few")
    spread = _open_groups(few, links, rule)
    own = spread.groupBy("node", "component").agg(F.max(F.struct("hash", "kind")).alias("at")).select("at.hash", "at.kind", "node", "component")
    links = links.union(_hash_links(own, sets, rule, parts, "second"))
    links = links.union(_later_links(_open_groups(few, links, rule), sets, rule, parts))
    found = components(links).withColumnRenamed("node", "member")
    placed = nodes.join(found, nodes["node"] == found["member"], "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    by_set = stored(placed.join(least, "component").select("s1", "s2", "component_id", "component"), "classes")
    joined = rows.join(broadcast_if_small(by_set), ["s1", "s2"], "left")
    least_id = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return joined.select("row", F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), least_id.alias("component_id"), "component")


def _must_share(rule: Rule) -> str:
    """Prefix hashes that a set of ``n`` shares with whatever it links with: as many as the smallest such set asks for."""
    p = rule.percent
    smaller = f"((n * {p} + 99) div 100)"
    return f"(1 + ({smaller} - ({smaller} * {p} + 99) div 100) div 2)"


def _enough_shared(keys: DataFrame, rule: Rule) -> DataFrame:
    """Keys of the sets that share enough prefix hashes, and of these the hashes still shared."""
    per_set = F.expr(f"count(1) >= {_must_share(rule)}")
    enough = keys.groupBy("node", "n").agg(per_set.alias("enough")).where("enough").select("node")
    left = keys.join(enough, "node", "left_semi")
    still = left.groupBy("hash").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("hash")
    return left.join(still, "hash", "left_semi")


def _rarest(keys: DataFrame, rule: Rule) -> DataFrame:
    """Keys without the most frequent hashes of each set. Two linked sets share at least as many as each may
    lose and one more; the rarest of these has the others before it in both, so neither loses it."""
    frequency = keys.groupBy("hash").agg(F.count(F.lit(1)).alias("members"))
    place = F.row_number().over(W.partitionBy("node").orderBy(F.desc("members"), "hash"))
    return keys.join(frequency, "hash").withColumn("place", place).where(F.col("place") >= F.expr(_must_share(rule))).select("hash", "node", "n")


def _hash_links(own: DataFrame, sets: DataFrame, rule: Rule, parts: int, name: str) -> DataFrame:
    """Links among the sets under one (hash, kind) each, in cells of bounded size that differ from pass to pass."""
    sizes = own.groupBy("hash", "kind").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    cell = F.pmod(F.xxhash64("node", F.lit(name)), F.ceil(F.col("members") / GROUP_SETS))
    cells = own.join(sizes, ["hash", "kind"]).withColumn("cell", cell)
    key = ("hash", "kind", "cell")
    grouped = cells.join(sets, "node").select(*key, "node", "component", "content").repartition(parts, *key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, members in _groups(rows_of(batches), len(key)):
            if len({m[1] for m in members}) > 1:
                nodes, label = (np.array([m[i] for m in members]) for i in (0, 1))
                links = linked_sets(nodes, [np.frombuffer(m[2], np.uint64) for m in members], label, rule)
                if links:
                    yield _batch(links, "a bigint, b bigint")

    return stored(grouped.mapInArrow(trimmed(run), "a bigint, b bigint"), name)


def _open_groups(keys: DataFrame, links: DataFrame, rule: Rule) -> DataFrame:
    """``hash, kind, node, component, n, blocks``: the sets under each hash and size class that links so far leave in several components."""
    found = components(links).withColumnRenamed("node", "member")
    placed = stored(keys.join(found, keys["node"] == found["member"], "left").select("hash", "node", "n", F.coalesce("component", "node").alias("component")), "placed")
    kind = rule.size_class(F.col("n"))
    # A set belongs to its size class and visits the next one.
    spread = placed.select("hash", "node", "n", "component", F.explode(F.array(kind, kind + 1)).alias("kind"), kind.alias("home"))
    group = spread.groupBy("hash", "kind").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("members"), F.max("home").alias("home"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("mark"),
    )
    # Groups of one component, or of visitors only, have nothing to find; of those with the same members one is enough.
    group = group.where("low != high and home = kind")
    once = F.row_number().over(W.partitionBy("kind", "members", "mark").orderBy("hash"))
    group = group.withColumn("once", once).where("once = 1").select("hash", "kind", F.ceil(F.col("members") / GROUP_SETS).alias("blocks"))
    rows = spread.join(broadcast_if_small(stored(group, "groups")), ["hash", "kind"])
    return stored(rows.select("hash", "kind", "node", "component", "n", "blocks"), "open")


def _later_links(rows: DataFrame, sets: DataFrame, rule: Rule, parts: int) -> DataFrame:
    """The remaining links: under each hash between sets of different components, by bitmaps, then verified."""
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")}).select("hash", "kind", "x", "y", "node", "component")

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(rows_of(batches), lambda r: len(r[1]), 8_000_000):
            yield _batch([(n, len(x) // 8, bitmap(np.frombuffer(x, np.uint64)).tobytes()) for n, x in part], "node bigint, n bigint, bits binary")

    maps = sets.join(rows.select("node").distinct(), "node", "left_semi").select("node", "content").mapInArrow(trimmed(bits), "node bigint, n bigint, bits binary")
    grouped = rows.join(maps, "node")
    grouped = grouped.select("hash", "kind", "x", "y", "node", "component", "n", "bits").repartition(parts, "hash", "kind", "x", "y").sortWithinPartitions("hash", "kind", "x", "y", "n", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, members in _groups(rows_of(batches), 4):
            if len({m[1] for m in members}) > 1:
                nodes = np.array([m[0] for m in members])
                tree = Tree(np.array([m[2] for m in members], np.int64), [np.frombuffer(m[3], np.uint64) for m in members], np.array([m[1] for m in members]))
                for a, b in tree.pairs(rule):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(nodes[a], nodes[b])), pa.array(np.maximum(nodes[a], nodes[b]))], names=["a", "b"])

    pairs = stored(grouped.mapInArrow(trimmed(run), "a bigint, b bigint").distinct(), "pairs")
    both = pairs.join(sets.withColumnsRenamed({"node": "b", "content": "content_b"}), "b").join(sets.withColumnsRenamed({"node": "a", "content": "content_a"}), "a")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(rows_of(batches), lambda r: len(r[2]) + len(r[3]), 8_000_000):
            read = [(a, b, np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for a, b, x, y in part]
            links = [(a, b) for a, b, x, y in read if rule.linked(overlap(x, y), len(x), len(y))]
            if links:
                yield _batch(links, "a bigint, b bigint")

    return stored(both.select("a", "b", "content_a", "content_b").mapInArrow(trimmed(verify), "a bigint, b bigint"), "later")


def one_of_each(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id") -> DataFrame:
    """The documents without near copies: of each component one row stays, with its columns.

    It is a row with the smallest id, any one of several; a null id comes last. Rows are told apart by a number written
    with them, not by their ids. Documents without words all stay.
    """
    row = "one_of_each_row"
    spark = docs.sparkSession
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    copies = new_work_dir(spark, "copies")
    with passing_tables(spark, "near-copies"):
        found = stored(classes_of(numbered, rule, id_col, row=row).where("n_shingles > 0").select("row", "doc_id", "component"), "found")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
        kept = found.groupBy("component").agg(first.alias("first")).select("first.row")
        drop = stored(found.join(kept, "row", "left_anti").select(F.col("row").alias(row)), "copies", copies)
    return numbered.join(broadcast_if_small(drop), row, "left_anti").select(*docs.columns)
