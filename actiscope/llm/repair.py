"""Conversation structure repair by divide and conquer over four states.

Reading a conversation turn by turn, the repaired one so far is in one of four states: empty,
after the system turn, after a user turn, after an assistant turn. What a run of turns can do is a
``Step``: for each state before and after it the least cost, and which of the cheapest edit strings
comes first. Steps of neighbouring runs combine into one. To find the cheapest edits, a forward vector over
the first half and a backward vector over the second meet in the middle, the crossing with the
first edit string is taken, and both halves are solved alone. Only the crossings are kept.

Turns are put in order by ranges, so that a long conversation lies in many tasks. It is cut into blocks
of bounded length, the blocks into groups of bounded number, and so on; the same search runs over
turns, blocks and groups. Only the digest of a repaired text is made in one task a conversation, as a stream
that holds one batch of turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actiscope.llm.common import shuffle_partitions
from actiscope.session import stored

BLOCK_BITS, PART_BITS = 12, 33
"""Turns of a block, as a power of two; bits of a row's place that number the rows of one task."""
FAN = 4096
"""Blocks or groups of one conversation that are searched together."""

# White space, ends of sentences, roles and costs.
BLANK = r"\A[\x20\x09-\x0D]*\z"
CUT_OFF = r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z"
SENTENCE_ENDS = "[.!?]"
ROLES = ("user", "assistant")
RENAME, DELETE, INSERT, UNFINISHED = 1, 2, 5, 5
FAULTS = ("", "blank", "duplicate", "truncated")

START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
STATES = range(4)
FAR = 1 << 40
# What may be said next after each state (0 user, 1 assistant), and the state it leads to.
NEXT_ROLE = (0, 0, 1, 0)
NEXT_STATE = (AFTER_USER, AFTER_USER, AFTER_ASSISTANT, AFTER_USER)
# Inserts that end a conversation well.
TAILS = ("", "II", "I", "")
TAIL_COST = tuple(INSERT * len(t) for t in TAILS)

Vector = tuple[tuple[int, ...], tuple[int, ...]]  # costs of the four states, ranks of their edit strings
Step = tuple[tuple[int, ...], tuple[int, ...]]  # the same for each state before and after: 16 numbers each


@lru_cache(None)
def edits(code: int) -> dict[tuple[int, int], tuple[int, str]]:
    """(state before, state after) to the least (cost, edit string) of one turn.

    ``code`` is 4 * fault + initial, of initials 0 to 3 for s, u, a and others. Two inserts reach every
    state that inserts can reach, so more are never cheapest.
    """
    fault, initial = divmod(code, 4)
    found: dict[tuple[int, int], tuple[int, str]] = {}
    for before in STATES:
        state = before
        for n in range(3):
            options = [(DELETE, "D", state)]
            if FAULTS[fault] in ("", "truncated"):
                extra = UNFINISHED if fault else 0
                if initial == NEXT_ROLE[state] + 1:
                    options.append((extra, "K", NEXT_STATE[state]))
                if initial == 0 and state == START:
                    options.append((extra, "K", AFTER_SYSTEM))
                options.append((extra + RENAME, "R", NEXT_STATE[state]))
            for cost, letter, after in options:
                new = (cost + INSERT * n, "I" * n + letter)
                found[before, after] = min(found.get((before, after), new), new)
            state = NEXT_STATE[state]
    return found


@lru_cache(None)
def turn_step(code: int) -> Step:
    """The step of one turn. Edit strings of one state before end in a letter that takes the turn and have no other, so none starts another."""
    found = edits(code)
    costs, ranks = [], []
    for before in STATES:
        order = sorted((found[before, after][1], after) for after in STATES if (before, after) in found)
        place = {after: i for i, (_, after) in enumerate(order)}
        costs += [found.get((before, after), (FAR, ""))[0] for after in STATES]
        ranks += [place.get(after, 9) for after in STATES]
    return tuple(costs), tuple(ranks)


def at_state(state: int) -> Vector:
    return tuple(0 if s == state else FAR for s in STATES), tuple(0 if s == state else 9 for s in STATES)


@lru_cache(1 << 16)
def forward(vector: Vector, step: Step) -> tuple[Vector, int]:
    """The vector after a step, less its least cost, and that cost. Cheapest first, then the edit string that comes first."""
    costs, ranks = vector
    best = []
    for after in STATES:
        best.append(min((min(costs[p] + step[0][4 * p + after], FAR), ranks[p], step[1][4 * p + after]) for p in STATES))
    order = sorted({b[1:] for b in best if b[0] < FAR})
    least = min(b[0] for b in best)
    return (tuple(b[0] - least if b[0] < FAR else FAR for b in best), tuple(order.index(b[1:]) if b[0] < FAR else 9 for b in best)), least


@lru_cache(1 << 16)
def backward(step: Step, costs: tuple[int, ...]) -> tuple[int, ...]:
    """Least costs to the end from each state before a step, given those after it; less the least of them."""
    found = [min(min(step[0][4 * p + q] + costs[q] for q in STATES), FAR) for p in STATES]
    least = min(found)
    return tuple(c - least if c < FAR else FAR for c in found)


def run_forward(vector: Vector, steps: Sequence[Step], low: int, high: int) -> tuple[Vector, int]:
    total = 0
    for i in range(low, high):
        vector, least = forward(vector, steps[i])
        total += least
    return vector, total


def combined(steps: Sequence[Step]) -> Step:
    """One step for a run of steps."""
    costs, ranks = [], []
    for before in STATES:
        vector, total = run_forward(at_state(before), steps, 0, len(steps))
        costs += [c + total if c < FAR else FAR for c in vector[0]]
        ranks += vector[1]
    return tuple(costs), tuple(ranks)


def meet(vector: Vector, costs: tuple[int, ...]) -> int:
    """The state at which a forward and a backward vector meet at least cost, of equals the one whose edit string comes first."""
    return min(STATES, key=lambda s: (min(vector[0][s] + costs[s], FAR), vector[1][s]))


def crossings(steps: Sequence[Step], start: int, end: int | None) -> list[int]:
    """The state before each step and after the last, on the cheapest way from ``start`` to ``end`` (None: to any good end)."""
    n = len(steps)
    states = [start] * (n + 1)
    if end is None:
        end = meet(run_forward(at_state(start), steps, 0, n)[0], TAIL_COST)
    states[n] = end
    waiting = [(0, n)]
    while waiting:
        low, high = waiting.pop()
        if high - low < 2:
            continue
        middle = (low + high) // 2
        costs = at_state(states[high])[0]
        for i in range(high - 1, middle - 1, -1):
            costs = backward(steps[i], costs)
        states[middle] = meet(run_forward(at_state(states[low]), steps, low, middle)[0], costs)
        waiting += [(low, middle), (middle, high)]
    return states


def cheapest_edits(codes: bytes, start: int = START, end: int | None = None) -> tuple[int, str, int]:
    """(cost, edit string, last state) of turns given by their codes; without an ``end``, inserts at the end are part of them."""
    states = crossings([turn_step(c) for c in codes], start, end)
    chosen = [edits(c)[a, b] for c, a, b in zip(codes, states, states[1:])]
    tail = TAILS[states[-1]] if end is None else ""
    return sum(c for c, _ in chosen) + INSERT * len(tail), "".join(s for _, s in chosen) + tail, states[-1]


@lru_cache(1 << 16)
def short_edits(codes: bytes, start: int, end: int | None) -> tuple[int, str, int]:
    """The same for short conversations, of which many are alike."""
    return cheapest_edits(codes, start, end)


class Rewriter:
    """Turns of one conversation, repaired one after the other by its edit string."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _say(self) -> str:
        role = ROLES[NEXT_ROLE[self.state]]
        self.state = NEXT_STATE[self.state]
        return role

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._say(), ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "R":
            yield self._say(), text
        elif letter == "K":
            self.state = AFTER_SYSTEM if role[:1] == "s" else NEXT_STATE[self.state]
            yield role, text


def damage(conversations: DataFrame) -> DataFrame:
    """Turns with seeded faults: dropped, emptied, cut off, repeated, or given to the user.

    A null is a space wherever it is read, in the key of the draw as in role and text. Columns of other
    names are not read.
    """
    word = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    key = F.concat(word("conv_id"), F.lit(":"), word("turn"))
    drawn = conversations.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), (F.crc32(key.cast("binary")) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", SENTENCE_ENDS, "")).otherwise(F.col("text"))
    times = F.when(F.col("fault") == 3, 2).otherwise(1)
    return (
        drawn.where("fault != 0")
        .select("conv_id", "turn", F.when(F.col("fault") == 4, ROLES[0]).otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), times)).alias("_copy"))
        .drop("_copy")
    )


def _same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    """Equal keys, nulls among them."""
    found = F.lit(True)
    for n in names:
        found = found & a[n].eqNullSafe(b[n])
    return found


def turns_in_order(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, place, code`` of every turn, written once; texts stay behind.

    Places rise with (conv_id, turn, role, text), nulls first. Ranges hold equal rows apart by a row number, so neither a long
    conversation nor many equal rows fill one task. Repeats are found from one row per repeated (role, text).
    """
    n = shuffle_partitions(turns.sparkSession)
    order = ["conv_id", "turn", "role", "text"]
    blank, cut = F.col("text").rlike(BLANK), F.col("text").rlike(CUT_OFF)
    initial = F.substring("role", 1, 1)
    ranged = turns.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(n, *order, "_row").sortWithinPartitions(*order)
    placed = stored(
        ranged.select(
            "conv_id", "turn", F.monotonically_increasing_id().alias("place"),
            F.md5(F.concat_ws("\0", F.length("role").cast("string"), "role", "text")).alias("said"),
            F.when(blank, 1).when(cut, 3).otherwise(0).alias("fault"),
            F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("initial"),
        ),
        "turns",
    )
    repeated = placed.groupBy("conv_id", "said").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    repeated = stored(repeated, "repeated")
    again = (F.col("first") < F.col("place")) & (F.col("fault") != 1)
    fault = F.when(again, 2).otherwise(F.col("fault"))
    joined = placed.join(repeated, _same(placed, repeated, "conv_id", "said"), "left")
    return stored(joined.select(placed["conv_id"], "turn", "place", (4 * fault + F.col("initial")).cast("tinyint").alias("code")), "codes")


def _mapped(df: DataFrame, make: Callable[[dict], list[dict]], schema: T.StructType) -> DataFrame:
    """Rows made from each row, in Arrow batches."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [out for row in batch.to_pylist() for out in make(row)]
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return df.mapInArrow(run, schema)


NODE = "place long, costs array<long>, ranks array<int>"


def _with_id(conv_type: T.DataType, fields: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", conv_type), *T.StructType.fromDDL(fields).fields])


def _step(node: dict) -> Step:
    return tuple(node["costs"]), tuple(node["ranks"])


def _grouped(nodes: DataFrame, by: Column) -> DataFrame:
    """``conv_id, group, nodes``: the nodes of each group in order. Groups are of bounded size."""
    return nodes.groupBy("conv_id", by.alias("group")).agg(F.array_sort(F.collect_list(F.struct("place", "costs", "ranks"))).alias("nodes"))


def spans(nodes: DataFrame, bits: int = PART_BITS - BLOCK_BITS, fan: int = FAN) -> DataFrame:
    """``conv_id, place, start, end`` of every node: the states between which the cheapest edits of its conversation
    lead through it (end null: to any good end).

    Where a conversation has more than ``fan`` nodes, groups of them, ``2 ** bits`` places each, are solved first.
    """
    kind = nodes.schema["conv_id"].dataType
    most = nodes.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    out = _with_id(kind, "place long, start int, end int")

    def through(conv_id, group: list[dict], start: int, end: int | None) -> list[dict]:
        states = crossings([_step(n) for n in group], start, end)
        ends = [*states[1:-1], end]
        return [{"conv_id": conv_id, "place": n["place"], "start": a, "end": b} for n, a, b in zip(group, states, ends)]

    if most <= fan:
        return _mapped(_grouped(nodes, F.lit(0)), lambda r: through(r["conv_id"], r["nodes"], START, None), out)
    groups = _grouped(nodes, F.shiftright("place", bits))

    def merged(r: dict) -> list[dict]:
        costs, ranks = combined([_step(n) for n in r["nodes"]])
        return [{"conv_id": r["conv_id"], "place": r["group"], "costs": costs, "ranks": ranks}]

    above = stored(_mapped(groups, merged, _with_id(kind, NODE)), "groups")
    solved = stored(spans(above, 12, fan), "spans")
    # A conversation's groups have its own id, so every row meets one other.
    both = groups.join(solved, groups["conv_id"].eqNullSafe(solved["conv_id"]) & (groups["group"] == solved["place"])).select(groups["conv_id"], "nodes", "start", "end")
    return _mapped(both, lambda r: through(r["conv_id"], r["nodes"], r["start"], r["end"]), out)


BLOCK = "place long, codes binary, costs array<long>, ranks array<int>"
EDITED = "place long, audit string, cost long, blank long, duplicate long, truncated long, illegal long, first int, last int"


def edited_blocks(codes: DataFrame, block_bits: int = BLOCK_BITS, fan: int = FAN) -> DataFrame:
    """One row per block: its edits and their cost, its faults, the wrong pairs inside it, its first and last initial."""
    kind = codes.schema["conv_id"].dataType
    lists = codes.groupBy("conv_id", F.shiftright("place", block_bits).alias("place")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("place").alias("at"), "code"))), lambda t: t["code"]).alias("codes")
    )

    def step_of(r: dict) -> list[dict]:
        found = bytes(r["codes"])
        costs, ranks = combined([turn_step(c) for c in found])
        return [{"conv_id": r["conv_id"], "place": r["place"], "codes": found, "costs": costs, "ranks": ranks}]

    blocks = stored(_mapped(lists, step_of, _with_id(kind, BLOCK)), "blocks")
    ways = spans(blocks.drop("codes"), PART_BITS - block_bits, fan)
    both = blocks.join(ways, _same(blocks, ways, "conv_id", "place")).select(blocks["conv_id"], blocks["place"], "codes", "start", "end")

    def solve(r: dict) -> list[dict]:
        found = r["codes"]
        cost, audit, _ = (short_edits if len(found) < 64 else cheapest_edits)(found, r["start"], r["end"])
        initials = [c % 4 for c in found]
        row = {"conv_id": r["conv_id"], "place": r["place"], "audit": audit, "cost": cost, "first": initials[0], "last": initials[-1]}
        row |= {name: sum(c // 4 == i for c in found) for i, name in enumerate(FAULTS) if i}
        return [row | {"illegal": sum(not fits(a, b) for a, b in zip(initials, initials[1:]))}]

    return _mapped(both, solve, _with_id(kind, EDITED))


def fits(before: int, after: int) -> bool:
    """Whether initials may follow each other: su, ua or au."""
    return (before, after) in ((0, 1), (1, 2), (2, 1))


def gaps_of(turns: DataFrame) -> DataFrame:
    """``conv_id, gaps``: numbers that a conversation skips between its first and last turn. Beyond a long: null."""
    wide = F.col("turn").cast("decimal(20,0)")
    per_turn = turns.groupBy("conv_id", "turn").agg(F.lit(1).alias("one"))
    gaps = F.expr("try_cast(coalesce(max(w) - min(w) + 1 - count(w), 0) as bigint)")
    return per_turn.select("conv_id", wide.alias("w")).groupBy("conv_id").agg(gaps.alias("gaps"))


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _streamed(turns: DataFrame, all_ids: DataFrame, block_bits: int, fan: int, finish: str) -> DataFrame:
    """Each conversation's facts, its edits and then its turns pass through one task in order, a batch at a time.

    ``finish`` says what comes out: "report" or "turns". Facts and edits are one row per conversation and
    block; of the turns a task holds one batch.
    """
    codes = turns_in_order(turns)
    kind = codes.schema["conv_id"].dataType
    facts = "step int, place long, turn long, role string, text string, gaps long, blank long, duplicate long, truncated long, illegal long, first int, last int, cost long"
    names = [f.name for f in _with_id(kind, facts).fields]

    def shaped(df: DataFrame, **given: Column) -> DataFrame:
        types = {"step": "int", "place": "long", "role": "string", "text": "string", "first": "int", "last": "int", "turn": turns.schema["turn"].dataType}
        return df.select(*[(given.get(n, F.lit(None))).cast(kind if n == "conv_id" else types.get(n, "long")).alias(n) for n in names])

    own = lambda df, *cols: {c: df[c] for c in cols}
    ids, gaps, blocks = all_ids.select("conv_id").distinct(), gaps_of(codes), edited_blocks(codes, block_bits, fan)
    rows = (
        shaped(ids, step=F.lit(0), **own(ids, "conv_id"))
        .unionByName(shaped(gaps, step=F.lit(0), **own(gaps, "conv_id", "gaps")))
        .unionByName(shaped(blocks, step=F.lit(1), text=blocks["audit"], **own(blocks, "conv_id", "place", *COUNTS[1:], "first", "last")))
        .unionByName(shaped(turns, step=F.lit(2), **own(turns, "conv_id", "turn", "role", "text")))
    )
    order = ("conv_id", "step", "place", "turn", "role", "text")
    dealt = rows.repartition("conv_id").sortWithinPartitions(*order)
    report = _with_id(kind, ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string")
    written = _with_id(kind, "number long, role string, text string")
    schema = report if finish == "report" else written

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, done, now, begun = to_arrow_schema(schema), [], None, False

        for batch in batches:
            for row in batch.to_pylist():
                if not begun or row["conv_id"] != now.conv_id:
                    if begun:
                        done += now.end()
                    now, begun = Conversation(row["conv_id"], finish == "report"), True
                done += now.take(row)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=arrow)
                done = []
        if begun:
            yield pa.RecordBatch.from_pylist(now.end(), schema=arrow)

    return dealt.mapInArrow(run, schema)


class Conversation:
    """What is known of a conversation while its rows pass by."""

    def __init__(self, conv_id, report: bool):
        self.conv_id, self.report = conv_id, report
        self.counts = dict.fromkeys(COUNTS, 0)
        self.audits, self.last, self.rewriter = [], None, None
        self.digest, self.number = hashlib.sha256(), 0

    def take(self, row: dict) -> list[dict]:
        if row["step"] == 0:
            if row["gaps"] is not None:
                self.counts["gaps"] = row["gaps"]
        elif row["step"] == 1:
            for name in COUNTS[1:]:
                self.counts[name] += row[name]
            if self.last is not None:
                self.counts["illegal"] += not fits(self.last, row["first"])
            self.last = row["last"]
            self.audits.append(row["text"])
        else:
            self._begin()
            return self._write(self.rewriter.turn(row["role"], row["text"]))
        return []

    def _begin(self) -> None:
        if self.rewriter is None:
            self.audits = ["".join(self.audits)]
            self.rewriter = Rewriter(self.audits[0])

    def _write(self, turns: Iterator[tuple[str, str]]) -> list[dict]:
        out = []
        for role, text in turns:
            if self.report:
                self.digest.update(f"{chr(10) if self.number else ''}{role}:{text}".encode())
            else:
                out.append({"conv_id": self.conv_id, "number": self.number, "role": role, "text": text})
            self.number += 1
        return out

    def end(self) -> list[dict]:
        self._begin()
        out = self._write(self.rewriter.inserted())
        if not self.report:
            return out
        return [{"conv_id": self.conv_id, **self.counts, "audit": self.audits[0], "repaired_sha256": self.digest.hexdigest()}]


def repair_report(turns: DataFrame, all_ids: DataFrame | None = None, block_bits: int = BLOCK_BITS, fan: int = FAN) -> DataFrame:
    """Per conversation: gaps, faults, wrong pairs, the cheapest edits with their cost, and the digest of the repaired text.

    ``turns`` has conv_id, turn, role and text, the latter two without nulls; a null conv_id is a conversation of its own, null turns come
    first, and rows of one turn go by role and text. ``all_ids`` may name more conversations: those without a
    row get zeros, no edits and the digest of an empty text. An empty table gives no rows. Other columns are not read.
    """
    return _streamed(turns, turns if all_ids is None else all_ids, block_bits, fan, "report")


def repaired_turns(turns: DataFrame, block_bits: int = BLOCK_BITS, fan: int = FAN) -> DataFrame:
    """The repaired conversations themselves: ``conv_id, number, role, text``, numbered from 0."""
    return _streamed(turns, turns, block_bits, fan, "turns")
