import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from actiscope.llm import common, repair
from actiscope.llm import queries as _  # noqa: F401

SPACE = " \t\n\x0b\x0c\r"
CODES = st.binary(max_size=60).map(lambda b: bytes(c % 16 for c in b))


def moves(code, state):
    """(letter, cost, next state) that may take a turn, by the rules alone; states are s, u, a or empty."""
    fault, role = divmod(code, 4)
    role = "suax"[role]
    yield "D", 2, state
    if fault in (1, 2):
        return
    extra = 5 if fault == 3 else 0
    wanted = "a" if state == "u" else "u"
    if role == wanted or (role == "s" and state == ""):
        yield "K", extra, role
    yield "R", extra + 1, wanted


def say(state):
    return "a" if state == "u" else "u"


def plain(codes):
    """The cheapest and then first edits, by whole strings for every state, without any division."""
    def with_inserts(found):
        for _ in range(2):
            for state, (cost, text) in list(found.items()):
                new = (cost + 5, text + "I")
                found[say(state)] = min(found.get(say(state), new), new)
        return found

    found = {"": (0, "")}
    for code in codes:
        after = {}
        for state, (cost, text) in found.items():
            for n in range(3):
                for letter, more, then in moves(code, state):
                    new = (cost + 5 * n + more, text + "I" * n + letter)
                    after[then] = min(after.get(then, new), new)
                state = say(state)
        found = after
    ends = with_inserts(dict(found))
    return min(ends[s] for s in ("", "a") if s in ends)


def all_ways(codes, state="", most=3):
    """Every sequence of edits with at most ``most`` inserts before a turn or the end."""
    for n in range(most + 1):
        now = state
        for _ in range(n):
            now = say(now)
        if not codes:
            if now in ("", "a"):
                yield 5 * n, "I" * n
            continue
        for letter, cost, then in moves(codes[0], now):
            for more, text in all_ways(codes[1:], then, most):
                yield 5 * n + cost + more, "I" * n + letter + text


@pytest.mark.parametrize("codes", [b""] + [bytes(c) for n in (1, 2) for c in itertools.product(range(16), repeat=n)])
def test_against_every_way(codes):
    want = min(all_ways(codes))
    assert repair.cheapest_edits(codes)[:2] == want == plain(codes)


def test_against_every_way_of_longer_ones():
    draw = random.Random(3)
    for _ in range(60):
        codes = bytes(draw.randrange(16) for _ in range(draw.choice((3, 4))))
        assert repair.cheapest_edits(codes)[:2] == min(all_ways(codes, most=2)) == plain(codes)


@given(CODES, st.integers(1, 9))
@settings(max_examples=300, deadline=None)
def test_division_changes_nothing(codes, size):
    cost, audit = plain(codes)
    assert repair.cheapest_edits(codes)[:2] == (cost, audit)
    blocks = [codes[i : i + size] for i in range(0, len(codes), size)]
    steps = [repair.combined([repair.turn_step(c) for c in b]) for b in blocks]
    if not blocks:
        return
    states = repair.crossings(steps, 0, None)
    parts = [repair.cheapest_edits(b, s, e) for b, s, e in zip(blocks, states, [*states[1:-1], None])]
    assert sum(p[0] for p in parts) == cost and "".join(p[1] for p in parts) == audit


def by_hand(rows, all_ids):
    """The report of damaged rows (conv_id, turn, role, text), one conversation after the other."""
    held = defaultdict(list)
    for r in rows:
        held[r[0]].append(r[1:])
    out = {}
    for conv in all_ids:
        turns = sorted(held[conv], key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        codes, seen, counts = [], set(), [0, 0, 0, 0]
        for _, role, text in turns:
            bare = text.rstrip(SPACE)
            fault = 1 if not text.strip(SPACE) else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
            seen.add((role, text))
            counts[fault] += 1
            codes.append(4 * fault + "sua".find(role[:1] or "?") % 4)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        numbers = [t[0] for t in turns if t[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        cost, audit = plain(codes)
        written, state, left = [], "", iter(turns)
        for letter in audit:
            name = {"u": "user", "a": "assistant"}[say(state)]
            if letter == "I":
                written.append(f"{name}:")
                state = name[0]
                continue
            _, role, text = next(left)
            if letter == "R":
                role = name
            if letter != "D":
                written.append(f"{role}:{text}")
                state = role[0]
        assert state in ("", "a")
        digest = hashlib.sha256("\n".join(written).encode()).hexdigest()
        out[conv] = (gaps, counts[1], counts[2], counts[3], illegal, cost, audit, digest), written
    return out


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = (" " if role is None else role), (" " if text is None else text)
        fault = zlib.crc32(key.encode()) % 20
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if fault == 3 else 1)
    return out


def report(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def test_on_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {k: v[0] for k, v in by_hand(damaged(rows), {r[0] for r in rows}).items()}
    df = common.QUERIES["op11_hirschberg_repair"](spark, sf_dir)
    assert df.count() == len(want) and report(df) == want


SCHEMA = "conv_id long, turn long, role string, text string, place long, code int, audit string, step string"


def odd_rows():
    draw = random.Random(5)
    texts = ["Yes.", "no", "", " ", "Well!\n", "Why?", "cut", "\x85", None, "a. ", "漢字。"]
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    rows = [(draw.choice([None, 1, 2, 3]), draw.choice([None, *range(12)]), draw.choice(roles), draw.choice(texts)) for _ in range(150)]
    rows += [(4, None, "user", "Hi.")] * 7 + [(5, 2**62, "user", "Far."), (5, -(2**62), "assistant", "Apart.")]
    rows += [(6, i, ["user", "assistant"][i % 2], f"Turn {i}." if i % 7 else "same") for i in range(700)] + [(6, 50, "user", "tie")] * 30
    return rows


@pytest.mark.parametrize("bits, fan", [(12, 4096), (3, 4)])
def test_odd_conversations(spark, bits, fan):
    rows = odd_rows()
    table = spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], SCHEMA).repartition(5)
    found = damaged(rows)
    want = by_hand(found, {r[0] for r in rows})
    got = report(repair.repair_report(repair.damage(table), table, bits, fan))
    assert got == {k: v[0] for k, v in want.items()}
    if fan == 4:
        written = defaultdict(list)
        for r in sorted(repair.repaired_turns(repair.damage(table), bits, fan).collect(), key=lambda r: r.number):
            assert r.number == len(written[r.conv_id])
            written[r.conv_id].append(f"{r.role}:{r.text}")
        assert {k: v for k, v in written.items() if v} == {k: v[1] for k, v in want.items() if v[1]}


def test_empty_table_and_conversations_without_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.repair_report(repair.damage(none), none).count() == 0
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(dropped, 0, "user", "Hi.", 0, 0, "", "")], SCHEMA)
    (row,) = repair.repair_report(repair.damage(one), one).collect()
    assert (row.cost, row.audit, row.gaps, row.repaired_sha256) == (0, "", 0, hashlib.sha256(b"").hexdigest())
