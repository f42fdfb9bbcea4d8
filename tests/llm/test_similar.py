import random
import re
from collections import defaultdict

import numpy as np
import pytest

from actiscope.llm import similar
from actiscope.llm.graph import components

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, k, percent):
    """(set size, smallest id of the component) of each row, from all pairs that share a shingle."""
    sets = []
    for _, text in rows:
        words = [w.translate(LOWER) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set())
    having, both = defaultdict(list), defaultdict(int)
    for i, s in enumerate(sets):
        for x in s:
            for j in having[x]:
                both[j, i] += 1
            having[x].append(i)
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, j), n in both.items():
        if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
            root[max(top(i), top(j))] = min(top(i), top(j))
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)].append(doc)
    return sorted(((doc, len(sets[i]), min(least[top(i)], default=None)) for i, (doc, _) in enumerate(rows)), key=repr)


def found(docs, rule):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in similar.classes_of(docs, rule).collect()), key=repr)


def graded(seed):
    draw = random.Random(seed)
    base = [[f"w{draw.randint(0, 5000)}" for _ in range(draw.choice([3, 8, 20, 60, 200]))] for _ in range(25)]
    rows = []
    for i in range(300):
        words = list(draw.choice(base))
        for _ in range(draw.randint(0, max(1, len(words) // 20))):
            words[draw.randrange(len(words))] = f"x{draw.randint(0, 50)}"
        rows.append((i, " ".join(words[: draw.randint(1, len(words))] if draw.random() < 0.3 else words)))
    return rows


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_graded_copies(make_docs, k, percent):
    rows = graded(k)
    assert found(make_docs(rows), similar.Rule(k, percent)) == brute(rows, k, percent)


def test_small_cells_and_steps(make_docs, monkeypatch):
    monkeypatch.setattr(similar, "GROUP_SETS", 16)
    monkeypatch.setattr(similar, "PAIR_WORDS", 2_000)
    rows = graded(9)
    assert found(make_docs(rows), similar.Rule(4, 85)) == brute(rows, 4, 85)


def test_odd_documents(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    rule = similar.Rule()
    assert found(odd_docs, rule) == brute(rows, 5, 80)
    assert similar.classes_of(no_docs).count() == 0
    kept = similar.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 2, 3, 4, 6, 8, 9, 12, None], key=repr)


def test_tree_loses_no_pair():
    draw = np.random.default_rng(0)
    pool = draw.integers(0, 1 << 63, 4000).astype(np.uint64)
    sets = []
    for _ in range(120):
        near = sets[draw.integers(len(sets))] if len(sets) and draw.random() < 0.6 else pool[draw.integers(0, 4000, draw.integers(1, 90))]
        keep = near[draw.random(len(near)) < 0.95]
        sets.append(np.unique(np.append(keep, pool[draw.integers(0, 4000, draw.integers(0, 3))])))
    sets = sorted((s for s in sets if len(s)), key=len)
    rule = similar.Rule(4, 85)
    tree = similar.Tree(np.array([len(s) for s in sets]), [similar.bitmap(s) for s in sets], np.arange(len(sets)))
    seen = {(int(i), int(j)) for a, b in tree.pairs(rule) for i, j in zip(a, b)}
    links = {(i, j) for j in range(len(sets)) for i in range(j) if rule.linked(similar.overlap(sets[i], sets[j]), len(sets[i]), len(sets[j]))}
    assert links and links <= seen and len(seen) < len(sets) * (len(sets) - 1) / 4


def test_components(spark):
    draw = random.Random(5)
    links = [(draw.randint(0, 80), draw.randint(0, 80)) for _ in range(45)] + [(i, i + 1) for i in range(200, 260)]
    root = {n: n for pair in links for n in pair}
    for _ in range(100):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {n: r for n, r in root.items() if n in got} and all(r == n for n, r in root.items() if n not in got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_on_table(spark, sf_dir):
    from actiscope.llm.queries import op6

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op6(spark, sf_dir).collect()), key=repr) == brute(rows, 4, 85)


def test_row_numbers_are_written(make_docs, monkeypatch):
    from actiscope.llm import sharding

    written, plain = {}, similar.stored
    for module in (similar, sharding):
        monkeypatch.setattr(module, "stored", lambda df, purpose: written.setdefault(purpose, df.columns) and plain(df, purpose))
    docs = make_docs([(1, "a b c d e f"), (2, "a b c d e f")])
    assert similar.classes_of(docs).count() == sharding.shards(docs).count() == 2
    assert "row" in written["rows"] and "row" in written["sizes"]


def test_one_row_of_each_component_stays(make_docs):
    t, u, v, w = (" ".join(f"{c}{i}" for i in range(12)) for c in "tuvw")
    docs = make_docs([(3, t), (5, t), (5, u), (1, v), (1, v), (None, v), (None, w), (None, w), (9, None), (9, None)])
    kept = sorted(((r.doc_id, r.text) for r in similar.one_of_each(docs).collect()), key=repr)
    assert kept == sorted([(3, t), (5, u), (1, v), (None, w), (9, None), (9, None)], key=repr)


def test_passing_tables_are_deleted(spark, make_docs):
    """Only what the kept documents are read from stays in the work folder."""
    import os

    from actiscope.session import work_root

    root = work_root(spark).removeprefix("file://")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    docs = make_docs([(i, f"one two three four five six seven eight {i % 3}") for i in range(9)])
    kept = similar.one_of_each(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2]
    assert sorted(f.rsplit("-", 1)[0] for f in set(os.listdir(root)) - before) == ["copies", "numbered"]
