import hashlib
import math
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st

from actiscope.operators import sampling


def h(seed, i):
    return hashlib.md5(f"{seed}|{i}".encode()).hexdigest()


def brute_split(rows, val, test, seed):
    counts = Counter(y for _, y in rows)
    quotas = sampling.split_quotas(dict(sorted(counts.items())), val, test)
    out = {}
    for y in counts:
        ordered = sorted((i for i, c in rows if c == y), key=lambda i: (h(seed, i), i))
        n_test, n_val = quotas[y]
        for place, i in enumerate(ordered):
            out[i] = "test" if place < n_test else "val" if place < n_test + n_val else "train"
    return out


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the rows have one class."""
    rows = [(i, "hot" if i % 3 else "cold" if i % 2 else "rare") for i in range(5000)] + [(9000, "single")]
    return rows, spark.createDataFrame(rows, "id bigint, y string").repartition(7)


@given(
    st.dictionaries(st.integers(0, 20), st.integers(1, 500), min_size=1, max_size=8),
    st.floats(0, 1),
)
def test_quotas_share_out_exactly(counts, share):
    size = math.floor(share * sum(counts.values()))
    quotas = sampling.proportional_quotas(counts, size)
    assert sum(quotas.values()) == size
    total = sum(counts.values())
    for y, n in counts.items():
        assert abs(quotas[y] - size * n / total) < 1
        assert 0 <= quotas[y] <= n


@pytest.mark.parametrize("rows_per_prefix", [50_000, 20, 1])
def test_split_equals_sorting(skewed, monkeypatch, rows_per_prefix):
    monkeypatch.setattr(sampling, "ROWS_PER_PREFIX", rows_per_prefix)
    rows, df = skewed
    got = {r.id: r.split for r in sampling.stratified_split(df, "id", "y", 0.15, 0.2, seed=5).collect()}
    assert got == brute_split(rows, 0.15, 0.2, 5)


def test_split_moves_no_rows(skewed, spark, tmp_path):
    skewed[1].write.parquet(str(tmp_path / "rows"))
    split = sampling.stratified_split(spark.read.parquet(str(tmp_path / "rows")), "id", "y")
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("n", [0, 1, 700, 4999, 5001, 10_000])
def test_sample_sizes(skewed, n):
    rows, df = skewed
    counts = Counter(y for _, y in rows)
    got = Counter(r.y for r in sampling.stratified_sample(df, "id", "y", n).collect())
    if n >= len(rows):
        assert got == counts
    else:
        assert got == Counter({y: round(n / len(rows) * c) for y, c in counts.items() if round(n / len(rows) * c)})


def test_copies_of_an_id_stay_together(spark):
    rows = [(1, "a")] * 400 + [(i, "a") for i in range(2, 800)]
    split = sampling.stratified_split(spark.createDataFrame(rows, "id int, y string"), "id", "y").collect()
    assert len(split) == len(rows)
    assert len({r.split for r in split if r.id == 1}) == 1


def test_null_class_is_an_error(spark):
    with pytest.raises(ValueError):
        sampling.class_counts(spark.createDataFrame([(None,)], "y string"), "y")


def test_group_split_keeps_groups_whole(spark):
    rows = [(i, 0 if i % 3 == 0 else i % 50) for i in range(3000)]  # group 0 holds over a third
    got = sampling.group_split(spark.createDataFrame(rows, "id int, g int"), "g", 0.2).collect()
    assert len(got) == 3000
    sides = {}
    for r in got:
        sides.setdefault(r.g, set()).add(r.split)
    assert all(len(s) == 1 for s in sides.values())
    assert sum(s == {"test"} for s in sides.values()) == math.ceil(0.2 * 50)


@pytest.mark.parametrize("rows_per_prefix", [50_000, 20])
def test_shuffle_rank(skewed, monkeypatch, rows_per_prefix):
    monkeypatch.setattr(sampling, "ROWS_PER_PREFIX", rows_per_prefix)
    rows, df = skewed
    got = {r.shuffle_rank: r.id for r in sampling.shuffle_rows(df, "id", seed=1).collect()}
    ordered = sorted((i for i, _ in rows), key=lambda i: (h(1, i), i))
    assert [got[k] for k in range(1, len(rows) + 1)] == ordered
