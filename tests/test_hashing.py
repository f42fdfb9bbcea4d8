import itertools

import numpy as np
import pandas as pd
import pytest

from actiscope.operators import hashing, neighbors

KEYS = ("query_id", "base_id", "label", "distance2", "rank")


@pytest.fixture(scope="module")
def clouds(spark):
    """4,000 rows in 60 clouds of 24 values, with 300 equal rows and one without a vector."""
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(60, 24)) * 3
    rows = centres[draw.integers(60, size=4000)] + draw.normal(size=(4000, 24))
    rows[:300] = rows[0]
    data = [(i, int(i % 5), [float(x) for x in v]) for i, v in enumerate(rows)] + [(9999, 0, None)]
    df = spark.createDataFrame(data, "sample_id long, label int, hidden_state_vector array<double>").repartition(4).cache()
    yield df.where("sample_id % 20 = 0"), df.where("sample_id % 20 != 0")
    df.unpersist()


def rows_of(df):
    return sorted(tuple(r[k] for k in KEYS) for r in df.collect())


def test_flips_come_in_order_of_their_margins():
    draw = np.random.default_rng(0)
    for bits in (1, 3, 6):
        margins = draw.random((2, 5, bits))
        got = hashing.nearest_flips(margins, 9)
        for t, i in itertools.product(range(2), range(5)):
            cost = lambda m: sum(margins[t, i, b] ** 2 for b in range(bits) if m >> b & 1)
            want = sorted(map(cost, range(1 << bits)))[:9]
            assert np.allclose([cost(m) for m in got[t, i]], want) and got[t, i, 0] == 0 and len(set(got[t, i].tolist())) == len(want)


def test_recall_is_what_was_asked_for(clouds):
    queries, base = clouds
    tables = hashing.fit_tables(base, recall=0.95, bucket_rows=60)
    assert tables.recall >= 0.95 and tables.probes * len(tables.directions) < 1 << tables.bits
    exact = neighbors.nearest_neighbors(queries, base).cache()
    found = hashing.hashed_neighbors(queries, base, tables).cache()
    assert sorted(found.columns) == sorted(exact.columns)
    assert hashing.measured_recall(found, exact) >= 0.9
    best = {(r.query_id, r.base_id): r.distance2 for r in exact.collect()}
    assert all(best.get((r.query_id, r.base_id), r.distance2) == r.distance2 for r in found.collect())


def test_all_buckets_are_exact_and_small_blocks_change_nothing(clouds):
    queries, base = clouds
    tables = hashing.fit_tables(base, bucket_rows=300, tables=2, probe_rows=20)
    every = tables.first(1, 1 << tables.bits, None)
    want = rows_of(neighbors.nearest_neighbors(queries, base))
    assert rows_of(hashing.hashed_neighbors(queries, base, every, block_bytes=8 * 24 * 90)) == want
    assert rows_of(hashing.find_neighbors(queries, base)) == want


def test_a_large_base_takes_the_tables(clouds):
    queries, base = clouds
    found = hashing.find_neighbors(queries, base, exact_rows=100)
    assert found.where("rank = 1").count() == queries.where("hidden_state_vector is not null").count()


def test_odd_bases(spark):
    schema = "sample_id long, label int, hidden_state_vector array<double>"
    one = spark.createDataFrame([(1, 0, [1.0, 2.0])], schema)
    tables = hashing.fit_tables(one)
    assert [tuple(r) for r in hashing.hashed_neighbors(one, one, tables).select(*KEYS).collect()] == [(1, 1, 0, 0.0, 1)]
    same = spark.createDataFrame([(i, 0, [1.0, 1.0]) for i in range(50)], schema)
    assert hashing.hashed_neighbors(same, same, hashing.fit_tables(same, bucket_rows=5)).count() == 250
    with pytest.raises(ValueError):
        hashing.fit_tables(one.where("false"))


def test_a_query_that_looks_into_every_bucket_travels_once_per_block(clouds, monkeypatch):
    queries, base = clouds
    tables = hashing.fit_tables(base, bucket_rows=60, probe_rows=20)
    assert tables.bits >= 6
    met = []
    meet = neighbors.nearest_in_pairs
    monkeypatch.setattr(neighbors, "nearest_in_pairs", lambda q, b, *rest: met.append((q.count(), b.count())) or meet(q, b, *rest))
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 1000)
    every = tables.first(1, 1 << tables.bits, None)
    assert rows_of(hashing.hashed_neighbors(queries, base, every)) == rows_of(neighbors.nearest_neighbors(queries, base))
    # 3,800 base rows and 200 queries: some eight groups of buckets, not one of them for each of 64 buckets.
    assert met[0][0] <= 16 * 200 and met[0][1] == 3800


def test_buckets_are_put_in_order_a_few_vectors_at_a_time(clouds, monkeypatch):
    queries, base = clouds
    tables = hashing.fit_tables(base, bucket_rows=60, tables=2, probe_rows=20).first(2, 9, None)
    want = rows_of(hashing.hashed_neighbors(queries, base, tables))
    order = hashing.HashTables.looked_into

    def few(self, rows, *rest):
        assert len(rows) <= 7
        return order(self, rows, *rest)

    monkeypatch.setattr(hashing, "PROBE_CELLS", 2 * 18 * 7)
    monkeypatch.setattr(hashing.HashTables, "looked_into", few)
    df = hashing._vectors(queries, "sample_id", "hidden_state_vector")
    assert hashing._in_buckets(df, tables, True).groupBy("id").count().where("count != 18").isEmpty()
    assert rows_of(hashing.hashed_neighbors(queries, base, tables)) == want


def test_a_query_that_looks_into_some_buckets_travels_once_per_group_of_them(clouds, monkeypatch):
    queries, base = clouds
    tables = hashing.fit_tables(base, bucket_rows=60, tables=2, probe_rows=20).first(2, 40, None)
    assert tables.bits == 6 and len(tables.directions) == 2
    vectors = lambda df, *more: hashing._vectors(df, "sample_id", "hidden_state_vector", *more)
    asked = {(r.id, r.bucket): r.vec for r in hashing._in_buckets(vectors(queries), tables, True).collect()}
    lies = {}
    for r in hashing._in_buckets(vectors(base, "label"), tables, False, "label").collect():
        lies.setdefault(r.bucket, []).append((r.id, r.label, r.vec))
    near = {}
    for (i, bucket), v in asked.items():
        for j, label, w in lies.get(bucket, ()):
            near.setdefault(i, {})[j] = (round(((np.array(v) - np.array(w)) ** 2).sum(), 9), j, label)
    want = sorted((i, j, label, d, at) for i, all_of in near.items() for at, (d, j, label) in enumerate(sorted(all_of.values())[:5], 1))
    met = []
    meet = neighbors.nearest_in_pairs
    monkeypatch.setattr(neighbors, "nearest_in_pairs", lambda q, b, *rest: met.append((q.count(), b.count())) or meet(q, b, *rest))
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 1000)
    got = rows_of(hashing.hashed_neighbors(queries, base, tables))
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want], atol=1e-8)
    # 80 of 128 buckets in the two tables: eight groups of 16, of which one or the other is cut in two, and not 80 copies.
    assert met[0][0] <= 16 * 200 and met[0][1] == 2 * 3800


def test_neighbours_are_exact_however_large_the_base(spark, monkeypatch):
    def none(*rest):
        raise AssertionError("tables were fitted")

    monkeypatch.setattr(hashing, "fit_tables", none)
    draw = np.random.default_rng(8)
    b, q = draw.normal(size=(200_500, 2)).round(3), draw.normal(size=(6, 2)).round(3)
    frame = lambda rows: spark.createDataFrame(pd.DataFrame({"sample_id": range(len(rows)), "label": 0, "hidden_state_vector": rows.tolist()})).repartition(4)
    want = []
    for i, x in enumerate(q):
        d = ((b - x) ** 2).sum(1).round(9)
        want += [(i, int(j), 0, float(d[j]), at) for at, j in enumerate(np.lexsort((np.arange(len(b)), d))[:5], 1)]
    assert rows_of(hashing.find_neighbors(frame(q), frame(b))) == sorted(want)
