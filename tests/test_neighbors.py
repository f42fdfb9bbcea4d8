import numpy as np
import pytest

from actiscope.operators import neighbors


def brute(q, b, labels, k):
    out = {}
    for i, x in enumerate(q):
        d = ((b - x) ** 2).sum(1).round(9)
        out[i] = [(int(j), float(d[j]), labels[j]) for j in np.lexsort((np.arange(len(b)), d))[:k]]
    return out


def frames(spark, q, b, labels):
    kind = "id int, v array<double>"
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], kind).repartition(3)
    base = spark.createDataFrame(
        [(i, x.tolist(), int(y)) for i, (x, y) in enumerate(zip(b, labels))], kind + ", y int"
    ).repartition(4)
    return queries, base


@pytest.mark.parametrize("block_bytes,cells", [(1 << 20, 4_000_000), (25 * 32, 4_000_000), (7 * 32, 50)])
def test_equals_brute_force(spark, monkeypatch, block_bytes, cells):
    monkeypatch.setattr(neighbors, "PRODUCT_CELLS", cells)
    rng = np.random.default_rng(block_bytes)
    centres = rng.normal(size=(6, 4)) * 5
    b = (centres[rng.integers(0, 6, 400)] + rng.normal(size=(400, 4))).round(2)
    b[100:240] = b[0]  # a third of the rows are copies
    q = np.vstack(((centres[rng.integers(0, 6, 60)] + rng.normal(size=(60, 4))).round(2), b[:3]))
    labels = rng.integers(0, 3, 400)
    queries, base = frames(spark, q, b, labels)
    near = neighbors.nearest_neighbors(queries, base, 5, "id", "v", "y", block_bytes=block_bytes)
    got = {}
    for r in sorted(near.collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.base_id, r.distance2, r.label))
    assert got == brute(q, b, labels, 5)


def test_fewer_base_rows_than_k(spark):
    b = np.arange(6.0).reshape(3, 2)
    queries, base = frames(spark, b[:1], b, [0, 1, 1])
    votes = neighbors.knn_classify(queries, base, 5, id_col="id", vec="v", label="y").collect()
    assert [(r.query_id, r.y_pred) for r in votes] == [(0, 1)]


def test_vote_tie_goes_to_the_smaller_label(spark):
    rows = [(1, 2), (1, 2), (1, 0), (1, 0), (1, 1), (2, 3)]
    votes = neighbors.vote(spark.createDataFrame(rows, "query_id int, label int"))
    assert {r.query_id: r.y_pred for r in votes.collect()} == {1: 0, 2: 3}


def test_short_vectors_meet_in_blocks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(1)
    q, b, labels = rng.normal(size=(250, 2)), rng.normal(size=(400, 2)), rng.integers(0, 3, 400)
    seen = []
    meet = neighbors.nearest_in_pairs

    def watched(q, b, key, pairs, *rest):
        found = meet(q, b, key, pairs, *rest)
        seen.append((pairs, found.rdd.getNumPartitions(), b.groupBy(*key).count().agg({"count": "max"}).first()[0]))
        return found

    monkeypatch.setattr(neighbors, "nearest_in_pairs", watched)
    near = neighbors.nearest_neighbors(*frames(spark, q, b, labels), 5, "id", "v", "y")
    got = {}
    for r in sorted(near.collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.base_id, r.distance2, r.label))
    assert got == brute(q, b, labels, 5)
    pairs, tasks, largest = seen[0]
    assert pairs == 12 and tasks >= pairs and largest < 150


def test_equal_distances_go_to_the_smaller_ids_over_slices(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "FIRST_ROWS", 7)
    monkeypatch.setattr(neighbors, "SLICE_ROWS", 30)
    rng = np.random.default_rng(3)
    b, q = rng.integers(0, 3, (500, 2)) + rng.choice([0, 3e-5, 1e-6], (500, 2)), rng.integers(0, 3, (40, 2)) * 1.0
    labels = rng.integers(0, 3, 500)
    near = neighbors.nearest_neighbors(*frames(spark, q, b, labels), 5, "id", "v", "y")
    got = {}
    for r in sorted(near.collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.base_id, r.distance2, r.label))
    assert got == brute(q, b, labels, 5)
