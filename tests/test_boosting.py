import itertools

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from actiscope.operators import boosting
from actiscope.operators.boosting import BoostedModel


@pytest.fixture(scope="module")
def rows(spark):
    """600 rows of three classes told by two of five values, one of them with few distinct values."""
    draw = np.random.default_rng(2)
    x = draw.normal(size=(600, 5)).round(3)
    x[:, 3] = draw.integers(3, size=600)
    y = np.where(x[:, 0] > 0.3, 2, np.where(x[:, 3] == 1, 1, 0))
    data = [(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "sample_id int, v array<double>, label int").withColumn("features", array_to_vector("v")).cache()
    yield df, x, y
    df.unpersist()


def by_hand(x, y, k, rounds, leaves, rate, min_rows, min_hessian, edges):
    """Scores after some rounds, each leaf cut by trying every column and edge; leaves are cut in the same order."""
    start = np.log(np.bincount(y, minlength=k) / len(y))
    scores = np.tile(start, (len(y), 1))
    for _ in range(rounds):
        p = np.exp(scores) / np.exp(scores).sum(1, keepdims=True)
        for c in range(k):
            g, h = p[:, c] - (y == c), k / (k - 1) * p[:, c] * (1 - p[:, c])
            held, cuts, new, made = {0: np.arange(len(y))}, {}, [0], 1
            while new:
                for node in new:
                    at, best = held[node], None
                    if len(held) >= leaves:
                        continue
                    for f, e in itertools.chain.from_iterable(zip(itertools.repeat(f), edges[f]) for f in range(x.shape[1])):
                        left = x[at, f] <= e
                        parts = [(g[m].sum(), h[m].sum(), len(m)) for m in (at[left], at[~left])]
                        if min(p[2] for p in parts) < min_rows or min(p[1] for p in parts) < min_hessian:
                            continue
                        gain = sum(a * a / b for a, b, _ in parts) - g[at].sum() ** 2 / h[at].sum()
                        if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                            best = (gain, f, e)
                    if best:
                        cuts[node] = best
                order, new = sorted(cuts, key=lambda n: (-cuts[n][0], n)), []
                for node in order[: max(1, -(-(leaves - len(held)) // 2))]:
                    if len(held) >= leaves:
                        break
                    _, f, e = cuts.pop(node)
                    at = held.pop(node)
                    held[made], held[made + 1] = at[x[at, f] <= e], at[x[at, f] > e]
                    new += [made, made + 1]
                    made += 2
            if len(held) > 1:
                for at in held.values():
                    scores[at, c] -= rate * g[at].sum() / h[at].sum()
    return scores


def test_against_trying_every_cut(rows):
    df, x, y = rows
    model = boosting.fit_boosted(df, rounds=3, leaves=6, tasks=1)
    want = by_hand(x, y, 3, 3, 6, 0.1, 20, 1e-3, model.edges)
    got = boosting.scores_of(boosting.binned(x, model.edges), model.rounds, np.tile(model.start, (len(x), 1)))
    assert np.allclose(got, want)
    assert 4 <= max(t.feature.count(-1) for trees in model.rounds for t in trees) <= 6


def test_edges_lie_in_the_widest_gaps():
    draw = np.random.default_rng(3)
    groups = np.concatenate([draw.normal(size=n) * 0.01 + at for n, at in ((301, 0.0), (77, 5.0), (650, 9.0))])
    (edges,) = boosting.bin_edges(groups[:, None], 16)
    assert len(edges) == 15 and (np.diff(edges) > 0).all()
    assert sum(1 < e < 4.5 for e in edges) == 1 and sum(5.5 < e < 8.5 for e in edges) == 1
    counts = np.bincount(boosting.binned(groups[:, None], [edges])[:, 0])
    assert counts.max() <= 2 * -(-len(groups) // 15) and counts.sum() == len(groups)
    (few,) = boosting.bin_edges(np.array([[1.0], [2.0], [2.0], [4.0], [np.inf]]), 16)
    assert few.tolist() == [1.5, 3.0]


def test_tasks_and_passes_change_nothing(rows, monkeypatch):
    df, x, _ = rows
    one = boosting.fit_boosted(df, rounds=12, leaves=8, tasks=1)
    monkeypatch.setattr(boosting, "SUM_BYTES", 2 * 5 * boosting.BINS * 24)
    monkeypatch.setattr(boosting, "GROUP", 2)
    monkeypatch.setattr(boosting, "BLOCK_BYTES", 500)
    many = boosting.fit_boosted(df, rounds=12, leaves=8, tasks=3)
    scores = [boosting.scores_of(boosting.binned(x, m.edges), m.rounds, np.tile(m.start, (len(x), 1))) for m in (one, many)]
    assert np.allclose(*scores)


def test_learns_and_is_kept(rows, spark, tmp_path):
    df, _, y = rows
    train, test = df.where("sample_id % 3 != 0"), df.where("sample_id % 3 = 0")
    model = boosting.fit_boosted(train, rounds=40)
    scored = model.transform(test)
    right = scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0]
    assert right > 0.97 and max(t.feature.count(-1) for trees in model.rounds for t in trees) > 3
    model.save(str(tmp_path / "m"))
    again = BoostedModel.load(spark, str(tmp_path / "m")).transform(test)
    assert [r.probability for r in scored.orderBy("sample_id").collect()] == [r.probability for r in again.orderBy("sample_id").collect()]


def test_odd_rows(spark):
    schema = "features array<double>, label int"
    make = lambda data: spark.createDataFrame(data, schema).withColumn("features", array_to_vector("features"))
    one = boosting.fit_boosted(make([([1.0], 0)] * 50))
    assert not one.rounds and one.transform(make([([5.0], 0)])).first().prediction == 0.0
    gap = boosting.fit_boosted(make([([float(i)], 3 * (i > 30)) for i in range(60)] + [([float("nan")], 3)]), rounds=30)
    found = gap.transform(make([([2.0], 0), ([50.0], 3), ([float("nan")], 3)]))
    assert [r.prediction for r in found.collect()] == [0.0, 3.0, 3.0]
    with pytest.raises(ValueError):
        boosting.fit_boosted(make([]))


def test_equal_rows_are_held_once_and_many_rows_are_no_single_task(spark, monkeypatch):
    draw = np.random.default_rng(5)
    x = np.round(draw.normal(size=(4000, 2)) * 2) / 2
    y = (x[:, 0] + x[:, 1] > 0).astype(int)
    schema = "features array<double>, label int"
    df = spark.createDataFrame([([float(v) for v in r], int(c)) for r, c in zip(x, y)], schema).withColumn("features", array_to_vector("features"))
    grown = []
    one_task = boosting._grown_in_task

    def watched(blocks, d, *rest):
        grown.append(sum(len(r.bins) // d for r in blocks.collect()))
        return one_task(blocks, d, *rest)

    monkeypatch.setattr(boosting, "_grown_in_task", watched)
    model = boosting.fit_boosted(df, rounds=3, leaves=6)
    want = by_hand(x, y, 2, 3, 6, 0.1, 20, 1e-3, model.edges)
    scores = lambda m: boosting.scores_of(boosting.binned(x, m.edges), m.rounds, np.tile(m.start, (len(x), 1)))
    assert np.allclose(scores(model), want) and grown == [len(np.unique(x, axis=0))]
    monkeypatch.setattr(boosting, "GROWN_BYTES", 1000)
    assert np.allclose(scores(boosting.fit_boosted(df, rounds=3, leaves=6)), want) and len(grown) == 1


def test_edges_come_from_all_rows_however_many(spark, monkeypatch):
    draw = np.random.default_rng(6)
    rows = np.column_stack((draw.normal(size=5000), draw.integers(0, 9, 5000), draw.integers(0, 200, 5000), draw.normal(size=5000).round(1), np.full(5000, np.nan)))
    rows[7, 0] = np.inf
    df = spark.createDataFrame([(int(i % 2), r.tolist()) for i, r in enumerate(rows)], "label int, v array<double>").repartition(5)
    df = df.select("label", array_to_vector("v").alias("features"))
    monkeypatch.setattr(boosting, "EDGE_BYTES", 8 * 5 * 500)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        model = boosting.fit_boosted(df, rounds=1)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    for found, want in zip(model.edges, boosting.bin_edges(rows), strict=True):
        assert found.tolist() == want.tolist()
