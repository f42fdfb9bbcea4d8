import numpy as np
import pytest

from actiscope.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, v string, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, "v", "s") for i, v in rows], SCHEMA).repartition(3)


def brute(rows, k, step):
    length = max((len(v) for _, v in rows if v is not None), key=lambda n: sum(v is not None and len(v) == n for _, v in rows))
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows if v is not None and len(v) == length and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, x in good.items():
        if q % step == 0:
            out[q] = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in good.items() if i != q)[:k]
    return out


def found(vectors, k, step):
    out = {}
    for r in ann.nearest(vectors, vectors.where(f"vec_id % {step} = 0"), k).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def test_odd_vectors_and_ties(spark):
    draw = np.random.default_rng(0)
    hot = draw.normal(size=8).round(2)
    rows = [(i, draw.normal(size=8).round(2).tolist()) for i in range(60)] + [(i, hot.tolist()) for i in range(60, 90)]
    rows += [(100, None), (101, [0.0] * 8), (102, [None] + [1.0] * 7), (103, [float("nan")] + [1.0] * 7), (104, [float("inf")] + [1.0] * 7), (105, [1.0] * 5), (110, [])]
    got, want = found(table(spark, rows), 10, 5), brute(rows, 10, 5)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        assert [s for s, _ in got[q]] == pytest.approx([s for s, _ in want[q]], abs=1e-12)


def test_distances_are_those_of_doubles(spark):
    draw = np.random.default_rng(3)
    base = draw.normal(size=6)
    rows = [(0, base), (1, base + [3e-9, 0, 0, 0, 0, 0]), (2, base + [1e-9, 0, 0, 0, 0, 0]), (3, [1e60, 1, 1, 1, 1, 1]), (5, [1e60, 2, 1, 1, 1, 1])]
    rows += [(i, draw.normal(size=6)) for i in range(6, 40)]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in ann.nearest(df, df.where("vec_id in (0, 3)"), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    for q in (0, 3):
        x = np.array(dict(rows)[q], float)
        want = sorted((float(np.sqrt(np.cumsum((x - np.array(v, float)) ** 2)[-1])), i) for i, v in rows if i != q)[:5]
        assert got[q] == want
    assert [i for _, i in got[0][:2]] == [2, 1] and got[0][0][0] > 0 and got[3][0] == (1.0, 5)


def test_equal_rows_and_repeated_ids(spark):
    rows = [(0, [1.0, 1.0])] * 3 + [(1, [2.0, 1.0])] * 2 + [(2, [5.0, 1.0]), (2, [1.5, 1.0]), (3, [9.0, 1.0])]
    got = found(table(spark, rows), 4, 2)
    assert got[0] == [(0.5, 2), (1.0, 1), (8.0, 3)]
    assert got[2] == [(0.5, 0), (0.5, 1), (4.0, 3)]


def test_few_and_no_vectors(spark):
    rows = [(0, [1.0, 2.0]), (5, [3.0, 2.0]), (7, [1.0, 2.0])]
    assert {q: [i for _, i in x] for q, x in found(table(spark, rows), 10, 5).items()} == {0: [7, 5], 5: [0, 7]}
    assert ann.nearest(table(spark, rows).where("false"), table(spark, rows).where("false")).count() == 0
    assert ann.nearest(table(spark, [(0, [1.0])]), table(spark, [(0, [1.0])])).count() == 0


def test_bounds_hold_and_tell_apart():
    draw = np.random.default_rng(1)
    vectors = draw.normal(size=(2000, 64)).astype(np.float32)
    centre, turn = vectors.mean(axis=0), ann.rotation(64)
    low, high = ann.bounds(vectors[:40], centre, turn, *ann.encode(vectors, centre, turn))
    true = ((vectors[:40, None] - vectors[None]) ** 2).sum(axis=2)
    assert ((low <= true + 1e-3) & (true <= high + 1e-3)).mean() > 0.98
    assert (high - low).mean() < true.mean()


@pytest.mark.parametrize("table_dir", ["sf0.001"])
def test_recall_of_the_query(spark, table_dir):
    from actiscope.llm.queries import op8

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/{table_dir}/embeddings.parquet").collect()]
    want, hits, total = brute(rows, 10, 100), 0, 0
    got = op8(spark, f"/root/testdata/{table_dir}").collect()
    for q, near in want.items():
        hits += len({r.vec_id for r in got if r.query_id == q} & {i for _, i in near})
        total += len(near)
    assert total == len(got) and hits / total >= 0.95
