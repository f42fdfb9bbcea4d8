import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actiscope.functions import keyed, vectors
from actiscope.operators import variants
from actiscope.plans.generate import build_records
from actiscope.schema import LABELS


def numpy_int4(v):
    top = np.max(np.abs(v))
    if top == 0:
        return v.copy()
    scale = top / np.float32(7.0)
    return (np.clip(np.round(v / scale), -8, 7) * scale).astype(np.float32)


@pytest.fixture(scope="module")
def many(spark):
    from actiscope.schema import LAYER_STATE_SCHEMA

    rng = np.random.default_rng(3)
    rows = []
    for g in range(60):
        for layer in range(3):
            d = int(rng.integers(1, 70))
            out = (rng.normal(size=d) * 10.0 ** rng.integers(-3, 4)).astype(np.float32)
            if g == 7:
                out[:] = 0
            rows.append((g, layer, rng.normal(size=d).astype(np.float32).tolist(), out.tolist()))
    return rows, spark.createDataFrame(rows, LAYER_STATE_SCHEMA).repartition(5)


def by_key(df):
    return {
        (r.instruction_id, r.layer_index, r.label): np.array(r.vector, dtype=np.float32) for r in df.collect()
    }


def test_engines_give_the_same_vectors(many):
    rows, df = many
    a, b = by_key(variants.expand(df, engine="arrow")), by_key(variants.expand(df, engine="columns"))
    assert set(a) == set(b) and len(a) == 5 * len(rows)
    for key in a:
        np.testing.assert_array_equal(a[key].view(np.int32) if key[2] == 1 else a[key], b[key].view(np.int32) if key[2] == 1 else b[key])


def test_labels_0_1_2_equal_numpy(many):
    rows, df = many
    made = by_key(variants.expand(df))
    for g, layer, inp, out in rows:
        v = np.array(out, dtype=np.float32)
        np.testing.assert_array_equal(made[g, layer, 0], v)
        np.testing.assert_array_equal(made[g, layer, 1], numpy_int4(v))
        np.testing.assert_array_equal(made[g, layer, 2], np.array(inp, dtype=np.float32))


def test_zero_vector(many):
    made = by_key(variants.expand(many[1].where("instruction_id = 7")))
    for (_, _, label), v in made.items():
        if label in (0, 1):
            assert not v.any()
        if label == 3:
            assert 0 < np.abs(v).max() < 1e-6


def test_noise_follows_the_output(states):
    rng = np.random.default_rng(1)
    out = (rng.normal(size=20_000) * 3 + 5).astype(np.float32)
    made = by_key(variants.expand(states([(0, 0, out.tolist(), out.tolist())])))
    noise, moved = made[0, 0, 3], made[0, 0, 4] - out
    assert abs(noise.mean() - out.mean()) < 0.1 and abs(noise.std() / out.std() - 1) < 0.03
    assert abs(moved.mean()) < 0.01 and abs(moved.std() / (0.05 * out.std()) - 1) < 0.03
    assert abs(np.corrcoef(noise, moved)[0, 1]) < 0.03
    assert abs(np.corrcoef(noise[:-1], noise[1:])[0, 1]) < 0.03


def test_seed_and_layout_decide_nothing_else(many):
    _, df = many
    a, b = by_key(variants.expand(df)), by_key(variants.expand(df.repartition(2)))
    c = by_key(variants.expand(df, seed=43))
    assert all((a[k] == b[k]).all() for k in a)
    assert any((a[k] != c[k]).any() for k in a if k[2] == 3)


def test_own_generator(states):
    df = states([(1, 2, [1.0, 2.0], [3.0, 4.0])])
    doubled = {**variants.GENERATORS, 5: lambda row: f"transform({row.output_vec}, x -> cast(2 * x as float))"}
    for engine in ("arrow", "columns"):
        made = variants.expand(df, engine=engine, generators=doubled, names={**LABELS, 5: "doubled"})
        assert by_key(made)[1, 2, 5].tolist() == [6.0, 8.0]
    with pytest.raises(ValueError):
        variants.expand(df, generators=doubled)
    with pytest.raises(ValueError):
        variants.expand(df, engine="other")


def test_normals_of_odd_length():
    flat = keyed.normals_flat(np.array([5, 9]), np.array([1, 2]), np.array([3, 4]))
    assert len(flat) == 7
    np.testing.assert_array_equal(flat[:3], keyed.normals_flat(np.array([5]), np.array([1]), np.array([4]))[:3])


def test_records_layout(states):
    from actiscope.schema import RECORD_SCHEMA

    df = build_records(states([(3, 1, [1.0], [2.0])]), "org/name//")
    assert df.schema.fieldNames() == RECORD_SCHEMA.fieldNames()
    assert [f.dataType for f in df.schema] == [f.dataType for f in RECORD_SCHEMA]
    rows = sorted(df.collect())
    assert [r.sample_id for r in rows] == [f"00003_L001_T{k}" for k in range(5)]
    assert {r.model_name for r in rows} == {"name"}


def test_expand_does_not_shuffle(many, spark, tmp_path):
    many[1].write.parquet(str(tmp_path / "s"))
    df = spark.read.parquet(str(tmp_path / "s"))
    plan = build_records(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_chunk_mean_of_odd_length_fails(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], T.StructType([T.StructField("v", T.ArrayType(T.DoubleType()))]))
    with pytest.raises(Exception, match="multiple"):
        df.select(F.expr(vectors.chunk_mean("v", 2))).collect()
