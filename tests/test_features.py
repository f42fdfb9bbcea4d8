import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array

from actiscope.operators import features


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) + 1000.0).astype(np.float64)
    return x, spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, v array<double>").repartition(5)


def ordered(df, column):
    return np.array([r[1] for r in sorted(df.select("id", column).collect())])


def test_components_equal_svd(cloud):
    x, df = cloud
    rows = features.stack_vectors(df, "v")
    model = features.fit_pca(rows, 3)
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    np.testing.assert_allclose(model.ratios, (s**2 / (s**2).sum())[:3], rtol=1e-8)
    assert features.explained_variance(model) == pytest.approx(100 * model.ratios.sum())
    got = ordered(model.transform(rows).select("id", vector_to_array("pca").alias("z")), "z")
    np.testing.assert_allclose(np.abs(got), np.abs((x - x.mean(0)) @ vt[:3].T), atol=1e-6)
    np.testing.assert_allclose(got.mean(0), 0, atol=1e-8)


def test_more_components_than_dimensions(cloud):
    model = features.fit_pca(features.stack_vectors(cloud[1], "v"), 128)
    assert len(model.components) == 6 and features.explained_variance(model) == pytest.approx(100)


def test_covariance_with_a_large_mean(cloud):
    x, df = cloud
    want = np.cov(x.T, bias=True)
    got = {(r.i, r.j): r.covariance for r in features.covariance(df, "v").collect()}
    assert len(got) == 21
    for (i, j), c in got.items():
        assert c == pytest.approx(want[i, j], rel=1e-7, abs=1e-9)


def test_scaler_uses_the_population_deviation(cloud):
    x, df = cloud
    rows = features.stack_vectors(df, "v")
    got = ordered(features.unstack(features.fit_scaler(rows).transform(rows), "scaled", "z"), "z")
    np.testing.assert_allclose(got, (x - x.mean(0)) / x.std(0), atol=1e-8)


def test_conv_engines_agree_on_mixed_lengths(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=int(d)).tolist()) for i, d in enumerate(rng.integers(1, 40, 50))]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    for size, stride in ((7, 2), (7, 1), (15, 2)):
        bank = features.kernel_bank(4, size)
        a = ordered(features.conv_features(df, bank, "v", stride=stride), "conv")
        b = ordered(features.conv_features_arrow(df, bank, "v", stride=stride), "conv")
        np.testing.assert_allclose(a, b, atol=1e-12)


def test_convolution_holds_a_bounded_number_of_responses(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    made = []
    monkeypatch.setattr(features.F, "arrow_udf", lambda f, kind: lambda column: made.append(f))
    frame = type("Frame", (), {"withColumn": lambda self, name, column: self})()
    monkeypatch.setattr(features.F, "col", lambda name: name)
    features.conv_features_arrow(frame, features.kernel_bank(128, 15, 1), "v", "o")
    vectors = pa.array(np.random.default_rng(0).normal(size=(4096, 64)).tolist())
    tracemalloc.start()
    out = made[0](vectors)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 4096 and peak < 64 << 20
