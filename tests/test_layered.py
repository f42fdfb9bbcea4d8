import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from actiscope.operators import features, layered, models
from actiscope.sources import sinks


@pytest.fixture(scope="module")
def rows(spark):
    """Three layers of unequal size, 12 values whose spread falls off, three classes."""
    draw = np.random.default_rng(6)
    data = []
    for layer, n in ((0, 300), (1, 150), (7, 90)):
        turn = np.linalg.qr(draw.normal(size=(12, 12)))[0]
        y = draw.integers(3, size=n)
        x = draw.normal(size=(n, 12)) * 3.0 ** -np.arange(12) @ turn + layer
        x[:, :3] += 1.5 * np.eye(3)[y]
        data += [(layer, [float(v) for v in r], int(c)) for r, c in zip(x, y)]
    df = spark.createDataFrame(data, "layer_index int, v array<double>, label int").withColumn("features", array_to_vector("v")).withColumn("sample_id", F.monotonically_increasing_id()).repartition(4).cache()
    yield df
    df.unpersist()


def test_sketched_components_are_those_of_the_covariance(rows):
    found = layered.fit_pca_layers(rows, 4, spare=4)
    for layer, model in found.models.items():
        want = features.fit_pca(rows.where(F.col("layer_index") == layer), 4)
        assert np.allclose(model.mean, want.mean) and np.allclose(model.variances[:4], want.variances[:4], rtol=1e-3)
        assert np.allclose(np.abs((model.components * want.components).sum(axis=1)), 1, atol=1e-3)
        assert np.allclose(model.ratios.sum(), want.ratios.sum(), rtol=1e-3)
    whole = layered.fit_pca_sketch(rows, 12)
    want = features.fit_pca(rows, 12)
    assert np.allclose(whole.components[:8], want.components[:8], atol=1e-6)
    turned = found.transform(rows).where("layer_index = 7").select("features", "pca").first()
    assert np.allclose(turned.pca.toArray(), (turned.features.toArray() - found.models[7].mean) @ found.models[7].components.T)


def test_layers_in_turns_give_the_same(rows, monkeypatch):
    together = layered.fit_pca_layers(rows, 12)
    monkeypatch.setattr(layered, "SUM_BYTES", 8 * 12 * 12)
    apart = layered.fit_pca_layers(rows, 12)
    assert all(np.allclose(together.models[k].components[:8], apart.models[k].components[:8], atol=1e-6) for k in together.models)


def test_one_fit_is_that_of_each_layer(rows):
    model = layered.fit_logreg_layers(rows)
    assert set(model.models) == {0, 1, 7}
    scored = model.transform(rows)
    for layer in (0, 1, 7):
        mine = scored.where(F.col("layer_index") == layer).orderBy("sample_id").select("probability", "prediction").collect()
        own = models.fit_logreg(rows.where(F.col("layer_index") == layer)).transform(rows.where(F.col("layer_index") == layer)).orderBy("sample_id").select("probability", "prediction").collect()
        assert np.allclose([r.probability.toArray() for r in mine], [r.probability.toArray() for r in own], atol=0.02)
        assert np.mean([a.prediction == b.prediction for a, b in zip(mine, own)]) > 0.98


def test_the_number_of_passes_does_not_depend_on_layers(rows, monkeypatch):
    passes = []
    summed = layered._summed
    monkeypatch.setattr(layered, "_summed", lambda part, add: passes.append(1) or summed(part, add))
    layered.fit_logreg_layers(rows.where("layer_index = 0"), max_iter=5)
    one = len(passes)
    layered.fit_logreg_layers(rows, max_iter=5)
    assert len(passes) - one <= one + 3


def test_a_layer_is_kept_alone(rows, spark, tmp_path):
    model = layered.fit_logreg_layers(rows, max_iter=20).models[7]
    sinks.save_best_model(spark, model, "LogisticRegression", "layer_7", 0.9, False, str(tmp_path))
    kept = sinks.load_best_model(spark, "layer_7", str(tmp_path))
    mine = rows.where("layer_index = 7")
    assert [r.prediction for r in kept.transform(mine).orderBy("sample_id").collect()] == [r.prediction for r in model.transform(mine).orderBy("sample_id").collect()]


def test_no_rows(rows):
    for fit in (layered.fit_pca_layers, layered.fit_logreg_layers):
        with pytest.raises(ValueError):
            fit(rows.where("false"))
