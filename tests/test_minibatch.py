import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from actiscope.operators import minibatch, models
from actiscope.sources import sinks


@pytest.fixture(scope="module")
def rows(spark):
    """Two rings, which no line tells apart, and a third class far away."""
    draw = np.random.default_rng(8)
    angle, y = draw.random(600) * 2 * np.pi, draw.integers(3, size=600)
    x = np.column_stack((np.cos(angle), np.sin(angle))) * np.where(y == 1, 3.0, 1.0)[:, None] + draw.normal(size=(600, 2)) * 0.1 + 10 * (y == 2)[:, None]
    data = [(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "sample_id int, v array<double>, label int").withColumn("features", array_to_vector("v")).repartition(3).cache()
    yield df
    df.unpersist()


def test_gradients_are_differences():
    draw = np.random.default_rng(1)
    layers = [w.astype(np.float64) for w in minibatch.first_weights([4, 5, 3], 2)]
    x, y = draw.normal(size=(7, 4)), draw.integers(3, size=7)
    _, found = minibatch.gradients(layers, x, y)
    for i, w in enumerate(layers):
        for at in ((0, 0), (2, 1), (1, w.shape[1] - 1)):
            kept, ends = w[at], []
            for move in (1e-6, -1e-6):
                w[at] = kept + move
                ends.append(minibatch.gradients(layers, x, y)[0] / 7)
            w[at] = kept
            assert found[i][at] == pytest.approx((ends[0] - ends[1]) / 2e-6, rel=1e-4, abs=1e-7)


def test_learns_what_is_not_linear(rows, spark, tmp_path):
    train, val, test = (rows.where(f"sample_id % 5 in ({s})") for s in ("0,1,2", "3", "4"))
    model = minibatch.fit_network(train, [32], val=val, rate=0.02, epochs=40)
    right = model.transform(test).agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0]
    assert right > 0.95
    log = model.training_log
    assert [e for e, *_ in log] == list(range(1, len(log) + 1)) and log[4][1] < log[0][1] * 0.7 and min(v for _, _, v, _ in log) < 0.3
    sinks.save_best_model(spark, model, "MLP_Tiny", "t", 0.9, True, str(tmp_path))
    kept = sinks.load_best_model(spark, "t", str(tmp_path))
    a, b = ([r.prediction for r in m.transform(test).orderBy("sample_id").collect()] for m in (model, kept))
    assert a == b


def test_averages_of_tasks_are_weighted_by_rows(rows, monkeypatch):
    monkeypatch.setattr(minibatch, "PART", 50)
    one = minibatch.fit_network(rows, [16], epochs=15, rate=0.02, tasks=1)
    many = minibatch.fit_network(rows, [16], epochs=15, rate=0.02, tasks=4)
    for model in (one, many):
        assert model.transform(rows).agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0] > 0.9
    assert not np.allclose(one.layers[0], many.layers[0])


def test_the_same_again_and_batches_are_batches(rows):
    first, again = (minibatch.fit_network(rows, [8], epochs=2, tasks=2) for _ in range(2))
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(first.layers, again.layers))
    other = minibatch.fit_network(rows, [8], epochs=2, tasks=2, batch_size=3)
    assert not np.allclose(first.layers[0], other.layers[0], atol=1e-3)


def test_stops_early_and_keeps_the_best(rows):
    train, val = rows.where("sample_id % 2 = 0"), rows.where("sample_id % 2 = 1")
    model = minibatch.fit_network(train, [8], val=val, epochs=60, rate=1.5, patience=5)
    losses = [v for _, _, v, _ in model.training_log]
    checked = val.select(F.col("v"), F.col("label").alias("y"))
    assert len(losses) < 60 and minibatch.mean_loss(checked, model) == pytest.approx(min(losses), rel=1e-6)
    assert model.training_log[-1][3] < 1.5


def test_odd_rows(rows):
    with pytest.raises(ValueError):
        minibatch.fit_network(rows.where("false"), [4])
    with pytest.raises(ValueError):
        models.fit_widths(rows, "MLP_None")
    model = models.fit_widths(rows, "MLP_Tiny", val=rows.where("false"), epochs=2)
    assert model.training_log == [] and model.transform(rows.where("false")).count() == 0


def test_scored_a_few_rows_at_a_time(monkeypatch):
    draw = np.random.default_rng(3)
    model = minibatch.NetworkModel(minibatch.first_weights([5, 40, 3], 1), np.zeros(5), np.ones(5), "v")
    rows, sizes, forward = draw.normal(size=(100, 5)), [], minibatch.forward
    want = minibatch.softmax(forward(model.layers, model.scaled(rows))[-1])
    monkeypatch.setattr(minibatch, "HELD_CELLS", 43 * 7)
    monkeypatch.setattr(minibatch, "forward", lambda layers, some: sizes.append(len(some)) or forward(layers, some))
    assert np.allclose(minibatch.class_chances(model, rows), want, atol=1e-6) and max(sizes) == 7 and sum(sizes) == 100
    assert minibatch.class_chances(model, rows[:0]).shape == (0, 3)
