import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Observation
from pyspark.sql import functions as F

from actiscope.operators import features, models
from actiscope.plans.classify import run_classification
from actiscope.schema import LABELS, RECORD_SCHEMA
from actiscope.sources import sinks


@pytest.fixture(scope="module")
def records(spark):
    """Noise around a class-dependent mean; layer 2 has too few rows of one class."""
    rng = np.random.default_rng(4)
    rows = []
    for g in range(40):
        for layer in range(3):
            for label in range(5):
                if layer == 2 and label == 4 and g > 1:
                    continue
                v = rng.normal(size=8) * 0.5
                v[label] += 2.0
                rows.append((f"{g:05d}_L{layer:03d}_T{label}", "m", g, layer, label, LABELS[label], v.astype(np.float32).tolist()))
    return spark.createDataFrame(rows, RECORD_SCHEMA).repartition(4).cache()


SMALL = {
    "LogisticRegression": {"max_iter": 30},
    "RandomForest": {"trees": 10, "depth": 6},
    "BoostedTrees": {"rounds": 5, "leaves": 8},
    "SVM": {"count": 64, "max_iter": 20},
}


def test_both_tracks_beat_chance(spark, records, tmp_path):
    results = run_classification(
        records,
        pca_dim=6,
        classical=models.classical_models(**SMALL),
        networks=models.network_models(["MLP_Tiny", "CNN_Tiny", "Attention_Small"], token_width=8, epochs=8),
        sampled_networks={},
        models_dir=str(tmp_path / "models"),
        results_dir=str(tmp_path / "results"),
    )
    metrics = {(r.track, r.classifier, r.split): r for r in results.metrics.collect()}
    assert {c for _, c, _ in metrics} == {"LogisticRegression", "RandomForest", "KNN", "BoostedTrees", "SVM", "MLP_Tiny", "CNN_Tiny", "Attention_Small"}
    for (_, name, _), r in metrics.items():
        assert r.accuracy > (0.2 if name == "CNN_Tiny" else 0.5), name
        assert r.train_time_s > 0
    best = {r.tag: r for r in results.best.collect()}
    assert best.keys() == {"cross_layer", "cross_layer_stream"}
    for tag, row in best.items():
        assert row.f1_weighted == max(r.f1_weighted for r in metrics.values() if r.split == "test" and r.tag == tag)
        kept = sinks.load_best_model(spark, tag, str(tmp_path / "models"))
        assert kept.meta["classifier"] == row.classifier
        new = features.stack_vectors(records).select("sample_id", "layer_index", "label", "features")
        assert kept.transform(new).select("prediction").count() == records.count()
    log = results.log.collect()
    assert {r.classifier for r in log} == {"MLP_Tiny"} and all(r.train_loss > 0 and r.val_loss > 0 for r in log)
    assert results.explained.count() == 1 and results.sizes.agg({"n": "sum"}).first()[0] == 2 * records.count()
    assert {r.row for r in results.report.collect()} >= set(LABELS.values()) and "true_name" in results.confusion.columns
    assert spark.read.option("header", True).csv(str(tmp_path / "results" / "summary_cross-layer")).count() == 16
    assert results.report.where("row = 'accuracy'").count() == 8


def test_small_layers_are_left_out(records):
    results = run_classification(
        records, task="per-layer", track="classical", pca_dim=None,
        classical={"LogisticRegression": models.classical_models(**SMALL)["LogisticRegression"]},
        sampled_networks={}, split_by="instruction",
    )
    assert {r.tag for r in results.metrics.collect()} == {"layer_0", "layer_1"}


def test_unknown_names(records):
    with pytest.raises(ValueError, match="task"):
        run_classification(records, task="other")
    with pytest.raises(ValueError, match="track"):
        run_classification(records, track="other")
    with pytest.raises(ValueError, match="unknown networks"):
        models.network_models(["MLP_Giant"])


def test_early_stopping_restores_the_best(records):
    rows = features.stack_vectors(records).select("label", "features", "instruction_id").cache()
    train, val = rows.where("instruction_id < 30"), rows.where("instruction_id >= 30")
    best, log = models.fit_early_stop(train, val, "MLP_Tiny", epochs=8, steps_per_epoch=3, rate=0.1, patience=2)
    losses = [loss for _, _, loss, _ in log]
    assert losses[0] > min(losses)
    assert models.validation_loss(best, val) == pytest.approx(min(losses))


def test_tokens_must_fill_the_vector(records):
    rows = features.stack_vectors(records)
    with pytest.raises(ValueError, match="tokens"):
        models.fit_chunks(rows, width=3)


def test_rate_without_validation_rows(records):
    rows = features.stack_vectors(records).cache()
    model = models.fit_network(rows, val=rows.where("false"), rate=0.1, patience=2, epochs=2)
    assert not hasattr(model, "training_log")


def test_saved_feature_model_scores_alike(spark, records, tmp_path):
    rows = features.stack_vectors(records).select("sample_id", "label", "features").cache()
    for name, model in (("svm", models.fit_svm(rows, count=32, max_iter=5)), ("conv", models.fit_conv(rows, max_iter=5)), ("tokens", models.fit_chunks(rows, width=4, max_iter=5))):
        sinks.save_best_model(spark, model, name, name, 0.5, False, str(tmp_path))
        back = sinks.load_best_model(spark, name, str(tmp_path))
        a, b = (sorted(map(tuple, m.transform(rows).select("sample_id", "prediction").collect())) for m in (model, back))
        assert a == b


def test_lowest_class_wins_a_tie(spark):
    df = spark.createDataFrame([([1.0, 1.0],), ([0.0, 2.0],)], "v array<float>")
    scorer = models.linear_scorer(np.array([[0.0, 0.0], [1.0, 0.0], [0.0, 1.0]]), np.array([0.0, 0.0, 0.0]))
    assert [r.prediction for r in models.batch_predict(df, scorer, "v").select("prediction").collect()] == [1, 2]


def test_weights_of_networks():
    assert models.n_weights(models.network_layers("MLP_2L", 64, 5)) == 65 * 512 + 513 * 128 + 129 * 5
    assert list(models.network_models())[:7] == list(models.MLP_WIDTHS)
    assert len({(s.name, str(s.settings)) for s in models.network_models().values()}) == len(models.network_models())


def test_saved_neighbor_model_scores_alike(spark, records, tmp_path):
    rows = features.stack_vectors(records).select("sample_id", "label", "features", "instruction_id").cache()
    model, asked = models.fit_knn(rows.where("instruction_id < 30")), rows.where("instruction_id >= 30")
    model.write().overwrite().save(str(tmp_path / "knn"))
    back = models.NeighborModel.load(spark, str(tmp_path / "knn"))
    assert sorted(r[0:2] for r in model.transform(asked).select("sample_id", "prediction").collect()) == sorted(
        r[0:2] for r in back.transform(asked).select("sample_id", "prediction").collect()
    )


def test_a_forest_is_grown_from_all_rows(spark):
    rows = spark.range(60_000).select((F.col("id") % 3).cast("int").alias("label"), array_to_vector(F.array(F.col("id") % 3 + F.rand(1), F.rand(2))).alias("features"))
    (tree,) = models.fit_forest(rows, trees=1, depth=2).trees
    assert tree._call_java("rootNode").impurityStats().count() > 58_000  # of 60,000 drawn with replacement


def test_the_kernel_model_scores_after_a_query_was_observed(spark, records):
    seen = Observation("seen")
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 3}
    rows = features.stack_vectors(records).select("label", "features")
    assert models.fit_svm(rows, count=8, max_iter=2).transform(rows).where("prediction is not null").count() == records.count()
