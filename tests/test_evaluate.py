import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from actiscope.operators import evaluate, models

KIND = "tag string, y_true int, y_pred int"


@pytest.fixture
def scored(spark):
    rows = [("a", 0, 0), ("a", 0, 1), ("a", 1, 1), ("a", 2, 7), ("b", 1, 1)]
    return spark.createDataFrame(rows, KIND)


def test_scores_with_undefined_parts(scored):
    rows = {(r.tag, r["class"]): r for r in evaluate.class_scores(scored, ("tag",)).collect()}
    assert rows["a", 2].precision == 0 and rows["a", 2].recall == 0 and rows["a", 2].f1 == 0
    assert rows["a", 7].support == 0 and rows["a", 7].recall == 0
    assert rows["a", 0].precision == 1 and rows["a", 0].recall == 0.5
    f1 = {r.tag: r for r in evaluate.f1_scores(scored, ("tag",)).collect()}
    assert f1["a"].f1_macro == pytest.approx((2 / 3 + 2 / 3 + 0 + 0) / 4)
    assert f1["a"].f1_weighted == pytest.approx((2 * 2 / 3 + 2 / 3) / 4)
    assert f1["b"].f1_macro == 1


def test_matrix_has_every_pair_of_seen_classes(scored):
    cells = {(r.y_true, r.y_pred): r.n for r in evaluate.confusion_matrix(scored, ("tag",)).where("tag = 'a'").collect()}
    assert len(cells) == 16 and sum(cells.values()) == 4 and cells[2, 7] == 1 and cells[7, 7] == 0


def test_report_rows(scored):
    rows = {r.row: r for r in evaluate.classification_report(scored, ("tag",)).where("tag = 'a'").collect()}
    assert set(rows) == {"0", "1", "2", "7", "accuracy", "macro avg", "weighted avg"}
    assert rows["accuracy"].f1 == 0.5 and rows["weighted avg"].support == 4


def test_log_loss_is_clipped(spark):
    rows = [("a", 0, [0.5, 0.5]), ("a", 1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "tag string, y_true int, probability array<double>")
    want = (-math.log(0.5) - math.log(1e-15)) / 2
    assert evaluate.log_loss(df, ("tag",)).first().log_loss == pytest.approx(want)


def test_best_model_tie_keeps_the_earlier(spark):
    rows = [("t", "x", 2, "test", 0.9), ("t", "y", 1, "test", 0.9), ("t", "z", 3, "val", 0.95)]
    df = spark.createDataFrame(rows, "tag string, classifier string, train_order int, split string, f1_weighted double")
    assert evaluate.best_model(df).first().classifier == "y"
    assert evaluate.best_model(df, select_on="val").first().classifier == "z"


def replay(losses, **rule):
    """What a training loop with these losses does."""
    stop = models.StopRule(**rule)
    best_epoch = stop_epoch = None
    for epoch, loss in enumerate(losses, 1):
        improved, done = stop.update(loss)
        best_epoch = epoch if improved else best_epoch
        if done:
            stop_epoch = epoch
            break
    return best_epoch, stop.best, stop_epoch, stop.rate


def test_best_epoch_example(spark):
    losses = [1.0, 0.8, 0.9, 0.85, 0.7, 0.71, 0.72, 0.73, 0.1]
    log = spark.createDataFrame([("m", i, x) for i, x in enumerate(losses, 1)], "classifier string, epoch int, val_loss double")
    row = evaluate.best_epoch(log, patience=3).first()
    assert (row.best_epoch, row.best_loss, row.stop_epoch, row.final_rate) == (5, 0.7, 8, 1e-3)


def test_rate_is_cut_after_more_than_patience_flat_epochs():
    assert replay([1.0] + [1.0] * 3, rate=1.0)[3] == 1.0
    assert replay([1.0] + [1.0] * 4, rate=1.0)[3] == 0.5
    assert replay([1.0] + [0.99999] * 4, rate=1.0)[3] == 0.5


@settings(max_examples=1, deadline=None)
@given(st.lists(st.lists(st.sampled_from([0.5, 0.6, 0.59999, 0.7, 0.8, 1.0]), min_size=1, max_size=30), min_size=80, max_size=80))
def test_table_and_loop_agree(runs):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    rows = [(f"m{k}", i, x) for k, losses in enumerate(runs) for i, x in enumerate(losses, 1)]
    log = spark.createDataFrame(rows, "classifier string, epoch int, val_loss double")
    got = {r.classifier: tuple(r)[1:] for r in evaluate.best_epoch(log, patience=5, plateau_patience=2).collect()}
    for k, losses in enumerate(runs):
        assert got[f"m{k}"] == replay(losses, patience=5, plateau_patience=2)
