"""Scores, reports and model selection from a long table of predictions.

Predictions are counted once by (group, true class, predicted class). All
scores follow from those counts, whose number depends on the classes and not on
the rows; the counting itself is pre-aggregated in every task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actiscope.schema import LEARNING_RATE, PLATEAU_FACTOR, PLATEAU_PATIENCE, STOP_PATIENCE

GROUP = ("tag", "classifier", "split")
# Smallest probability in a loss; relative gain the plateau rule asks for.
MIN_PROBABILITY = 1e-15
PLATEAU_THRESHOLD = 1e-4


def score_join(truth: DataFrame, predictions: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """Pair true and predicted classes by row id."""
    return truth.join(predictions, id_col)


def confusion_counts(predictions: DataFrame, by: Sequence[str] = GROUP, y_true="y_true", y_pred="y_pred") -> DataFrame:
    return predictions.groupBy(*by, F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n")
    )


def class_scores(predictions: DataFrame, by: Sequence[str] = GROUP, y_true="y_true", y_pred="y_pred") -> DataFrame:
    """Per group and class: hits, support, predicted, precision, recall, F1.

    Each confusion cell adds to the class it belongs to and to the class it was
    taken for, so one aggregate gives all classes of truth and prediction.
    """
    counts = confusion_counts(predictions, by, y_true, y_pred)
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(F.col("y_true").alias("class"), hit.alias("tp"), F.col("n").alias("support"), zero.alias("predicted")),
        F.struct(F.col("y_pred").alias("class"), zero.alias("tp"), zero.alias("support"), F.col("n").alias("predicted")),
    )
    per_class = counts.select(*by, F.inline(sides)).groupBy(*by, "class").agg(
        *[F.sum(c).alias(c) for c in ("tp", "support", "predicted")]
    )
    return per_class.select(
        "*",
        _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _weighted(c: str) -> Column:
    return F.sum(F.col(c) * F.col("support")) / F.sum("support")


def accuracy(predictions: DataFrame, by: Sequence[str] = GROUP, y_true="y_true", y_pred="y_pred") -> DataFrame:
    return predictions.groupBy(*by).agg(F.avg((F.col(y_true) == F.col(y_pred)).cast("int")).alias("accuracy"))


def f1_scores(predictions: DataFrame, by: Sequence[str] = GROUP, y_true="y_true", y_pred="y_pred") -> DataFrame:
    scores = class_scores(predictions, by, y_true, y_pred)
    return scores.groupBy(*by).agg(F.avg("f1").alias("f1_macro"), _weighted("f1").alias("f1_weighted"))


def evaluate_splits(predictions: DataFrame, by: Sequence[str] = GROUP, y_true="y_true", y_pred="y_pred") -> DataFrame:
    """One metrics row per group: accuracy, weighted F1, macro F1 and rows scored."""
    scores = class_scores(predictions, by, y_true, y_pred)
    return scores.groupBy(*by).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        _weighted("f1").alias("f1_weighted"),
        F.avg("f1").alias("f1_macro"),
        F.sum("support").alias("n_rows"),
    )


def confusion_matrix(predictions: DataFrame, by: Sequence[str] = GROUP, y_true="y_true", y_pred="y_pred") -> DataFrame:
    """Counts for every pair of classes seen in a group, zeros included.

    The cells of a group are gathered as a map and read back for each pair of
    its classes; its size is the number of classes squared, not of rows.
    """
    counts = confusion_counts(predictions, by, y_true, y_pred)
    cell = F.struct(F.struct("y_true", "y_pred"), F.col("n"))
    grouped = counts.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(cell)).alias("cells"),
        F.array_distinct(F.flatten(F.collect_set(F.array("y_true", "y_pred")))).alias("classes"),
    )
    pairs = grouped.select("*", F.explode("classes").alias("y_true")).select("*", F.explode("classes").alias("y_pred"))
    n = F.try_element_at(F.col("cells"), F.struct("y_true", "y_pred"))
    return pairs.select(*by, "y_true", "y_pred", F.coalesce(n, F.lit(0).cast("bigint")).alias("n"))


def confusion_pivot(
    predictions: DataFrame, classes: Sequence, by: Sequence[str] = GROUP, y_true="y_true", y_pred="y_pred"
) -> DataFrame:
    """The matrix with one column per predicted class, named ``pred_<class>``."""
    counts = confusion_counts(predictions, by, y_true, y_pred)
    columns = [
        F.coalesce(F.sum(F.when(F.col("y_pred") == F.lit(c), F.col("n"))), F.lit(0)).alias(f"pred_{c}") for c in classes
    ]
    return counts.groupBy(*by, "y_true").agg(*columns)


def classification_report(predictions: DataFrame, by: Sequence[str] = GROUP, y_true="y_true", y_pred="y_pred") -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted rows.

    The summary rows are made from the gathered class rows of a group, so the
    predictions are read once.
    """
    scores = class_scores(predictions, by, y_true, y_pred)
    fields = ("precision", "recall", "f1")
    line = F.struct(F.col("class").cast("string").alias("row"), *fields, "support")

    def summary(row: str, values: list[Column]) -> Column:
        return F.struct(
            F.lit(row).alias("row"), *[v.alias(f) for v, f in zip(values, fields)], F.col("_support").alias("support")
        )

    grouped = scores.groupBy(*by).agg(
        F.collect_list(line).alias("_lines"),
        F.sum("support").alias("_support"),
        (F.sum("tp") / F.sum("support")).alias("_accuracy"),
        *[F.avg(f).alias(f"_macro_{f}") for f in fields],
        *[_weighted(f).alias(f"_weighted_{f}") for f in fields],
    )
    summaries = F.array(
        summary("accuracy", [F.col("_accuracy")] * 3),
        summary("macro avg", [F.col(f"_macro_{f}") for f in fields]),
        summary("weighted avg", [F.col(f"_weighted_{f}") for f in fields]),
    )
    return grouped.select(*by, F.inline(F.concat("_lines", summaries)))


def _name(names: Mapping[int, str], c: Column) -> Column:
    table = F.create_map(*(F.lit(x) for k, v in names.items() for x in (str(k), v)))
    return F.coalesce(F.try_element_at(table, c.cast("string")), c.cast("string"))


def named_rows(report: DataFrame, names: Mapping[int, str]) -> DataFrame:
    """The report with class names for ids; rows of a class without a name, and summaries, stay."""
    return report.withColumn("row", _name(names, F.col("row")))


def named_classes(matrix: DataFrame, names: Mapping[int, str]) -> DataFrame:
    """The matrix with ``true_name`` and ``pred_name`` next to the ids."""
    return matrix.withColumns({"true_name": _name(names, F.col("y_true")), "pred_name": _name(names, F.col("y_pred"))})


def log_loss(
    predictions: DataFrame, by: Sequence[str] = GROUP, y_true: str = "y_true", probability: str = "probability"
) -> DataFrame:
    """Mean cross-entropy of the true class."""
    p = F.element_at(F.col(probability), F.col(y_true).cast("int") + 1)
    loss = -F.log(F.greatest(p, F.lit(MIN_PROBABILITY)))
    return predictions.groupBy(*by).agg(F.avg(loss).alias("log_loss"), F.count(F.lit(1)).alias("n_rows"))


def best_model(metrics: DataFrame, select_on: str = "test", order: str = "train_order") -> DataFrame:
    """Per tag the model with the highest weighted F1; a tie keeps the one trained first."""
    ranked = Window.partitionBy("tag").orderBy(F.col("f1_weighted").desc(), order)
    return (
        metrics.where(F.col("split") == select_on)
        .withColumn("_place", F.row_number().over(ranked))
        .where("_place = 1")
        .drop("_place")
    )


def summary_table(*tracks: DataFrame) -> DataFrame:
    """All metric rows one below the other; a column missing from a track is null."""
    table = tracks[0]
    for track in tracks[1:]:
        table = table.unionByName(track, allowMissingColumns=True)
    return table


def best_epoch(
    training_log: DataFrame,
    by: Sequence[str] = ("classifier",),
    patience: int = STOP_PATIENCE,
    plateau_patience: int = PLATEAU_PATIENCE,
    factor: float = PLATEAU_FACTOR,
    rate: float = LEARNING_RATE,
) -> DataFrame:
    """Replay early stopping over (epoch, val_loss) rows.

    Per group: the epoch of the last strict gain, its loss, the epoch training
    stops at (null when it runs to the end), and the learning rate after the
    last epoch run. The rate is cut when more than ``plateau_patience`` epochs
    in a row miss the plateau rule's relative gain. A group has one row per
    epoch, so folding it as an array is bounded by the training length.
    """
    start = (
        "named_struct('best', double('infinity'), 'best_epoch', cast(null as bigint), 'wait', 0, "
        f"'stop', cast(null as bigint), 'mark', double('infinity'), 'flat', 0, 'rate', {rate!r}D)"
    )
    gain = "x.val_loss < s.best"
    marked = f"x.val_loss < s.mark * {1 - PLATEAU_THRESHOLD!r}D"
    cut = f"not ({marked}) and s.flat + 1 > {plateau_patience}"
    stop = f"not ({gain}) and s.wait + 1 >= {patience}"
    step = f"""if(s.stop is not null, s, named_struct(
        'best', if({gain}, x.val_loss, s.best),
        'best_epoch', if({gain}, x.epoch, s.best_epoch),
        'wait', if({gain}, 0, s.wait + 1),
        'stop', if({stop}, x.epoch, cast(null as bigint)),
        'mark', if({marked}, x.val_loss, s.mark),
        'flat', if(({marked}) or ({cut}), 0, s.flat + 1),
        'rate', if({cut}, s.rate * {factor!r}D, s.rate)))"""
    rows = training_log.select(*by, F.col("epoch").cast("bigint").alias("epoch"), F.col("val_loss").cast("double"))
    return (
        rows.groupBy(*by)
        .agg(F.sort_array(F.collect_list(F.struct("epoch", "val_loss"))).alias("_log"))
        .select(*by, F.expr(f"aggregate(_log, {start}, (s, x) -> {step})").alias("_end"))
        .select(
            *by,
            F.col("_end.best_epoch").alias("best_epoch"),
            F.col("_end.best").alias("best_loss"),
            F.col("_end.stop").alias("stop_epoch"),
            F.col("_end.rate").alias("final_rate"),
        )
    )
