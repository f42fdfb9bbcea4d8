"""From stored records to scored models: two tracks, two tasks, one set of tables."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from actiscope.operators import evaluate, features, layered, models, profile, sampling
from actiscope.schema import LABELS, PCA_DIM, SEED, TEST_SIZE, VAL_SIZE
from actiscope.session import new_work_dir
from actiscope.sources.records import CACHE_BYTES, filter_layer, training_rows
from actiscope.sources.sinks import save_best_model, write_report, write_summary

TASKS = ("cross-layer", "per-layer")
TRACKS = ("auto", "classical", "nn-stream")
EXACT_WIDTH = 1024
"""Vector length up to which components come from the whole covariance, of 8 MB then; beyond, from a sketch."""
BY = ("tag", "track", "classifier", "train_order", "split")


@dataclass
class Results:
    """Stored predictions, and the tables that follow from them.

    ``log`` has the epochs of the networks (tag, track, classifier, epoch, train_loss, val_loss, rate),
    ``explained`` the share of variance each scope's components keep, ``sizes`` the rows of each scope,
    split and label.
    """

    predictions: DataFrame
    metrics: DataFrame
    best: DataFrame
    report: DataFrame
    confusion: DataFrame
    log: DataFrame
    explained: DataFrame
    sizes: DataFrame


@dataclass
class Notes:
    """What fits leave on the driver: a few rows per scope and model."""

    times: list[tuple] = field(default_factory=list)
    log: list[tuple] = field(default_factory=list)
    explained: list[tuple] = field(default_factory=list)
    sizes: list[tuple] = field(default_factory=list)


def scopes(records: DataFrame, task: str) -> list[tuple[str, DataFrame]]:
    """(tag, rows) of each model to fit: all layers as one, or each layer with
    enough rows of every class. Layers are counted before any feature is made."""
    if task == "cross-layer":
        return [("cross_layer", records)]
    if task == "per-layer":
        layers = sorted(r.layer_index for r in profile.eligible_layers(records).select("layer_index").collect())
        return [(f"layer_{k}", filter_layer(records, k)) for k in layers]
    raise ValueError(f"unknown task: {task!r}")


def split_rows(rows: DataFrame, split_by: str, val_size: float, test_size: float, seed: int, within: str | None = None) -> DataFrame:
    """Split by row within each label (and each value of ``within``), or by instruction so that near copies stay together."""
    if split_by == "row":
        return sampling.stratified_split(rows, val_size=val_size, test_size=test_size, seed=seed, within=within)
    if split_by != "instruction":
        raise ValueError(f"unknown split: {split_by!r}")
    outer = sampling.group_split(rows, test_size=test_size, seed=seed)
    inner = sampling.group_split(
        outer.where("split = 'train'").drop("split"), test_size=val_size / (1 - test_size), seed=seed + 1
    )
    inner = inner.withColumn("split", F.when(F.col("split") == "test", "val").otherwise("train"))
    return outer.where("split = 'test'").unionByName(inner)


def fit_and_score(
    rows: DataFrame,
    specs: Mapping[str, models.ModelSpec],
    tag: str,
    track: str,
    inp: str,
    path: str,
    notes: Notes,
    orders: Mapping[str, int],
    models_dir: str | None = None,
    select_on: str = "test",
    components: features.PcaModel | None = None,
) -> None:
    """Fit every model on the train rows and append its predictions for the others.

    Predictions are written once per model, so metrics, reports and matrices
    read them instead of scoring again. Each model has its own folder, so
    scopes that are fitted at the same time do not share a commit. A model that is kept is saved
    with the ``components`` its input was turned by.
    """
    spark = rows.sparkSession
    train, held_out = rows.where("split = 'train'"), rows.where("split != 'train'")
    for name, spec in specs.items():
        order = orders[name]
        started = time.perf_counter()
        extra = {"val": rows.where("split = 'val'")} if spec.uses_val else {}
        model = spec.fit(train, inp=inp, **spec.settings, **extra)
        notes.times.append((tag, track, name, time.perf_counter() - started))
        notes.log += [(tag, track, name, *line) for line in getattr(model, "training_log", ())]
        folder = f"{path}/fit={track}-{tag}-{order}"
        predicted(model.transform(held_out), F.lit(tag), track, name, order).write.parquet(folder)
        if models_dir:
            score = evaluate.f1_scores(spark.read.parquet(folder).where(F.col("split") == select_on), ("tag",)).first()
            if score is not None:
                save_best_model(spark, model, name, tag, score.f1_weighted, spec.family == "network", models_dir, components)


def predicted(scored: DataFrame, tag: Column, track: str, name: str, order: int) -> DataFrame:
    """Predictions as they are stored."""
    return scored.select(
        tag.alias("tag"),
        F.lit(track).alias("track"),
        F.lit(name).alias("classifier"),
        F.lit(order).alias("train_order"),
        "split",
        "sample_id",
        F.col("label").alias("y_true"),
        F.col("prediction").cast("int").alias("y_pred"),
    )


def fit_layers_and_score(
    rows: DataFrame,
    specs: Mapping[str, models.ModelSpec],
    layers: Sequence[int],
    inp: str,
    path: str,
    notes: Notes,
    orders: Mapping[str, int],
    models_dir: str | None,
    select_on: str,
    components: layered.LayeredPca | None,
) -> None:
    """``fit_and_score`` for models that are fitted for all layers in common passes; the time of a fit is shared out evenly."""
    spark = rows.sparkSession
    for name, spec in specs.items():
        started = time.perf_counter()
        model = spec.fit_layers(rows.where("split = 'train'"), inp=inp, **spec.settings)
        share = (time.perf_counter() - started) / len(layers)
        notes.times += [(f"layer_{k}", "classical", name, share) for k in layers]
        folder = f"{path}/fit=classical-layers-{orders[name]}"
        tag = F.concat(F.lit("layer_"), F.col("layer_index").cast("string"))
        predicted(model.transform(rows.where("split != 'train'")), tag, "classical", name, orders[name]).write.parquet(folder)
        if models_dir:
            scores = evaluate.f1_scores(spark.read.parquet(folder).where(F.col("split") == select_on), ("tag",))
            for r in sorted(scores.collect()):  # one row per layer
                k = int(r.tag.removeprefix("layer_"))
                save_best_model(spark, model.models[k], name, r.tag, r.f1_weighted, False, models_dir, components and components.models[k])


def at_once(spark: SparkSession, work: Callable, items: list, parallelism: int) -> None:
    """Run the driver side of several fits in threads, so that the small jobs of
    one layer fill the slots another leaves idle."""
    with ThreadPoolExecutor(max(1, min(parallelism, len(items) or 1))) as pool:
        list(pool.map(inheritable_thread_target(spark)(work), items))


def run_classification(
    records: DataFrame,
    task: str = "cross-layer",
    track: str = "auto",
    pca_dim: int | None = PCA_DIM,
    val_size: float = VAL_SIZE,
    test_size: float = TEST_SIZE,
    seed: int = SEED,
    sample_size: int = 0,
    split_by: str = "row",
    fit_on: str = "train",
    classical: Mapping[str, models.ModelSpec] | None = None,
    networks: Mapping[str, models.ModelSpec] | None = None,
    sampled_networks: Mapping[str, models.ModelSpec] | None = None,
    models_dir: str | None = None,
    results_dir: str | None = None,
    select_on: str = "test",
    parallelism: int = 4,
    cache_bytes: int = CACHE_BYTES,
) -> Results:
    """Fit, score and compare the models of one or both tracks.

    ``classical``: optional sample, components of the vectors, classical models,
    then ``sampled_networks`` on the raw vectors of the same rows. ``nn-stream``:
    all rows, raw vectors, ``networks``. Components are fitted on the train rows;
    ``fit_on="all"`` fits them on all rows. Per layer, rows of all layers are split, turned and cached together, up to
    ``cache_bytes``; models that can be are fitted for all layers in common passes, of the others ``parallelism`` layers at
    the same time. The second track keeps one layer's rows cached while it is fitted. Scopes of the
    second track have ``_stream`` after their tag, in every table and in the saved models, so that the best
    model of a tag is chosen among those that were trained in one order.
    """
    if task not in TASKS:
        raise ValueError(f"unknown task: {task!r}")
    if track not in TRACKS:
        raise ValueError(f"unknown track: {track!r}")
    classical = models.classical_models() if classical is None else classical
    networks = models.network_models() if networks is None else networks
    sampled_networks = networks if sampled_networks is None else sampled_networks

    spark = records.sparkSession
    path = new_work_dir(spark, "predictions")
    notes = Notes()
    keep = ("sample_id", "layer_index", "label", "split", "features")

    def prepared(tag: str, rows: DataFrame) -> tuple[DataFrame, int]:
        n_rows = rows.count()
        width = features.vector_size(rows, "hidden_state_vector")
        split = features.stack_vectors(split_rows(rows, split_by, val_size, test_size, seed))
        ready = training_rows(split.select(*keep), n_rows, 8 * width, cache_bytes)
        notes.sizes += [(tag, r.split, r.label, r.n) for r in sampling.split_sizes(ready).collect()]
        return ready, n_rows

    orders = {name: i for i, name in enumerate([*classical, *sampled_networks], 1)}

    def first_track(scope: tuple[str, DataFrame]) -> None:
        tag, rows = scope
        ready, n_rows = prepared(tag, rows)
        reduced, inp, turn = ready, "features", None
        try:
            if pca_dim:
                base = ready if fit_on == "all" else ready.where("split = 'train'")
                exact = features.vector_size(rows, "hidden_state_vector") <= EXACT_WIDTH
                turn = features.fit_pca(base, pca_dim) if exact else layered.fit_pca_sketch(base, pca_dim)
                notes.explained.append((tag, len(turn.components), features.explained_variance(turn)))
                reduced = training_rows(turn.transform(ready).drop("features"), n_rows, 8 * pca_dim, cache_bytes)
                inp = "pca"
            fit_and_score(reduced, classical, tag, "classical", inp, path, notes, orders, models_dir, select_on, turn)
            fit_and_score(ready, sampled_networks, tag, "network", "features", path, notes, orders, models_dir, select_on)
        finally:
            reduced.unpersist()
            ready.unpersist()

    def layers_together(records: DataFrame) -> None:
        """All layers split, turned and kept in common passes; models that can be are fitted so too, the others layer by layer."""
        layers = sorted(r.layer_index for r in profile.eligible_layers(records).select("layer_index").collect())
        if not layers:
            return
        rows = records.where(F.col("layer_index").isin(layers))
        n_rows, width = rows.count(), features.vector_size(rows, "hidden_state_vector")
        split = features.stack_vectors(split_rows(rows, split_by, val_size, test_size, seed, "layer_index"))
        ready = training_rows(split.select(*keep), n_rows, 8 * width, cache_bytes)
        reduced, inp, turn = ready, "features", None
        try:
            counts = ready.groupBy("layer_index", "split", "label").agg(F.count(F.lit(1)).alias("n")).collect()
            notes.sizes += [(f"layer_{r.layer_index}", r.split, r.label, r.n) for r in counts]
            if pca_dim:
                turn = layered.fit_pca_layers(ready if fit_on == "all" else ready.where("split = 'train'"), pca_dim)
                notes.explained += [(f"layer_{k}", len(m.components), features.explained_variance(m)) for k, m in turn.models.items()]
                reduced = training_rows(turn.transform(ready).drop("features"), n_rows, 8 * pca_dim, cache_bytes)
                inp = "pca"
            together = {name: s for name, s in classical.items() if s.fit_layers}
            alone = {name: s for name, s in classical.items() if not s.fit_layers}
            fit_layers_and_score(reduced, together, layers, inp, path, notes, orders, models_dir, select_on, turn)

            def one(k: int) -> None:
                own = turn and turn.models[k]
                fit_and_score(filter_layer(reduced, k), alone, f"layer_{k}", "classical", inp, path, notes, orders, models_dir, select_on, own)
                fit_and_score(filter_layer(ready, k), sampled_networks, f"layer_{k}", "network", "features", path, notes, orders, models_dir, select_on)

            if alone or sampled_networks:
                at_once(spark, one, layers, parallelism)
        finally:
            reduced.unpersist()
            ready.unpersist()

    def second_track(scope: tuple[str, DataFrame]) -> None:
        tag, rows = f"{scope[0]}_stream", scope[1]
        ready, _ = prepared(tag, rows)
        try:
            names = {name: i for i, name in enumerate(networks, 1)}
            fit_and_score(ready, networks, tag, "nn_streaming", "features", path, notes, names, models_dir, select_on)
        finally:
            ready.unpersist()

    if track in ("auto", "classical"):
        rows = sampling.stratified_sample(records, n_samples=sample_size, seed=seed) if sample_size else records
        if task == "per-layer":
            layers_together(rows)
        else:
            first_track(scopes(rows, task)[0])
    if track in ("auto", "nn-stream"):
        at_once(spark, second_track, scopes(records, task), parallelism)

    if not notes.times:
        raise ValueError("no layer has enough rows of every class, or no model was asked for")
    predictions = spark.read.parquet(path).drop("fit")
    fit_times = spark.createDataFrame(notes.times, "tag string, track string, classifier string, train_time_s double")
    metrics = evaluate.evaluate_splits(predictions, BY).join(F.broadcast(fit_times), ["tag", "track", "classifier"])
    test = predictions.where(F.col("split") == "test")
    results = Results(
        predictions,
        metrics,
        evaluate.best_model(metrics, select_on),
        evaluate.named_rows(evaluate.classification_report(test, BY), LABELS),
        evaluate.named_classes(evaluate.confusion_matrix(predictions, BY), LABELS),
        spark.createDataFrame(notes.log, "tag string, track string, classifier string, epoch int, train_loss double, val_loss double, rate double"),
        spark.createDataFrame(notes.explained, "tag string, n_components int, percent double"),
        spark.createDataFrame(notes.sizes, "tag string, split string, label int, n bigint"),
    )
    if results_dir:
        write_summary(metrics.orderBy("tag", "track", "train_order", "split"), results_dir, task)
        write_report(results.report, results.confusion, results_dir)
    return results


def explain_components(records: DataFrame, k: int = PCA_DIM, vec: str = "hidden_state_vector") -> DataFrame:
    """Explained variance of each component, as rows (component, ratio, percent_so_far)."""
    ratios = features.fit_pca(features.stack_vectors(records, vec), k).ratios
    rows = [(i + 1, float(r), float(100 * ratios[: i + 1].sum())) for i, r in enumerate(ratios)]
    return records.sparkSession.createDataFrame(rows, "component int, ratio double, percent_so_far double")


def chosen(names: Sequence[str], specs: Mapping[str, models.ModelSpec]) -> dict[str, models.ModelSpec]:
    unknown = [n for n in names if n not in specs]
    if unknown:
        raise ValueError(f"unknown models: {unknown}")
    return {n: specs[n] for n in names}
