"""Writing records, summaries, reports and the best model."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actiscope.operators.boosting import BoostedModel
from actiscope.operators.features import PcaModel
from actiscope.operators.layered import LinearModel
from actiscope.operators.minibatch import NetworkModel
from actiscope.operators.models import FeatureModel, NeighborModel
from actiscope.schema import LABELS, MAX_RECORDS_PER_FILE, RECORD_SCHEMA


def write_records(
    records: DataFrame,
    path: str,
    max_records: int = MAX_RECORDS_PER_FILE,
    mode: str = "append",
    by_layer: bool = False,
) -> None:
    """Write the seven columns as Parquet parts of at most ``max_records`` rows.

    Appending never overwrites earlier parts, and parts appear when the job
    commits, so a killed run leaves none behind. The cap is lowered to a multiple
    of the number of labels, so that the variants of one layer state, which come
    one after the other, share a part. ``by_layer`` stores one folder
    per layer for per-layer reads; the rows are then rebalanced first, which
    splits large layers over several tasks.
    """
    rows = records.select(*RECORD_SCHEMA.names)
    if by_layer:
        rows = rows.hint("rebalance", F.col("layer_index"))
    cap = max_records - max_records % len(LABELS) or max_records
    writer = rows.write.mode(mode).option("maxRecordsPerFile", cap)
    if by_layer:
        writer = writer.partitionBy("layer_index")
    writer.parquet(path)


def write_summary(summary: DataFrame, path: str, task: str, mode: str = "overwrite") -> str:
    """One CSV with a row per model, split and tag; returns its folder."""
    folder = f"{path.rstrip('/')}/summary_{task}"
    summary.coalesce(1).write.mode(mode).option("header", True).csv(folder)
    return folder


def write_report(report: DataFrame, matrix: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Classification report and confusion matrix as Parquet tables."""
    report.write.mode(mode).parquet(f"{path.rstrip('/')}/report")
    matrix.write.mode(mode).parquet(f"{path.rstrip('/')}/confusion")


def _best_meta(spark: SparkSession, folder: str) -> dict | None:
    """The highest version among the complete ones; each is a folder of its own that is never written twice."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.text(f"{folder}/best_meta_*").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return max((json.loads(r[0]) for r in rows), key=lambda meta: meta["version"], default=None)


LOADERS = {kind.__name__: kind.load for kind in (BoostedModel, FeatureModel, LinearModel, NeighborModel, NetworkModel)}

# The names under which the kept model is described.
META = ("classifier", "tag", "f1_weighted", "model_file", "is_nn")


def save_best_model(spark: SparkSession, model, name: str, tag: str, f1: float, is_nn: bool, models_dir: str, components=None) -> bool:
    """Save a model and its metadata when its F1 beats the one kept for the tag.

    ``components`` are those its input is turned by, if any, and are saved next to it. The
    metadata is written last, under a new name, and names the model folder, so a run that
    dies in between leaves the earlier model in force. A folder that such a run left is written over.
    """
    folder = f"{models_dir.rstrip('/')}/{tag}"
    kept = _best_meta(spark, folder)
    if kept is not None and kept["f1_weighted"] >= f1:
        return False
    version = (kept or {}).get("version", 0) + 1
    model_file = f"best_model_{name}_{version}"
    kind = type(model).__name__ if type(model).__name__ in LOADERS else "PipelineModel"
    saved = PipelineModel([model]) if kind == "PipelineModel" else model
    saved.write().overwrite().save(f"{folder}/{model_file}/model")
    if components is not None:
        components.save(spark, f"{folder}/{model_file}/components")
    meta = dict(zip(META, (name, tag, float(f1), model_file, bool(is_nn)))) | {"version": version, "kind": kind, "components": components is not None}
    row = spark.range(1).select(F.lit(json.dumps(meta)).alias("value"))
    row.write.mode("overwrite").text(f"{folder}/best_meta_{version}")
    return True


class BestModel:
    """A kept model with the components its input is turned by: ``transform`` scores rows of (features)."""

    def __init__(self, meta: dict, model, components=None):
        self.meta, self.model, self.components = meta, model, components

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self.components.transform(df) if self.components else df)


def load_best_model(spark: SparkSession, tag: str, models_dir: str) -> BestModel:
    """The model kept for a tag, ready to score new records."""
    folder = f"{models_dir.rstrip('/')}/{tag}"
    meta = _best_meta(spark, folder)
    if meta is None:
        raise FileNotFoundError(f"no model is kept for {tag} in {models_dir}")
    path = f"{folder}/{meta['model_file']}"
    model = LOADERS.get(meta["kind"], lambda _, at: PipelineModel.load(at))(spark, f"{path}/model")
    return BestModel(meta, model, PcaModel.load(spark, f"{path}/components") if meta["components"] else None)


def best_meta(spark: SparkSession, tag: str, models_dir: str) -> dict | None:
    return _best_meta(spark, f"{models_dir.rstrip('/')}/{tag}")
