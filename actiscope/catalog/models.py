"""Models fitted and scored on vectors whose class is plain to see.

Fits run at their default settings but for those a docstring names. The class of a plain
vector is told by the signs of its first two values, which stand for half of its values, so every
model must find it for every row it hasn't seen; that is what the SQL asks.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actiscope.catalog import load, query
from actiscope.catalog.features import LONG
from actiscope.catalog.sampling import SPLIT_QUOTAS
from actiscope.operators import features, hashing, models, neighbors, sampling
from actiscope.plans.classify import run_classification
from actiscope.schema import RECORD_SCHEMA, SEED
from actiscope.session import new_work_dir, stored
from actiscope.sources.records import scan_records, training_rows
from actiscope.sources.sinks import load_best_model, save_best_model, write_records

LAYERS = 2


def _plain(spark, sf_dir):
    """Vectors with the class their first two signs tell: seven tenths to train on, one to validate, two to test."""
    rows = load(spark, sf_dir, "embeddings")
    sign = lambda i: F.when(F.get("embedding", i % 2) > 0, 3.0).otherwise(-3.0)
    moved = F.transform("embedding", lambda x, i: F.when(i < 32, sign(i)).otherwise(x))
    label = (F.col("embedding")[0] > 0).cast("int") + 2 * (F.col("embedding")[1] > 0).cast("int")
    split = F.expr("case when vec_id % 10 > 2 then 'train' when vec_id % 10 = 2 then 'val' else 'test' end")
    rows = rows.select(F.col("vec_id").alias("sample_id"), label.alias("label"), split.alias("split"), moved.alias("v"))
    return training_rows(features.stack_vectors(rows, "v").drop("v"), rows.count(), 8 * 64)


PLAIN = """select vec_id, (embedding[1] > 0)::int + 2 * (embedding[2] > 0)::int as y_pred
    from embeddings where vec_id % 10 <= 2"""


def _named(names):
    return f"select * from ({PLAIN}) cross join (select unnest({names!r}) as classifier)"


def _found(rows, model):
    scored = model.transform(rows.where("split != 'train'"))
    return scored.select(F.col("sample_id").alias("vec_id"), F.col("prediction").cast("int").alias("y_pred"))


def _fit(spark, sf_dir, fit, **settings):
    rows = _plain(spark, sf_dir)
    return _found(rows, fit(rows.where("split = 'train'"), **settings))


def _fit_each(spark, sf_dir, fit, names):
    rows = _plain(spark, sf_dir)
    train = rows.where("split = 'train'")
    return reduce(DataFrame.union, [_found(rows, fit(train, name=n)).withColumn("classifier", F.lit(n)) for n in names])


@query("fit_logreg", PLAIN)
def fit_logreg(spark, sf_dir):
    return _fit(spark, sf_dir, models.fit_logreg)


@query("fit_forest", PLAIN)
def fit_forest(spark, sf_dir):
    return _fit(spark, sf_dir, models.fit_forest)


@query("fit_boosted", PLAIN)
def fit_boosted(spark, sf_dir):
    return _fit(spark, sf_dir, models.fit_boosted)


@query("fit_svm", PLAIN)
def fit_svm(spark, sf_dir):
    return _fit(spark, sf_dir, models.fit_svm)


@query("fit_mlp", _named(list(models.MLP_WIDTHS)))
def fit_mlp(spark, sf_dir):
    """All seven widths, with validation rows for the stop rule."""
    rows = _plain(spark, sf_dir)
    train, val = (rows.where(F.col("split") == s) for s in ("train", "val"))
    parts = [_found(rows, models.fit_widths(train, name, val=val)).withColumn("classifier", F.lit(name)) for name in models.MLP_WIDTHS]
    return reduce(DataFrame.union, parts)


@query("fit_conv", _named(list(models.CONV_STAGES)))
def fit_conv(spark, sf_dir):
    return _fit_each(spark, sf_dir, models.fit_conv, list(models.CONV_STAGES))


@query("fit_early_stop", PLAIN)
def fit_early_stop(spark, sf_dir):
    """The best epoch of a network under the default stop rule."""
    rows = _plain(spark, sf_dir)
    train, val = (rows.where(F.col("split") == s) for s in ("train", "val"))
    return _found(rows, models.fit_early_stop(train, val, "MLP_Tiny", steps_per_epoch=5, solver="l-bfgs")[0])


EMBEDDINGS = f"""emb as (select vec_id as id, label as y, md5(concat_ws('|', '{SEED}', vec_id)) as h from embeddings),
    k as (select id, y, h from emb),{SPLIT_QUOTAS}"""

NEIGHBORS = f"""with {EMBEDDINGS}, {LONG},
    sc as (select i, avg(x) as mu, stddev_pop(x) as sd from p join split_rows r on p.vec_id = r.id
          where split = 'train' group by i),
    v as (select p.vec_id, list((x - mu) / sd order by p.i) as v from p join sc on p.i = sc.i group by p.vec_id),
    near as (select a.id as query_id, b.id as base_id, b.y as label,
                    round(list_sum(list_transform(list_zip(va.v, vb.v), lambda e: (e[1] - e[2]) * (e[1] - e[2]))), 9) as d
             from split_rows a join v va on va.vec_id = a.id
                  cross join split_rows b join v vb on vb.vec_id = b.id
             where a.split <> 'train' and b.split = 'train'),
    ranked as (select *, row_number() over (partition by query_id order by d, base_id)::int as rank from near),
    top as (select query_id, base_id, label, round(d, 6) as distance2, rank from ranked where rank <= 5)"""


def _neighbor_inputs(spark, sf_dir):
    rows = sampling.stratified_split(load(spark, sf_dir, "embeddings"), "vec_id")
    rows = features.stack_vectors(rows, "embedding").cache()  # split and scaled once for both sides
    train = rows.where("split = 'train'")
    scaled = features.unstack(features.fit_scaler(train).transform(rows), "scaled", "v").select("vec_id", "label", "split", "v")
    return scaled.where("split != 'train'"), scaled.where("split = 'train'")


@query("nearest_neighbors", f"{NEIGHBORS} select * from top")
def nearest_neighbors(spark, sf_dir):
    queries, base = _neighbor_inputs(spark, sf_dir)
    near = neighbors.nearest_neighbors(queries, base, 5, "vec_id", "v", "label")
    return near.withColumn("distance2", F.round("distance2", 6))


@query("hashed_neighbors", f"{NEIGHBORS} select * from top")
def hashed_neighbors(spark, sf_dir):
    """Through a hash table of which every bucket is looked into, so that the result must be the exact one; buckets hold 64 rows."""
    queries, base = _neighbor_inputs(spark, sf_dir)
    tables = hashing.fit_tables(base, 5, 0.95, "vec_id", "v", bucket_rows=64)
    near = hashing.hashed_neighbors(queries, base, tables.first(1, 1 << tables.bits, None), 5, "vec_id", "v", "label")
    return near.withColumn("distance2", F.round("distance2", 6))


@query(
    "neighbor_recall",
    f"{NEIGHBORS} select count(*) as n_exact, true as enough from top",
)
def neighbor_recall(spark, sf_dir):
    """Whether tables fitted for a recall of 0.95 find nine tenths of the exact neighbours."""
    queries, base = _neighbor_inputs(spark, sf_dir)
    exact = stored(neighbors.nearest_neighbors(queries, base, 5, "vec_id", "v", "label"), "exact")
    found = hashing.hashed_neighbors(queries, base, hashing.fit_tables(base, 5, 0.95, "vec_id", "v", bucket_rows=256), 5, "vec_id", "v", "label")
    hit = found.select("query_id", "base_id", F.lit(1).alias("hit"))
    pairs = exact.select("query_id", "base_id").join(hit, ["query_id", "base_id"], "left")
    return pairs.agg(F.count(F.lit(1)).alias("n_exact"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("enough"))


@query(
    "knn_classify",
    f"""{NEIGHBORS}, votes as (select query_id, label, count(*) as n from top group by 1, 2)
    select query_id, y_pred from (
      select query_id, label as y_pred, row_number() over (partition by query_id order by n desc, label) as place from votes)
    where place = 1""",
)
def knn_classify(spark, sf_dir):
    queries, base = _neighbor_inputs(spark, sf_dir)
    return neighbors.knn_classify(queries, base, 5, id_col="vec_id", vec="v", label="label")


@query(
    "batch_predict",
    f"""with {LONG}, c as (select label as y, p.i, avg(x) as mu from p join embeddings using (vec_id) group by 1, 2),
    s as (select vec_id, y, sum(2 * x * mu - mu * mu) as score from p join c on p.i = c.i group by vec_id, y)
    select vec_id, y as prediction from (
      select vec_id, y, row_number() over (partition by vec_id order by score desc, y) as place from s) where place = 1""",
)
def batch_predict(spark, sf_dir):
    """Nearest class mean as a linear model kept outside Spark."""
    rows = load(spark, sf_dir, "embeddings")
    vector = array_to_vector(F.col("embedding").cast("array<double>"))
    means = rows.groupBy("label").agg(Summarizer.mean(vector).alias("centre")).orderBy("label").collect()  # one row per class
    centres = np.array([r.centre.toArray() for r in means])
    scorer = models.linear_scorer(2 * centres, -(centres * centres).sum(axis=1))
    return models.batch_predict(rows, scorer, "embedding").select("vec_id", "prediction")


def _registry():
    return [*models.classical_models(SVM={}).values(), *models.network_models().values()]


def _registry_sql():
    rows = []
    for i, spec in enumerate(_registry(), 1):
        w = models.MLP_WIDTHS.get(spec.name)
        inner = "null" if w is None else f"(d + 1) * {w[0]} + {sum((a + 1) * b for a, b in zip(w, w[1:]))} + ({w[-1]} + 1) * k"
        rows.append(f"select {i} as train_order, '{spec.name}' as classifier, '{spec.family}' as family, ({inner})::bigint as n_weights from s")
    return "with s as (select max(len(embedding)) as d, max(label) + 1 as k from embeddings) " + " union all ".join(rows)


@query("model_registry", _registry_sql())
def model_registry(spark, sf_dir):
    """Every model in training order, with the weights that networks take for the vectors and classes of the data."""
    d, k = load(spark, sf_dir, "embeddings").agg(F.max(F.size("embedding")), F.max("label") + 1).first()
    rows = [
        (i, s.name, s.family, models.n_weights(models.network_layers(s.name, d, k)) if s.name in models.MLP_WIDTHS else None)
        for i, s in enumerate(_registry(), 1)
    ]
    return spark.createDataFrame(rows, "train_order int, classifier string, family string, n_weights bigint")


def _plain_records(spark, sf_dir):
    """Records of plain vectors in two layers, written and scanned like any stored set.

    The second sign's values are made smaller than the first's, so that the components of the two don't mix.
    """
    smaller = F.transform(vector_to_array("features"), lambda x, i: F.when((i < 32) & (i % 2 == 1), x * 2 / 3).otherwise(x))
    rows = _plain(spark, sf_dir).select("sample_id", "label", smaller.cast("array<float>").alias("hidden_state_vector"))
    made = rows.select(
        F.col("sample_id").cast("string").alias("sample_id"), F.lit("m").alias("model_name"), F.col("sample_id").cast("int").alias("instruction_id"),
        (F.col("sample_id") % LAYERS).cast("int").alias("layer_index"), "label", F.lit("").alias("label_name"), "hidden_state_vector",
    )
    sink = new_work_dir(spark, "plain")
    write_records(made.select([F.col(f.name).cast(f.dataType) for f in RECORD_SCHEMA]), sink, by_layer=True)
    return scan_records(spark, sink)


def _scored_rows(tag: str, track: str, names: list[str], where: str = "true") -> str:
    """What each model of a scope must reach on plain vectors: every row of validation and test found."""
    return f"""(with k as (select vec_id as id, (embedding[1] > 0)::int + 2 * (embedding[2] > 0)::int as y, md5(concat_ws('|', '{SEED}', vec_id)) as h
        from embeddings where {where}),{SPLIT_QUOTAS}
    select '{tag}' as tag, '{track}' as track, classifier, split, count(*) as n_rows, 1.0::double as accuracy, 1.0::double as f1_weighted, 1.0::double as f1_macro
    from split_rows cross join (select unnest({names!r}) as classifier) where split <> 'train' group by all)"""


CLASSICAL = list(models.classical_models())
TOKENS = 32
TOLD = 2
"""Components that tell the plain classes apart. Neighbours are told by scaled components, so others, which are noise here, would weigh as much."""


def _scores(metrics):
    rounded = [F.round(c, 9).alias(c) for c in ("accuracy", "f1_weighted", "f1_macro")]
    return metrics.select("tag", "track", "classifier", "split", "n_rows", *rounded)


@query("fit_cross_layer", f"select * from {_scored_rows('cross_layer', 'classical', CLASSICAL)}")
def fit_cross_layer(spark, sf_dir):
    """All classical models over all layers, on the two components that hold what tells the classes apart."""
    return _scores(run_classification(_plain_records(spark, sf_dir), track="classical", sampled_networks={}, pca_dim=TOLD).metrics)


@query("fit_per_layer", " union all ".join(_scored_rows(f"layer_{i}", "classical", CLASSICAL, f"vec_id % {LAYERS} = {i}") for i in range(LAYERS)))
def fit_per_layer(spark, sf_dir):
    """All classical models for each layer; layers share the passes of their components and regressions."""
    return _scores(run_classification(_plain_records(spark, sf_dir), task="per-layer", track="classical", sampled_networks={}, pca_dim=TOLD).metrics)


STREAMED = list(models.network_models())


@query(
    "run_tracks",
    f"{_scored_rows('cross_layer', 'classical', CLASSICAL)} union all {_scored_rows('cross_layer_stream', 'nn_streaming', STREAMED)}",
)
def run_tracks(spark, sf_dir):
    """Both tracks on one set of records, all classical models and all networks, the best ones kept. Tokens are of 32 values."""
    results = run_classification(
        _plain_records(spark, sf_dir),
        pca_dim=TOLD,
        networks=models.network_models(token_width=TOKENS),
        sampled_networks={},
        models_dir=new_work_dir(spark, "models"),
        results_dir=new_work_dir(spark, "results"),
    )
    return _scores(results.metrics)


@query("save_best_model", f"select *, 'long' as classifier from ({PLAIN})")
def save_best(spark, sf_dir):
    """A bad fit, a good one and a bad one again; the one that was kept is read back, with its components, and scores."""
    rows, folder = _plain(spark, sf_dir), new_work_dir(spark, "models")
    turn = features.fit_pca(rows.where("split = 'train'"), 16)
    turned = turn.transform(rows)
    for name, rounds, f1 in (("short", 1, 0.4), ("long", 1000, 1.0), ("later", 1, 0.5)):
        model = models.fit_logreg(turned.where("split = 'train'"), "pca", max_iter=rounds)
        save_best_model(spark, model, name, "cross_layer", f1, False, folder, turn)
    kept = load_best_model(spark, "cross_layer", folder)
    return _found(rows, kept).withColumn("classifier", F.lit(kept.meta["classifier"]))
