"""Vectors as features."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from actiscope.catalog import load, query
from actiscope.catalog.fixtures import positions
from actiscope.functions import vectors
from actiscope.operators import features
from actiscope.plans.classify import explain_components

LONG = "p as (select vec_id, (generate_subscripts(embedding, 1) - 1)::int as i, unnest(embedding)::double as x from embeddings)"
# One kernel of width 7, and the width of a test token.
KERNEL = [0.1, -0.2, 0.3, 0.4, -0.3, 0.2, -0.1]
KERNELS = [KERNEL, [0.0, 0.5, 0.0, -1.0, 0.0, 0.5, 0.0]]
WIDTH = 16


def _features(spark, sf_dir):
    return features.stack_vectors(load(spark, sf_dir, "embeddings"), "embedding")


@query("stack_vectors", f"with {LONG} select vec_id, i, round(x, 9) + 0 as value from p")
def stack_vectors(spark, sf_dir):
    rows = features.unstack(_features(spark, sf_dir), "features", "back")
    return positions(rows, "back", "vec_id", digits=9)


@query(
    "standard_scale",
    f"""with {LONG}, s as (select i, avg(x) as mu, stddev_pop(x) as sd from p group by i)
    select vec_id, p.i, round((x - mu) / sd, 6) + 0 as value from p join s on p.i = s.i""",
)
def standard_scale(spark, sf_dir):
    rows = _features(spark, sf_dir)
    scaled = features.fit_scaler(rows).transform(rows)
    return positions(features.unstack(scaled, "scaled", "back"), "back", "vec_id", digits=6)


@query(
    "covariance",
    f"""with {LONG} select a.i, b.i as j, round(covar_pop(a.x, b.x), 9) + 0 as covariance
    from p a join p b on a.vec_id = b.vec_id and b.i <= a.i group by a.i, b.i""",
)
def covariance(spark, sf_dir):
    cells = features.covariance(load(spark, sf_dir, "embeddings"), "embedding")
    return cells.withColumn("covariance", F.round("covariance", 9) + F.lit(0.0))


@query(
    "pca_fit",
    f"""with {LONG} select a.i, b.i as j, round(covar_pop(a.x, b.x), 6) + 0 as covariance
    from p a join p b on a.vec_id = b.vec_id and b.i <= a.i group by a.i, b.i""",
)
def pca_fit(spark, sf_dir):
    """All components with their variances, put together again: the covariance."""
    model = features.fit_pca(_features(spark, sf_dir), 1 << 16)
    whole = (model.components.T * model.variances) @ model.components
    rows = [(i, j, round(float(whole[i, j]), 6) + 0.0) for i in range(len(whole)) for j in range(i + 1)]
    return spark.createDataFrame(rows, "i int, j int, covariance double")


@query(
    "pca_uncorrelated",
    f"with {LONG}, d as (select distinct i from p) select a.i, b.i as j, 0.0::double as covariance, true as ordered from d a join d b on b.i < a.i",
)
def pca_uncorrelated(spark, sf_dir):
    """Scores on different components are uncorrelated, and earlier ones vary no less."""
    rows = _features(spark, sf_dir)
    scores = features.fit_pca(rows).transform(rows).select(vector_to_array("pca").alias("z"))
    cells = features.covariance(scores, "z")
    own = cells.where("i = j").select(F.col("i").alias("k"), F.col("covariance").alias("variance"))
    pairs = cells.where("j < i").join(F.broadcast(own.toDF("i", "vi")), "i").join(F.broadcast(own.toDF("j", "vj")), "j")
    return pairs.select("i", "j", (F.round("covariance", 9) + F.lit(0.0)).alias("covariance"), (F.col("vj") >= F.col("vi")).alias("ordered"))


@query(
    "pca_transform",
    f"""with {LONG}, s as (select i, avg(x) as mu from p group by i)
    select vec_id, round(sum((x - mu) * (x - mu)), 6) as energy from p join s on p.i = s.i group by vec_id""",
)
def pca_transform(spark, sf_dir):
    """With every component kept, the squared scores add up to the distance from the mean."""
    rows = _features(spark, sf_dir)
    scores = features.fit_pca(rows).transform(rows).select("vec_id", vector_to_array("pca").alias("z"))
    energy = F.expr(vectors.total("transform(z, x -> x * x)"))
    return scores.select("vec_id", F.round(energy, 6).alias("energy"))


@query(
    "explained_variance",
    f"""with {LONG}, v as (select i, var_pop(x) as v from p group by i)
    select count(*)::int as n_components, 100.0::double as percent, round(sum(v), 9) as total from v""",
)
def explained_variance(spark, sf_dir):
    """All components explain everything, and what they explain adds up to the variance of all values."""
    rows = load(spark, sf_dir, "embeddings")
    shares = explain_components(rows, 1 << 16, "embedding").orderBy("component").collect()
    total = float(features.fit_pca(features.stack_vectors(rows, "embedding"), 1).variances.sum())
    row = (len(shares), round(shares[-1].percent_so_far, 6), round(total, 9))
    return spark.createDataFrame([row], "n_components int, percent double, total double")


def _conv_sql(k: int) -> str:
    weights = "[" + ", ".join(f"{w}::double" for w in KERNELS[k]) + "]"
    return f"""select vec_id, {k} as kernel, steps.t, sum(x * {weights}[p.i - 2 * steps.t + 4]) as r
    from p join steps on p.i between 2 * steps.t - 3 and 2 * steps.t + 3 group by vec_id, steps.t"""


CONV = f"""with {LONG}, steps as (select unnest(range(0, (select (max(i) + 1 + 6 - 7) // 2 + 1 from p))) as t),
    responses as ({_conv_sql(0)} union all {_conv_sql(1)})
    select vec_id, kernel as i, round(avg(greatest(r, 0)), 9) + 0 as value from responses group by vec_id, kernel"""


@query("conv_features", CONV)
def conv_features(spark, sf_dir):
    rows = features.conv_features(load(spark, sf_dir, "embeddings"), KERNELS, "embedding")
    return positions(rows, "conv", "vec_id", digits=9)


@query("conv_features_arrow", CONV)
def conv_features_arrow(spark, sf_dir):
    rows = features.conv_features_arrow(load(spark, sf_dir, "embeddings"), KERNELS, "embedding")
    return positions(rows, "conv", "vec_id", digits=9)


@query(
    "chunk_tokens",
    f"with {LONG} select vec_id, (i % {WIDTH})::int as i, round(avg(x), 9) + 0 as value from p group by vec_id, i % {WIDTH}",
)
def chunk_tokens(spark, sf_dir):
    rows = features.chunk_tokens(load(spark, sf_dir, "embeddings"), WIDTH, "embedding")
    return positions(rows, "pooled", "vec_id", digits=9)
