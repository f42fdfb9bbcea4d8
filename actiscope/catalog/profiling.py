"""Counts over the built records."""

from __future__ import annotations

from pyspark.sql import functions as F

from actiscope.catalog import load, query
from actiscope.catalog.fixtures import RECORD_KEYS, STATES, records
from actiscope.operators import profile, sampling
from actiscope.schema import LABELS


@query(
    "record_counts",
    "select count(*) as n_records, min(len(embedding))::int as min_dim, max(len(embedding))::int as max_dim, 1::bigint as n_files from embeddings",
)
def record_counts(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings").select("embedding", F.col("_metadata.file_path").alias("file"))
    return profile.record_counts(rows, "embedding", "file")


@query("distinct_layers", f"with {STATES} select distinct l as layer_index from states")
def distinct_layers(spark, sf_dir):
    return profile.distinct_layers(records(spark, sf_dir))


@query("class_names", f"with {RECORD_KEYS} select distinct t as label, name as label_name from keys")
def class_names(spark, sf_dir):
    return profile.class_names(records(spark, sf_dir))


@query(
    "label_distribution",
    """with c as (select event_type, count(*) as n from events group by 1)
    select event_type, n, round(n / sum(n) over (), 9) as share from c""",
)
def label_distribution(spark, sf_dir):
    result = profile.label_distribution(load(spark, sf_dir, "events"), "event_type")
    return result.withColumn("share", F.round("share", 9))


@query(
    "layer_label_pivot",
    f"with {RECORD_KEYS} select l as layer_index, "
    + ", ".join(f"nullif(count(*) filter (t = {k}), 0) as {v}" for k, v in LABELS.items())
    + " from keys group by l",
)
def layer_label_pivot(spark, sf_dir):
    return profile.layer_label_pivot(records(spark, sf_dir))


@query(
    "eligible_layers",
    """with c as (select (vec_id % 9)::int as layer_index, label, count(*) as n from embeddings group by 1, 2)
    select layer_index, sum(n)::bigint as n_rows, count(*) as n_labels, min(n) as smallest
    from c group by 1 having min(n) >= 3""",
)
def eligible_layers(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings").select(F.expr("cast(vec_id % 9 as int)").alias("layer_index"), "label")
    return profile.eligible_layers(rows)


@query("n_classes", "select max(label) + 1 as n_classes from embeddings")
def n_classes(spark, sf_dir):
    return profile.n_classes(load(spark, sf_dir, "embeddings"))


@query(
    "sample_share",
    """with c as (select event_type, count(*) as n from events group by 1), t as (select sum(n)::bigint as n from c),
    s as (select sum(round_even(2500::double / t.n * c.n, 0))::bigint as k from c cross join t)
    select k as n_sampled, t.n as n_total, round(100 * k / t.n, 9) as percent from s cross join t
    where t.n > 2500
    union all select n, n, 100::double from t where n <= 2500""",
)
def sample_share(spark, sf_dir):
    rows = load(spark, sf_dir, "events")
    sample = sampling.stratified_sample(rows, "event_id", "event_type", 2500)
    return profile.sample_share(rows, sample).withColumn("percent", F.round("percent", 9))
