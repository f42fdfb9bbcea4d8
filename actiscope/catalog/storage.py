"""Writing, reading back, resuming and streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from actiscope.catalog import load, query
from actiscope.catalog.evaluation import METRICS, REPORT, predictions
from actiscope.catalog.fixtures import ALL_VARIANTS, MODEL, RECORD_KEYS, STATES, layer_states, records
from actiscope.catalog.generation import RECORD_SUMS, record_sums
from actiscope.functions import vectors
from actiscope.operators import evaluate
from actiscope.plans.generate import build_records
from actiscope.schema import SEED
from actiscope.session import new_work_dir
from actiscope.sources import tables
from actiscope.sources.records import (
    cached_records,
    fetch_rows,
    filter_layer,
    row_locator,
    sample_records,
    scan_labels,
    scan_records,
)
from actiscope.sources.sinks import write_records, write_report, write_summary
from actiscope.streaming.incremental import pending_states, resume_generation, stream_generation, streamed_records


def _written(spark, sf_dir, max_records=500):
    sink = new_work_dir(spark, "records")
    write_records(records(spark, sf_dir), sink, max_records)
    return sink


@query("scan_records", RECORD_SUMS)
def scanned(spark, sf_dir):
    return record_sums(scan_records(spark, _written(spark, sf_dir)))


@query("scan_labels", f"with {RECORD_KEYS} select t as label, l as layer_index, count(*) as n from keys group by 1, 2")
def labels_only(spark, sf_dir):
    return scan_labels(spark, _written(spark, sf_dir)).groupBy("label", "layer_index").agg(F.count(F.lit(1)).alias("n"))


@query(
    "row_locator",
    f"""with {ALL_VARIANTS}
    select printf('%05d_L%03d_T%d', g, l, t) as sample_id, t as label, round(sum(v::double), 5) + 0 as total
    from variants where l = 3 group by g, l, t""",
)
def located(spark, sf_dir):
    """Find the addresses of one layer, then fetch those rows."""
    sink = _written(spark, sf_dir)
    rows = fetch_rows(spark, sink, row_locator(spark, sink, 3))
    total = F.round(F.expr(vectors.total("hidden_state_vector")), 5) + F.lit(0.0)
    return rows.select("sample_id", "label", total.alias("total"))


@query(
    "cached_records",
    f"""with {ALL_VARIANTS}, n as (select g, l, t, sqrt(sum(v::double * v::double)) as norm from variants group by g, l, t)
    select l as layer_index, t as label, count(*) as n, round(avg(norm), 6) as mean_norm from n group by 1, 2""",
)
def cached(spark, sf_dir):
    rows = cached_records(scan_records(spark, _written(spark, sf_dir)))
    norm = F.sqrt(F.expr(vectors.total("transform(hidden_state_vector, x -> cast(x as double) * x)")))
    return rows.groupBy("layer_index", "label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(norm), 6).alias("mean_norm"))


@query(
    "sample_records",
    f"""with {ALL_VARIANTS},
    k as (select printf('%05d_L%03d_T%d', g, l, t) as id, t as y, round(sum(v::double), 5) + 0 as total
          from variants group by g, l, t),
    c as (select y, count(*) as n from k group by y), s as (select sum(n) as tot from c),
    r as (select *, row_number() over (partition by y order by md5(concat_ws('|', '{SEED}', id)), id) as rn from k)
    select id as sample_id, r.y as label, total from r join c on r.y = c.y cross join s
    where tot <= 700 or rn <= round_even(700::double / tot * n, 0)""",
)
def sampled(spark, sf_dir):
    """Seven hundred records drawn by address, then fetched."""
    rows = sample_records(spark, _written(spark, sf_dir), 700)
    total = F.round(F.expr(vectors.total("hidden_state_vector")), 5) + F.lit(0.0)
    return rows.select("sample_id", "label", total.alias("total"))


@query("filter_layer", f"with {RECORD_KEYS} select id as sample_id, t as label from keys where l = 5")
def one_layer(spark, sf_dir):
    return filter_layer(scan_records(spark, _written(spark, sf_dir)), 5).select("sample_id", "label")


@query(
    "write_records",
    f"with {RECORD_KEYS} select count(*) as n_records, 0::bigint as n_parts_over_limit, true as has_parts from keys",
)
def bounded_parts(spark, sf_dir):
    sink = _written(spark, sf_dir, 100)
    parts = scan_records(spark, sink, locate=True).groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
    return parts.agg(
        F.sum("n").alias("n_records"),
        F.count_if(F.col("n") > 100).alias("n_parts_over_limit"),
        (F.count(F.lit(1)) * 100 >= F.sum("n")).alias("has_parts"),
    )


@query(
    "pending_states",
    f"""with {STATES} select g as instruction_id, l as layer_index from states
    where g not in (select doc_id from labels)""",
)
def pending(spark, sf_dir):
    """Labelled documents play the instructions that are done."""
    done = load(spark, sf_dir, "labels").select(F.col("doc_id").cast("int").alias("instruction_id"))
    return pending_states(layer_states(spark, sf_dir), done).select("instruction_id", "layer_index")


@query("resume_generation", RECORD_SUMS)
def resumed(spark, sf_dir):
    """A first run that saw only the labelled documents and left a layer and a label of them out, then two more over everything."""
    states, sink = layer_states(spark, sf_dir), new_work_dir(spark, "records")
    seen = load(spark, sf_dir, "labels").select(F.col("doc_id").cast("int").alias("instruction_id"))
    first = build_records(states.join(seen.distinct(), "instruction_id", "left_semi"), MODEL)
    write_records(first.where("layer_index != 5 and not (layer_index = 3 and label = 2)"), sink)
    resume_generation(states, sink, MODEL)
    resume_generation(states, sink, MODEL)
    return record_sums(scan_records(spark, sink))


@query("resume_table", RECORD_SUMS)
def resumed_table(spark, sf_dir):
    """The same in a bucketed table, whose side of the joins isn't shuffled."""
    states, table = layer_states(spark, sf_dir), f"records_{uuid.uuid4().hex}"
    folder = new_work_dir(spark, "table")
    first = build_records(states.where("instruction_id % 3 = 0"), MODEL)
    tables.write_table(first.where("layer_index != 5 and not (layer_index = 3 and label = 2)"), table, 8, path=folder)
    for _ in range(2):
        tables.resume_table(states, table, 8, MODEL)
    return record_sums(tables.scan_table(spark, table))


@query("resume_stream", f"select * from ({RECORD_SUMS}) where instruction_id % 5 <> 2")
def streamed(spark, sf_dir):
    """Files that split every instruction, of which some have a bad layer in the later file; a second delivery adds nothing."""
    source, sink, checkpoint = (new_work_dir(spark, p) for p in ("arriving", "records", "stream"))
    cut = F.expr("case when instruction_id % 5 = 2 and layer_index = (instruction_id % 8) then slice(output_vec, 1, 3) else output_vec end")
    # The last instruction may lack the layer that is cut; its first layer stands in for it.
    states = layer_states(spark, sf_dir)
    last = states.agg(F.max("instruction_id")).first()[0]
    states = states.withColumn("output_vec", F.when((F.col("instruction_id") == last) & (F.col("layer_index") == 0) & (F.lit(last) % 5 == 2), F.slice("output_vec", 1, 3)).otherwise(cut))
    for part in ("layer_index < 3", "layer_index >= 3", "layer_index >= 0"):
        states.where(part).write.mode("append").parquet(source)
        stream_generation(spark, source, sink, checkpoint, MODEL)
    return record_sums(streamed_records(spark, sink))


@query("write_summary", METRICS)
def summary_file(spark, sf_dir):
    metrics = evaluate.evaluate_splits(predictions(spark, sf_dir))
    folder = write_summary(metrics, new_work_dir(spark, "results"), "cross-layer")
    kinds = "tag string, classifier string, split string, accuracy double, f1_weighted double, f1_macro double, n_rows bigint"
    rows = spark.read.schema(kinds).option("header", True).csv(folder)
    return rows.select(
        "tag", "classifier", "split", *[F.round(c, 9).alias(c) for c in ("accuracy", "f1_weighted", "f1_macro")], "n_rows"
    )


@query("write_report", REPORT)
def report_files(spark, sf_dir):
    scored, folder = predictions(spark, sf_dir), new_work_dir(spark, "results")
    write_report(evaluate.classification_report(scored), evaluate.confusion_matrix(scored), folder)
    rows = spark.read.parquet(f"{folder}/report")
    return rows.select(
        "tag", "classifier", "split", "row", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support"
    )
