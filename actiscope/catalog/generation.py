"""Guards, generators and the record builder."""

from __future__ import annotations

from pyspark.sql import functions as F

from actiscope.catalog import load, query
from actiscope.catalog.fixtures import ALL_VARIANTS, MODEL, RECORD_KEYS, STATES, layer_states, positions, records
from actiscope.functions import vectors
from actiscope.operators import guards, variant_table, variants
from actiscope.plans.generate import assemble_records, build_records, drift_summary, run_totals, write_counted
from actiscope.schema import SEED
from actiscope.session import new_work_dir
from actiscope.sources.layer_states import token_states_from_vectors

KEYS = ("instruction_id", "layer_index")


@query(
    "variant_drift",
    f"""with {ALL_VARIANTS},
    gaps as (select v.g, v.l, v.t, sqrt(sum((v.v::double - p.ov::double) * (v.v::double - p.ov::double))) as gap
             from variants v join positions p on v.g = p.g and v.l = p.l and v.j = p.j group by v.g, v.l, v.t)
    select l as layer_index, t as label, name as label_name, count(*) as n, round(avg(gap), 6) as mean_l2
    from gaps join labels_named using (t) group by l, t, name""",
)
def variant_drift(spark, sf_dir):
    """Flagship: guard, expand and compare each variant with the honest output."""
    drift = drift_summary(layer_states(spark, sf_dir))
    return drift.withColumn("mean_l2", F.round("mean_l2", 6))


def _values_sql(label: int) -> str:
    return f"""with {ALL_VARIANTS}
    select g as instruction_id, l as layer_index, j::int as i, round(v::double, 6) + 0 as value
    from variants where t = {label}"""


def _one(spark, sf_dir, label):
    states = layer_states(spark, sf_dir)
    expanded = variants.expand(states, generators={label: variants.GENERATORS[label]}, engine="columns")
    return positions(expanded, "vector", *KEYS, digits=6)


@query("gen_honest", _values_sql(0))
def gen_honest(spark, sf_dir):
    return _one(spark, sf_dir, 0)


@query("gen_int4", _values_sql(1))
def gen_int4(spark, sf_dir):
    return _one(spark, sf_dir, 1)


@query("gen_identity", _values_sql(2))
def gen_identity(spark, sf_dir):
    return _one(spark, sf_dir, 2)


@query("gen_noise", _values_sql(3))
def gen_noise(spark, sf_dir):
    return _one(spark, sf_dir, 3)


@query("gen_perturb", _values_sql(4))
def gen_perturb(spark, sf_dir):
    return _one(spark, sf_dir, 4)


EXPANDED = f"""with {ALL_VARIANTS}
    select g as instruction_id, l as layer_index, t as label, name as label_name, j::int as i,
           round(v::double, 6) + 0 as value
    from variants join labels_named using (t)"""


@query("expand_variants", EXPANDED)
def expand_variants(spark, sf_dir):
    expanded = variants.expand(layer_states(spark, sf_dir))
    return positions(expanded, "vector", *KEYS, "label", "label_name", digits=6)


@query("expand_variants_columns", EXPANDED)
def expand_variants_columns(spark, sf_dir):
    expanded = variants.expand(layer_states(spark, sf_dir), engine="columns")
    return positions(expanded, "vector", *KEYS, "label", "label_name", digits=6)


@query("expand_variants_table", EXPANDED)
def expand_variants_table(spark, sf_dir):
    """The same by a table function in SQL."""
    variant_table.register(spark)
    layer_states(spark, sf_dir).createOrReplaceTempView("states_to_expand")
    expanded = spark.sql("select * from expand_variants(table(select instruction_id, layer_index, input_vec, output_vec from states_to_expand))")
    return positions(expanded, "vector", *KEYS, "label", "label_name", digits=6)


RECORD_SUMS = f"""with {ALL_VARIANTS},
    sums as (select g, l, t, count(*) as dim, sum(v::double) as total, max(abs(v))::double as top
             from variants group by g, l, t)
    select printf('%05d_L%03d_T%d', g, l, t) as sample_id, 'stack-8' as model_name, g as instruction_id,
           l as layer_index, t as label, name as label_name, dim::int as dim, round(total, 5) + 0 as total,
           round(top, 6) as top
    from sums join labels_named using (t)"""


def record_sums(df):
    v = "hidden_state_vector"
    return df.select(
        *[c for c in df.columns if c != v],
        F.size(v).alias("dim"),
        (F.round(F.expr(vectors.total(v)), 5) + F.lit(0.0)).alias("total"),
        F.round(F.expr(vectors.abs_max(v)).cast("double"), 6).alias("top"),
    )


@query("build_dataset", RECORD_SUMS)
def build_dataset(spark, sf_dir):
    return record_sums(records(spark, sf_dir))


@query("assemble_record", RECORD_SUMS)
def assemble_record(spark, sf_dir):
    return record_sums(assemble_records(variants.expand(layer_states(spark, sf_dir), SEED, "columns"), MODEL))


@query(
    "sample_id",
    f"with {RECORD_KEYS} select g as instruction_id, l as layer_index, t as label, id as sample_id from keys",
)
def sample_id(spark, sf_dir):
    return records(spark, sf_dir, "columns").select("instruction_id", "layer_index", "label", "sample_id")


@query(
    "vector_stats",
    """with p as (select vec_id, unnest(embedding) as x from embeddings)
    select vec_id, round(avg(x::double), 9) + 0 as mean, round(stddev_pop(x::double), 9) as std,
           round(max(abs(x))::double, 9) as abs_max from p group by vec_id""",
)
def vector_stats(spark, sf_dir):
    stats = variants.vector_stats(load(spark, sf_dir, "embeddings"), "embedding", ("vec_id",))
    return stats.select(
        "vec_id",
        (F.round("mean", 9) + F.lit(0.0)).alias("mean"),
        F.round("std", 9).alias("std"),
        F.round("abs_max", 9).alias("abs_max"),
    )


def _spoiled(spark, sf_dir):
    """Layer states whose large values became infinite and whose small ones NaN."""
    spoil = "transform({v}, x -> if(x > 0.33F, float('infinity'), if(x < -0.36F, float('nan'), x)))"
    return layer_states(spark, sf_dir).select(
        *KEYS, *[F.expr(spoil.format(v=v)).alias(v) for v in ("input_vec", "output_vec")]
    )


SPOILED = f"""{STATES},
    bad as (select g, l, list_bool_or(list_transform(i, lambda x: x > 0.33::float or x < -0.36::float)) as bi,
                   list_bool_or(list_transform(o, lambda x: x > 0.33::float or x < -0.36::float)) as bo from states)"""


@query("finite_guard", f"with {SPOILED} select g as instruction_id, l as layer_index from bad where not bi and not bo")
def finite_guard(spark, sf_dir):
    return guards.finite_guard(_spoiled(spark, sf_dir)).select(*KEYS)


DROPS = f"""with {SPOILED} select l as layer_index, count(*) as n_rows, count(*) filter (bi) as n_bad_input,
    count(*) filter (not bi and bo) as n_bad_output from bad group by l"""


@query("finite_drops", DROPS)
def finite_drops(spark, sf_dir):
    return guards.finite_drops(_spoiled(spark, sf_dir))


@query("write_counted", DROPS)
def counted_while_written(spark, sf_dir):
    """The same counts, taken by the job that builds and writes the records."""
    return write_counted(_spoiled(spark, sf_dir), new_work_dir(spark, "records"), 8, MODEL).drops(spark)


def _cut_inputs(spark, sf_dir):
    """Layer states where inputs that start with a large value lost their last element."""
    cut = F.expr("if(input_vec[0] > 0.3F, slice(input_vec, 1, size(input_vec) - 1), input_vec)")
    return layer_states(spark, sf_dir).withColumn("input_vec", cut)


@query(
    "shape_guard",
    f"""with {STATES}, bad as (select distinct g from states where i[1] > 0.3::float)
    select g as instruction_id, l as layer_index, len(o)::int as dim from states where g not in (select g from bad)""",
)
def shape_guard(spark, sf_dir):
    return guards.shape_guard(_cut_inputs(spark, sf_dir)).select(*KEYS, F.size("output_vec").alias("dim"))


@query(
    "variant_finite_guard",
    f"""with placed as (select (vec_id // 9)::int as g, (vec_id % 9 - 1)::int as l,
      list_transform(embedding, lambda x: greatest(least(x::double * 1e39::double, 3.3e38::double), -3.3e38::double)::float) as o from embeddings),
    lagged as (select g, l, o, lag(o) over (partition by g order by l) as i from placed),
    states as (select g, l, i, o from lagged where l >= 0),
    {ALL_VARIANTS.split("states as (select g, l, i, o from lagged where l >= 0),", 1)[1]
     .replace("(mu + greatest(sd, 1e-8) * z)::float", "mu + greatest(sd, 1e-8) * z")
     .replace("* sc::double)::float end", "* sc::double) end")
     .replace("(ov::double + ((greatest(0.05::double * sd, 1e-10) * z)::float)::double)::float",
              "ov::double + ((greatest(0.05::double * sd, 1e-10) * z)::float)::double")},
    fate as (select g, l, t, bool_and(abs(v::double) < 3.4028235677973366e38) as good from variants group by g, l, t)
    select t as label, count(*) filter (good) as n_good, count(*) filter (not good) as n_quarantined
    from fate group by t""",
)
def variant_finite_guard(spark, sf_dir):
    """Vectors near the float32 limit, some of whose variants overflow."""
    big = "transform({v}, x -> cast(greatest(least(x * 1e39D, 3.3e38D), -3.3e38D) as float))"
    states = layer_states(spark, sf_dir).select(
        *KEYS, *[F.expr(big.format(v=v)).alias(v) for v in ("input_vec", "output_vec")]
    )
    good, bad = guards.variant_finite_guard(variants.expand(states), "vector")
    both = good.select("label", F.lit(1).alias("ok")).unionByName(bad.select("label", F.lit(0).alias("ok")))
    return both.groupBy("label").agg(
        F.count_if(F.col("ok") == 1).alias("n_good"), F.count_if(F.col("ok") == 0).alias("n_quarantined")
    )


@query(
    "last_token",
    """with last as (select (vec_id // 4)::int as g, arg_max(embedding, vec_id) as v from embeddings group by 1)
    select g as instruction_id, (generate_subscripts(v, 1) - 1)::int as i, unnest(v)::double as value from last""",
)
def last_token(spark, sf_dir):
    tokens = token_states_from_vectors(load(spark, sf_dir, "embeddings"))
    return positions(guards.last_tokens(tokens), "vector", "instruction_id")


@query(
    "run_totals",
    f"""with {STATES}, bad as (select distinct g from states where i[1] > 0.3::float),
    per as (select g, count(*) * 5 as n, max(l) as top from states where g not in (select g from bad) group by g)
    select sum(n)::bigint as n_records, count(*) as n_instructions, (max(top) + 1)::int as n_layers,
           min(n) as min_records, max(n) as max_records, round(avg(n), 6) as records_per_instruction,
           (select count(*) from bad) as n_failed from per""",
)
def totals(spark, sf_dir):
    """Totals of a run in which some instructions failed the shape guard."""
    states = _cut_inputs(spark, sf_dir)
    result = run_totals(build_records(states, MODEL), states)
    return result.withColumn("records_per_instruction", F.round("records_per_instruction", 6))
