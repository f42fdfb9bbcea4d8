"""Instruction texts and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from actiscope.catalog import load, query
from actiscope.functions import text
from actiscope.schema import DATASET_SIZE, LABELS, MAX_TOKENS, label_name
from actiscope.sources.instructions import instructions_from_conversations, load_instructions, number_rows

INSTRUCTIONS = """instructions as (
      select conv_id, arg_min(text, turn) filter (role = 'user') as instruction,
             max(text) filter (role = 'system' and turn = 0) as input
      from conversations group by conv_id),
    prompts as (select conv_id, case when coalesce(input, '') <> ''
                  then coalesce(instruction, '') || chr(10) || input else coalesce(instruction, '') end as text
                from instructions)"""


@query("compose_prompt", f"with {INSTRUCTIONS} select conv_id, text from prompts")
def compose_prompt(spark, sf_dir):
    rows = instructions_from_conversations(load(spark, sf_dir, "conversations"))
    return rows.select("conv_id", text.compose_prompt(F.col("instruction"), F.col("input")).alias("text"))


@query(
    "load_instructions",
    f"""with {INSTRUCTIONS}
    select (row_number() over (order by conv_id) - 1)::int as instruction_id, conv_id, text
    from prompts order by conv_id limit {DATASET_SIZE}""",
)
def first_instructions(spark, sf_dir):
    rows = instructions_from_conversations(load(spark, sf_dir, "conversations"))
    return load_instructions(rows, "conv_id", DATASET_SIZE)


@query("number_rows", "select doc_id, row_number() over (order by doc_id) - 1 as position from documents")
def numbered(spark, sf_dir):
    return number_rows(load(spark, sf_dir, "documents"), "doc_id")


@query(
    "truncate_tokens",
    f"""with cut as (select doc_id, array_to_string(list_slice(string_split(text, ' '), 1, {MAX_TOKENS}), ' ') as t,
                     len(string_split(text, ' ')) as n from documents)
    select doc_id, md5(t) as text_md5, length(t) as n_kept, n > {MAX_TOKENS} as truncated from cut""",
)
def truncate_tokens(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    cut = text.truncate_tokens(F.col("text"))
    return docs.select(
        "doc_id",
        F.md5(cut).alias("text_md5"),
        F.length(cut).cast("bigint").alias("n_kept"),
        (F.length(cut) < F.length("text")).alias("truncated"),
    )


@query(
    "short_model_name",
    "select page_id, split_part(regexp_replace(url, '/+$', ''), '/', -1) as name from pages",
)
def short_model_name(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", text.short_model_name(F.col("url")).alias("name"))


@query(
    "label_names",
    "with n as (select * from (values "
    + ", ".join(f"({k}, '{v}')" for k, v in LABELS.items())
    + """) v(label, label_name))
    select doc_id, label, label_name from (select doc_id, quality + 2 * toxic as label from labels) join n using (label)""",
)
def label_names(spark, sf_dir):
    rows = load(spark, sf_dir, "labels").select("doc_id", F.expr("quality + 2 * toxic").alias("label"))
    return rows.select("doc_id", "label", label_name(F.col("label")).alias("label_name"))
