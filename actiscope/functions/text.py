"""String expressions used when instructions are read and records are named."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from actiscope.schema import MAX_TOKENS


def compose_prompt(instruction: Column, extra: Column) -> Column:
    """The instruction, then a line break and the extra input where there is one."""
    text = F.coalesce(instruction, F.lit(""))
    more = F.coalesce(extra, F.lit(""))
    return F.when(more != "", F.concat(text, F.lit("\n"), more)).otherwise(text)


def truncate_tokens(text: Column, limit: int = MAX_TOKENS) -> Column:
    """At most ``limit`` leading space-separated tokens of the text."""
    return F.substring_index(text, " ", limit)


def short_model_name(name: Column) -> Column:
    """Last path segment, trailing slashes ignored."""
    return F.substring_index(F.regexp_replace(name, "/+$", ""), "/", -1)


def sample_id(instruction_id: Column, layer_index: Column, label: Column) -> Column:
    return F.format_string("%05d_L%03d_T%d", instruction_id, layer_index, label)
