"""Fill-in-middle transformation, with both cuts between words.

A text is a row of units, each a word with the white space before it, or white space at
the end. One full match of repeated units keeps where each of them ended; their number and
the offsets of both cuts are read from there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actiscope.llm.common import slices
from actiscope.session import as_column

# White space, the marks of the three parts, and shares in percent.
SPACE = r"\x20\x09-\x0D"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
CHANGED, SUFFIX_FIRST = 50, 80

UNIT = rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+"
UNITS = regex.compile(f"({UNIT})*")
MARK = regex.compile("|".join((PREFIX, SUFFIX, MIDDLE)))


def draws(doc_id, seed: int = SEED) -> list[int]:
    """Four numbers below 2**32 from the seed and the id; a null id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def rearranged(text: str, h: list[int]) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix length, middle length, output) of one text; lengths count code points and are null when plain."""
    ends = UNITS.fullmatch(text).ends(1)
    n = len(ends)
    if not text or h[2] % 100 >= CHANGED or MARK.search(text):
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = ends[low - 1] if low else 0, ends[high - 1] if high else 0
    prefix, middle, suffix = PREFIX + text[:a], MIDDLE + text[a:b], SUFFIX + text[b:]
    if h[3] % 100 < SUFFIX_FIRST:
        return n, "spm", a, b - a, suffix + prefix + middle
    return n, "psm", a, b - a, prefix + suffix + middle


def fill_in_middle(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every row, in a plan without a shuffle.

    A null text is an empty one and stays plain, as does a text that holds a mark. Repeated rows give
    the same row each time, as the draws depend on seed and id alone. Other columns are not read; an
    empty table gives no rows.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("form", T.StringType())])
    schema = schema.add("prefix_chars", T.LongType()).add("middle_chars", T.LongType()).add("output", T.StringType())
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ids = 0, batch.column(0)
            for texts in slices(t or "" for t in batch.column(1).to_pylist()):
                mine = ids.slice(at, len(texts))
                at += len(texts)
                made = [rearranged(t, draws(i, seed)) for i, t in zip(mine.to_pylist(), texts)]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*made), kinds)]
                yield pa.RecordBatch.from_arrays([mine, *columns[:-1], columns[-1].cast(pa.string())], names=schema.names)

    return docs.select(F.col(id_col), F.col(text)).mapInArrow(run, schema)


def restored(output: Column | str = "output", form: Column | str = "form") -> Column:
    """The text that was rearranged, from output and form alone.

    A text with a mark stays plain, so each mark stands once. A mark starts and ends with
    characters of its own, so none can overlap the end of a part.
    """
    output, form = as_column(output), as_column(form)
    head, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    between = lambda first, then: (F.substring_index(F.substring_index(head, then, 1), first, -1), F.substring_index(head, then, -1))
    prefix, suffix = between(PREFIX, SUFFIX)
    suffix_first, prefix_last = between(SUFFIX, PREFIX)
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(prefix, middle, suffix))
        .otherwise(F.concat(prefix_last, middle, suffix_first))
    )


ORACLE = rf"""
with texts as (
  select doc_id, coalesce(text, '') as text, sha256('{SEED}:' || coalesce(doc_id::varchar, '')) as h from documents
), drawn as (
  select doc_id, text, regexp_extract_all(text, '{UNIT}') as units,
    ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2,
    ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4
  from texts
), cuts as (
  select *, len(units) as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as low, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as high,
    case when text = '' or regexp_matches(text, '{PREFIX}|{SUFFIX}|{MIDDLE}') or h3 % 100 >= {CHANGED} then 'plain' when h4 % 100 < {SUFFIX_FIRST} then 'spm' else 'psm' end as form
  from drawn
), parts as (
  select *, array_to_string(units[1:low], '') as p, array_to_string(units[low + 1:high], '') as m, array_to_string(units[high + 1:], '') as s from cuts
)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m else '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m end) as output_sha256,
  sha256(text) as restored_sha256
from parts"""
