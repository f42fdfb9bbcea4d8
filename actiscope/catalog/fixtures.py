"""Inputs made from the test tables, as DataFrames and as the same thing in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actiscope.catalog import load
from actiscope.functions import keyed
from actiscope.plans.generate import build_records
from actiscope.schema import LABELS, SEED
from actiscope.sources.layer_states import layer_states_from_vectors

MODEL = "org/stack-8/"


def layer_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layer_states_from_vectors(load(spark, sf_dir, "embeddings"))


def records(spark: SparkSession, sf_dir: str, engine: str = "arrow") -> DataFrame:
    return build_records(layer_states(spark, sf_dir), MODEL, SEED, engine)


# Layer states: g instruction, l layer, i input vector, o output vector.
STATES = """
    placed as (select (vec_id // 9)::int as g, (vec_id % 9 - 1)::int as l, embedding as o from embeddings),
    lagged as (select g, l, o, lag(o) over (partition by g order by l) as i from placed),
    states as (select g, l, i, o from lagged where l >= 0)"""

# The same, one row per position j.
POSITIONS = """
    positions as (select g, l, generate_subscripts(o, 1) - 1 as j, unnest(i) as iv, unnest(o) as ov from states),
    stats as (select g, l, max(abs(ov)) as am, avg(ov::double) as mu, stddev_pop(ov::double) as sd
              from positions group by g, l)"""

# Keyed normal deviates z for labels 3 and 4.
NORMALS = f"""
    hashed as (select g, l, t, md5(concat_ws('|', '{SEED}', g, l, t)) as h
               from stats cross join (select unnest([3, 4]) as t) labels_with_noise),
    seeded as (select g, l, t, ('0x' || substr(h, 1, 8))::bigint as a, ('0x' || substr(h, 9, 8))::bigint as b from hashed),
    w0 as (select p.g, p.l, s.t, p.j::bigint as j, (s.a + p.j) & {keyed.MASK} as x, s.b
           from positions p join seeded s on p.g = s.g and p.l = s.l),
    w1 as (select g, l, t, j, b, (xor(x, x >> 16) * {keyed.MULTIPLIER_1}) & {keyed.MASK} as x from w0),
    w2 as (select g, l, t, j, b, (xor(x, x >> 15) * {keyed.MULTIPLIER_2}) & {keyed.MASK} as x from w1),
    w3 as (select g, l, t, j, xor(xor(x, x >> 15), b) as x from w2),
    w4 as (select g, l, t, j, (xor(x, x >> 16) * {keyed.MULTIPLIER_1}) & {keyed.MASK} as x from w3),
    w5 as (select g, l, t, j, (xor(x, x >> 15) * {keyed.MULTIPLIER_2}) & {keyed.MASK} as x from w4),
    u as (select g, l, t, j, (xor(x, x >> 15) + 0.5::double) / 4294967296::double as u from w5),
    pairs as (select g, l, t, j // 2 as p, max(case when j % 2 = 0 then u end) as u1,
                     max(case when j % 2 = 1 then u end) as u2 from u group by g, l, t, j // 2),
    normals as (select u.g, u.l, u.t, u.j, sqrt(-2 * ln(u1)) *
                       case when u.j % 2 = 0 then cos(2 * pi() * u2) else sin(2 * pi() * u2) end as z
                from u join pairs on u.g = pairs.g and u.l = pairs.l and u.t = pairs.t and u.j // 2 = pairs.p)"""

# All five variants, one row per position: t label, v value.
VALUES = """
    scaled as (select g, l, (am::double / 7)::float as sc, mu, sd from stats),
    variants as (
      select g, l, j, 0 as t, ov as v from positions
      union all
      select p.g, p.l, p.j, 1, case when sc = 0 then ov else (least(greatest(round_even(
             ((ov::double / sc::double)::float)::double, 0), -8), 7) * sc::double)::float end
      from positions p join scaled s on p.g = s.g and p.l = s.l
      union all
      select g, l, j, 2, iv from positions
      union all
      select n.g, n.l, n.j, 3, (mu + greatest(sd, 1e-8) * z)::float
      from normals n join scaled s on n.g = s.g and n.l = s.l where n.t = 3
      union all
      select n.g, n.l, n.j, 4, (ov::double + ((greatest(0.05::double * sd, 1e-10) * z)::float)::double)::float
      from normals n join scaled s on n.g = s.g and n.l = s.l
                     join positions p on n.g = p.g and n.l = p.l and n.j = p.j where n.t = 4)"""

NAMES = "labels_named as (select * from (values " + ", ".join(f"({k}, '{v}')" for k, v in LABELS.items()) + ") v(t, name))"

ALL_VARIANTS = f"{STATES},{POSITIONS},{NORMALS},{VALUES},\n    {NAMES}"

# Records without their vector: g, l, t, name, id.
RECORD_KEYS = f"""{STATES},
    {NAMES},
    keys as (select g, l, t, name, printf('%05d_L%03d_T%d', g, l, t) as id from states cross join labels_named)"""


def positions(df: DataFrame, vec: str, *keep: str, digits: int | None = None) -> DataFrame:
    """One row per vector position; 0.0 is added so that no -0.0 is left."""
    value = F.col("value").cast("double") + F.lit(0.0)
    value = value if digits is None else F.round(value, digits) + F.lit(0.0)
    return df.select(*keep, F.posexplode(vec).alias("i", "value")).select(*keep, "i", value.alias("value"))
