"""Samples, splits and orders of events and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from actiscope.catalog import load, query
from actiscope.operators import sampling
from actiscope.schema import SEED

N_SAMPLES = 2500

HASHED = f"k as (select event_id as id, event_type as y, md5(concat_ws('|', '{SEED}', event_id)) as h from events)"

# Rank quotas of a two-step stratified split of k(id, y, h): result z(y, ct, cv).
SPLIT_QUOTAS = """
    c as (select y, count(*) as n from k group by y),
    t as (select sum(n)::bigint as tot, ceil(0.15::double * sum(n))::bigint as nt from c),
    q as (select y, n, tot, nt, (nt * n) // tot as f, (nt * n) % tot as r from c cross join t),
    a as (select y, n, tot, nt, f + case when row_number() over (order by r desc, y)
                 <= nt - sum(f) over () then 1 else 0 end as ct from q),
    b as (select y, n, ct, n - ct as m, tot - nt as rem,
                 ceil((0.15::double / (1::double - 0.15::double)) * (tot - nt))::bigint as nv from a),
    d as (select y, ct, m, rem, nv, (nv * m) // rem as f, (nv * m) % rem as r from b),
    z as (select y, ct, f + case when row_number() over (order by r desc, y)
                 <= nv - sum(f) over () then 1 else 0 end as cv from d),
    placed_rows as (select k.id, k.y, row_number() over (partition by k.y order by h, id) as rn, ct, cv
                    from k join z on k.y = z.y),
    split_rows as (select id, y, case when rn <= ct then 'test' when rn <= ct + cv then 'val' else 'train' end as split
                   from placed_rows)"""


@query(
    "stratified_sample",
    f"""with {HASHED}, c as (select y, count(*) as n from k group by y), t as (select sum(n) as tot from c),
    r as (select id, y, row_number() over (partition by y order by h, id) as rn from k)
    select id as event_id, r.y as event_type from r join c on r.y = c.y cross join t
    where tot <= {N_SAMPLES} or rn <= round_even({N_SAMPLES}::double / tot * n, 0)""",
)
def stratified_sample(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("event_id", "event_type")
    return sampling.stratified_sample(rows, "event_id", "event_type", N_SAMPLES)


@query(
    "stratified_split",
    f"with {HASHED},{SPLIT_QUOTAS} select id as event_id, y as event_type, split from split_rows",
)
def stratified_split(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("event_id", "event_type")
    return sampling.stratified_split(rows, "event_id", "event_type")


@query(
    "split_sizes",
    f"with {HASHED},{SPLIT_QUOTAS} select split, y as event_type, count(*) as n from split_rows group by 1, 2",
)
def split_sizes(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("event_id", "event_type")
    return sampling.split_sizes(sampling.stratified_split(rows, "event_id", "event_type"), "event_type")


@query(
    "group_split",
    f"""with g as (select distinct user_id from events),
    r as (select user_id, row_number() over (order by md5(concat_ws('|', '{SEED}', user_id)), user_id) as rn,
                 count(*) over () as n from g)
    select event_id, user_id, case when rn <= ceil(0.2::double * n) then 'test' else 'train' end as split
    from events join r using (user_id)""",
)
def group_split(spark, sf_dir):
    return sampling.group_split(load(spark, sf_dir, "events").select("event_id", "user_id"), "user_id")


@query(
    "shuffle_rows",
    f"""select event_id, event_type,
    row_number() over (order by md5(concat_ws('|', '{SEED}', event_id)), event_id) as shuffle_rank from events""",
)
def shuffle_rows(spark, sf_dir):
    return sampling.shuffle_rows(load(spark, sf_dir, "events").select("event_id", "event_type"), "event_id").select(
        "event_id", "event_type", F.col("shuffle_rank").cast("bigint")
    )
