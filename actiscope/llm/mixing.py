"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A document of a source with mean repetition rate r appears k times, k Poisson with
mean r, drawn by inverting the distribution at a hash of (seed, id). Copies are then
dealt to partitions and sorted by a random key, which shuffles them globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actiscope.llm.common import free_name, shuffle_partitions, unit_hash
from actiscope.session import broadcast_if_small, stored

SEED = "mix-1"
POWER = 0.5
"""A source's default weight is its number of documents to this power."""
BROADCAST_SOURCES = 50_000
"""Sources whose distributions, of 184 doubles at most, are broadcast: 74 MB."""
PART_MEAN = 64.0
"""A larger mean is a sum of equal parts up to this one, each with a draw of its own."""


def target_rates(docs: DataFrame, weights: DataFrame | None = None, source: str = "source", power: float = POWER, total: int | None = None) -> DataFrame:
    """``source, rate``: the mean number of copies that gives each source its share of ``total`` rows.

    ``weights`` (source, weight) names the shares; a source it lacks gets weight 0 and no copies. Without
    it weights are counts to a ``power``. ``total`` is by default the number of documents. A null source
    is a source. Two numbers reach the driver.
    """
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighed = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(float(power))))
    else:
        named = weights.select(F.col("source").alias("named"), F.col("weight").cast("double"))
        weighed = counts.join(named, F.col("source").eqNullSafe(F.col("named")), "left").select("source", "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    weighed = stored(weighed, "rates")
    n, all_weights = weighed.agg(F.sum("n"), F.sum("weight")).first()
    rows = float(total if total is not None else n or 0)
    return weighed.select("source", (F.lit(rows) * F.col("weight") / F.lit(all_weights or 1.0) / F.col("n")).alias("rate"))


def cumulative(mean: Column) -> Column:
    """Poisson probabilities of at most 0, 1, 2, ..., as far as doubles can tell them from 1."""
    most = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")
    first = F.exp(-mean)

    def longer(held: Column, k: Column) -> Column:
        p = held["p"] * mean / k
        return F.struct(p.alias("p"), (held["c"] + p).alias("c"), F.concat(held["all"], F.array(held["c"] + p)).alias("all"))

    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))
    return F.aggregate(F.sequence(F.lit(1), most), start, longer)["all"]


def poisson_table(rates: DataFrame) -> DataFrame:
    """Rates with the number of draws each takes and the distribution of one draw."""
    parts = F.greatest(F.ceil(F.col("rate") / PART_MEAN), F.lit(1)).cast("int")
    return rates.withColumn("parts", parts).withColumn("at_most", cumulative(F.col("rate") / parts))


def copies(parts: Column, at_most: Column, key: Column, seed: str) -> Column:
    """Number of copies: for each draw, how many probabilities its uniform number has passed."""

    def drawn(part: Column) -> Column:
        u = unit_hash(seed, part, key)
        return F.size(F.filter(at_most, lambda c: c <= u))

    return F.aggregate(F.sequence(F.lit(0), parts - 1), F.lit(0), lambda n, part: n + drawn(part))


def mix(docs: DataFrame, weights: DataFrame | None = None, source: str = "source", id_col: str = "doc_id", seed: str = SEED, **rates) -> DataFrame:
    """Every document as often as its draw says, in random order, with ``copy`` and ``shuffle_key``.

    Columns of these two names are replaced. Every row has a draw of its own: by its id, and where the id is null or
    other rows have it too, by the row's number in its task as well. Rates are joined by broadcast when counted to be few sources, else by
    a shuffle that adaptive execution splits at hot sources. An empty table gives no rows.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    fresh = lambda name: free_name(name, names)
    of, parts, at_most, own, times = map(fresh, ("_mix_source", "_mix_parts", "_mix_at_most", "_mix_key", "_mix_copies"))
    table = broadcast_if_small(stored(poisson_table(target_rates(docs, weights, source, **rates)), "poisson"), BROADCAST_SOURCES)
    table = table.select(F.col("source").alias(of), F.col("parts").alias(parts), F.col("at_most").alias(at_most))
    keyed = _with_keys(docs.select(*names), id_col, own)
    drawn = keyed.join(table, F.col(source).eqNullSafe(F.col(of))).select(*names, own, copies(F.col(parts), F.col(at_most), F.col(own), seed).alias(times))
    rows = drawn.where(F.col(times) > 0).select(*names, own, F.explode(F.sequence(F.lit(0), F.col(times) - 1)).alias("copy"))
    rows = rows.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), "copy", own))).drop(own)
    return rows.repartition(shuffle_partitions(spark), "shuffle_key").sortWithinPartitions("shuffle_key")


def _with_keys(docs: DataFrame, id_col: str, own: str) -> DataFrame:
    """``docs`` with the text that each row's draw is made from. Only ids are read to find those that several rows have."""
    mark = free_name("_mix_repeated", docs.columns)
    name = F.col(id_col).cast("string")
    again = docs.where(F.col(id_col).isNotNull()).groupBy(name.alias(mark)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = stored(again, "repeated")
    number = F.concat_ws("|", F.coalesce(name, F.lit("")), F.monotonically_increasing_id().cast("string"))
    numbered = docs.withColumn(own, F.when(F.col(id_col).isNull(), number).otherwise(name))
    if again.isEmpty():
        return numbered
    row = free_name("_mix_row", docs.columns)
    both = docs.withColumn(row, number).join(broadcast_if_small(again), name == F.col(mark), "left")
    return both.withColumn(own, F.when(F.col(mark).isNotNull() | F.col(id_col).isNull(), F.col(row)).otherwise(name)).drop(mark, row)


ORACLE = f"""with n as (select source, count(*) as n, sqrt(count(*)) as w from documents group by 1),
r as (select source, (select sum(n) from n) * w / (select sum(w) from n) / n as rate from n),
p as (select source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) over (partition by source order by k) as at_most
      from r cross join range(0, 200) t(k)),
u as (select doc_id, source, ('0x' || substr(md5('{SEED}|0|' || doc_id), 1, 13))::bigint / 4503599627370496.0 as u from documents),
c as (select doc_id, count(*) as copies from u join p on u.source = p.source and p.at_most <= u.u group by 1)
select d.*, copy::int as copy, md5('{SEED}|order|' || copy || '|' || d.doc_id) as shuffle_key
from documents d join c using (doc_id) cross join range(0, 200) t(copy) where copy < copies"""
