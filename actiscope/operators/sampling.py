"""Exact, repeatable sampling, splitting and shuffling.

Rows are ordered by the hash of their id, and "the first q rows of a class" is
turned into a cut: the hash and id of row number q. Cuts are found from counts
per class and hash prefix, so no class is ever sorted in one task, and then
applied to the full rows as a comparison. Vectors are not shuffled by sampling
or splitting.

Ids must be unique; copies of one id share a hash and stay on one side.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actiscope.functions.keyed import row_hash
from actiscope.schema import SAMPLE_SIZE, SEED, TEST_SIZE, VAL_SIZE
from actiscope.session import broadcast_if_small, stored

MAX_CLASSES = 10_000
ROWS_PER_PREFIX = 50_000


def class_counts(df: DataFrame, label: str, max_classes: int = MAX_CLASSES) -> dict[Any, int]:
    """Rows per class, on the driver; more than ``max_classes`` classes is an error."""
    rows = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).limit(max_classes + 1).collect()
    if len(rows) > max_classes:
        raise ValueError(f"{label} has more than {max_classes} values and is no class column")
    if any(r[0] is None for r in rows):
        raise ValueError(f"{label} holds nulls")
    return {r[0]: r[1] for r in sorted(rows)}


def _prefix_digits(n_rows: int) -> int:
    """Hex digits that leave about ``ROWS_PER_PREFIX`` rows under one prefix."""
    return max(1, math.ceil(math.log(max(1.0, n_rows / ROWS_PER_PREFIX), 16)))


def hash_cuts(df: DataFrame, id_col: str, label: str, ranks: Mapping[Any, list[int]], n_rows: int, seed: int) -> DataFrame:
    """For each class the (hash, id) pairs at the given ranks.

    One row per class: ``label`` and an array ``cuts`` of (h, id) structs; a
    rank of 0 gives null, which no row is at or below.
    """
    spark = df.sparkSession
    schema = T.StructType(
        [T.StructField("y", df.schema[label].dataType), T.StructField("cut", T.IntegerType()), T.StructField("rank", T.LongType())]
    )
    asked = [(y, i, r) for y, rs in ranks.items() for i, r in enumerate(rs)]
    targets = F.broadcast(spark.createDataFrame(asked, schema))

    digest = row_hash(seed, id_col)
    keys = df.select(F.col(label).alias("y"), F.col(id_col).alias("id"), digest.alias("h")).withColumn(
        "prefix", F.substring("h", 1, _prefix_digits(n_rows))
    )
    counts = keys.groupBy("y", "prefix").agg(F.count(F.lit(1)).alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("y").orderBy("prefix"))
    reached = (F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank"))
    crossing = (
        counts.withColumn("upto", so_far)
        .join(targets, "y")
        .where(reached)
        .select("y", "prefix", "cut", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"))
    )
    # One row per class and cut crosses; the next pass only sorts the rows under that prefix.
    crossing = F.broadcast(spark.createDataFrame(crossing.collect(), crossing.schema))
    near = keys.join(crossing, ["y", "prefix"]).groupBy("y", "cut", "rank", "h", "id").agg(F.count(F.lit(1)).alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("y", "cut").orderBy("h", "id"))
    found = {(r.y, r.cut): (r.h, r.id) for r in near.withColumn("upto", so_far).where(reached).collect()}

    cut = T.StructType([T.StructField("h", T.StringType()), T.StructField("id", df.schema[id_col].dataType)])
    schema = T.StructType([T.StructField(label, df.schema[label].dataType), T.StructField("cuts", T.ArrayType(cut))])
    rows = [(y, [found.get((y, i)) for i in range(len(rs))]) for y, rs in ranks.items()]
    return spark.createDataFrame(rows, schema)


def _at_or_below(cut: Column, id_col: str) -> Column:
    inside = F.struct(F.col("_h").alias("h"), F.col(id_col).alias("id")) <= cut
    return F.coalesce(inside, F.lit(False))


def _with_cuts(df: DataFrame, cuts: DataFrame, id_col: str, label: str, seed: int) -> DataFrame:
    return df.withColumn("_h", row_hash(seed, id_col)).join(F.broadcast(cuts), label)


def stratified_sample(
    df: DataFrame, id_col: str = "sample_id", label: str = "label", n_samples: int = SAMPLE_SIZE, seed: int = SEED
) -> DataFrame:
    """About ``n_samples`` rows, the same share of every class; all rows when there are no more."""
    counts = class_counts(df, label)
    total = sum(counts.values())
    if total <= n_samples:
        return df
    share = n_samples / total
    ranks = {y: [round(share * n)] for y, n in counts.items()}
    cuts = hash_cuts(df, id_col, label, ranks, total, seed)
    kept = _with_cuts(df, cuts, id_col, label, seed).where(_at_or_below(F.col("cuts")[0], id_col))
    return kept.select(*df.columns)


def proportional_quotas(counts: Mapping[Any, int], size: int) -> dict[Any, int]:
    """Share ``size`` rows out by class size; left-over units go to the largest
    remainders, ties to the smaller class."""
    total = sum(counts.values())
    quota = {y: size * n // total for y, n in counts.items()}
    by_remainder = sorted(counts, key=lambda y: (-(size * counts[y] % total), y))
    for y in by_remainder[: size - sum(quota.values())]:
        quota[y] += 1
    return quota


def split_quotas(counts: Mapping[Any, int], val_size: float, test_size: float) -> dict[Any, tuple[int, int]]:
    """Test and validation rows of each class."""
    total = sum(counts.values())
    n_test = math.ceil(test_size * total)
    test = proportional_quotas(counts, n_test)
    rest = {y: counts[y] - test[y] for y in counts}
    n_val = math.ceil(val_size / (1 - test_size) * (total - n_test))
    val = proportional_quotas(rest, n_val)
    return {y: (test[y], val[y]) for y in counts}


def stratified_split(
    df: DataFrame,
    id_col: str = "sample_id",
    label: str = "label",
    val_size: float = VAL_SIZE,
    test_size: float = TEST_SIZE,
    seed: int = SEED,
    within: str | None = None,
) -> DataFrame:
    """Add ``split`` (train, val or test), each with the class shares of the whole.

    With ``within``, each of its values is split on its own, all in the same passes.
    """
    if within is not None:
        # Classes of all values at once: one class per value and label.
        named = df.withColumn("_class", F.concat_ws("|", F.col(within).cast("string"), F.col(label).cast("string")))
        ranks, total = {}, 0
        for part in _counts_within(df, within, label).values():
            total += sum(n for _, n in part.values())
            quotas = split_quotas({y: n for y, (_, n) in part.items()}, val_size, test_size)
            ranks |= {part[y][0]: [test, test + val] for y, (test, val) in quotas.items()}
        return _marked(named, hash_cuts(named, id_col, "_class", ranks, total, seed), id_col, "_class", seed).select(*df.columns, "split")
    counts = class_counts(df, label)
    quotas = split_quotas(counts, val_size, test_size)
    ranks = {y: [test, test + val] for y, (test, val) in quotas.items()}
    return _marked(df, hash_cuts(df, id_col, label, ranks, sum(counts.values()), seed), id_col, label, seed)


def _counts_within(df: DataFrame, within: str, label: str, most: int = MAX_CLASSES) -> dict[Any, dict[Any, tuple[str, int]]]:
    """Per value of ``within`` its classes, each with its joint name and rows."""
    rows = df.groupBy(within, label).agg(F.count(F.lit(1)).alias("n")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{within} and {label} have more than {most} values")
    if any(r[0] is None or r[1] is None for r in rows):
        raise ValueError(f"{within} or {label} holds nulls")
    found: dict[Any, dict] = {}
    for value, y, n in sorted(rows):
        found.setdefault(value, {})[y] = (f"{value}|{y}", n)
    return found


def _marked(df: DataFrame, cuts: DataFrame, id_col: str, label: str, seed: int) -> DataFrame:
    split = (
        F.when(_at_or_below(F.col("cuts")[0], id_col), "test")
        .when(_at_or_below(F.col("cuts")[1], id_col), "val")
        .otherwise("train")
    )
    return _with_cuts(df, cuts, id_col, label, seed).select(*df.columns, split.alias("split"))


def group_split(df: DataFrame, group: str = "instruction_id", test_size: float = 0.2, seed: int = SEED) -> DataFrame:
    """Add ``split`` (train or test) so that all rows of a group are on one side."""
    groups = stored(df.select(group).distinct().withColumn("_all", F.lit(0)), "groups")
    n = groups.count()
    cuts = hash_cuts(groups, group, "_all", {0: [math.ceil(test_size * n)]}, n, seed)
    marked = _with_cuts(df.withColumn("_all", F.lit(0)), cuts, group, "_all", seed)
    split = F.when(_at_or_below(F.col("cuts")[0], group), "test").otherwise("train")
    return marked.select(*df.columns, split.alias("split"))


def shuffle_rows(df: DataFrame, id_col: str = "sample_id", seed: int = SEED) -> DataFrame:
    """Add ``shuffle_rank``, the 1-based place of each row in a seeded random order.

    Only ids move to the task of their hash prefix; the rank is the place within
    the prefix plus the rows under smaller prefixes, and joins the rows by id. Ids are
    unique and not null. A list of ranks counted to be short is broadcast, so that rows
    and their vectors stay where they are.
    """
    digits = _prefix_digits(df.count())
    digest = row_hash(seed, id_col)
    ids = df.select(F.col(id_col).alias("_id"), digest.alias("_h"), F.substring(digest, 1, digits).alias("_prefix"))
    before = Window.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ids.groupBy("_prefix")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_prefix", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    within = F.row_number().over(Window.partitionBy("_prefix").orderBy("_h", "_id"))
    ranked = (
        ids.withColumn("_within", within)
        .join(broadcast_if_small(stored(starts, "starts")), "_prefix")  # one row per ROWS_PER_PREFIX rows
        .select("_id", (F.col("_start") + F.col("_within")).alias("shuffle_rank"))
    )
    ranks = broadcast_if_small(stored(ranked, "ranks"))
    return df.join(ranks, df[id_col] == ranks["_id"]).select(*df.columns, "shuffle_rank")


def split_sizes(df: DataFrame, label: str = "label", split: str = "split") -> DataFrame:
    return df.groupBy(split, label).agg(F.count(F.lit(1)).alias("n"))
