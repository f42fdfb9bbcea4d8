"""Shards of bounded size by extendible hashing.

A directory is indexed by the first bits of a hash. A bucket beyond the byte limit is
split on its next bit, and only such a bucket, until every shard fits.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actiscope.session import broadcast_if_small, stored

LIMIT = 1 << 20
"""Bytes of text a shard may hold."""
BITS = 52
"""Bits of the id's hash; as many of the row's own follow, so that copies of an id can part."""
STEP = 13
"""Bits by which the directory grows at a time; whole numbers of steps make up the bits."""


def _bits(value: Column) -> Column:
    return F.conv(F.substring(F.md5(value), 1, 13), 16, 10).cast("long")


def _level(rows: DataFrame, known: int, limit: int, last: bool) -> tuple[DataFrame, DataFrame]:
    """Cells of one step with their shard, and the cells that need more bits.

    ``rows``: (path, cell, bytes), path the bits so far as text, cell the next STEP bits as text.
    """
    cells = stored(rows.groupBy("path", "cell").agg(F.sum("bytes").alias("bytes")), "cells")
    first = 0 if known == 0 else 1
    spread = cells.select("path", "cell", "bytes", F.explode(F.sequence(F.lit(first), F.lit(STEP))).alias("depth"))
    spread = spread.withColumn("prefix", F.substring("cell", F.lit(1), F.col("depth")))
    nodes = spread.groupBy("path", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.first("depth").alias("depth"))
    fits = F.col("shard_bytes") <= limit
    if last:
        fits = fits | (F.col("depth") == STEP)
    sized = spread.join(nodes.select("path", "prefix", "shard_bytes"), ["path", "prefix"])
    leaf = sized.groupBy("path", "cell").agg(F.min(F.when(fits, F.struct("depth", "prefix", "shard_bytes"))).alias("leaf"))
    found = stored(leaf, "directory")
    done = found.where("leaf is not null").select(
        "path", "cell", F.concat("path", "leaf.prefix").alias("shard"), (F.col("leaf.depth") + known).alias("depth"), "leaf.shard_bytes"
    )
    return done, found.where("leaf is null").select("path", "cell")


def shards(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, shard, depth, shard_bytes`` per row; ``shard`` is the bucket's bits as text.

    A null text has no bytes; a null id hashes as the empty text. When 52 bits of the id's hash do
    not part a bucket (copies of one id), bits of each row's own number follow; only a single text
    beyond the limit keeps a larger shard, its own. Texts are not moved. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "sizes")
    both = [_bits(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), _bits(F.col("row").cast("string"))]
    bits = F.concat(*(F.lpad(F.conv(b.cast("string"), 10, 2), BITS, "0") for b in both))
    rows = rows.withColumn("bits", bits)
    waiting, out = rows, []
    for known in range(0, 2 * BITS, STEP):
        path, cell = F.substring("bits", 1, known), F.substring("bits", known + 1, STEP)
        waiting = waiting.withColumn("path", path).withColumn("cell", cell)
        done, more = _level(waiting.select("path", "cell", F.col("n_bytes").alias("bytes")), known, limit, known + STEP == 2 * BITS)
        out.append(waiting.join(broadcast_if_small(done), ["path", "cell"]))
        if more.isEmpty():
            break
        waiting = waiting.join(broadcast_if_small(more), ["path", "cell"], "left_semi")
    return functools.reduce(DataFrame.unionByName, (o.select("doc_id", "n_bytes", "shard", "depth", "shard_bytes") for o in out))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id") -> None:
    """Write the documents with one folder ``shard=b...`` per shard, the bits after a letter; ids are unique here."""
    placed = shards(docs, limit, id_col).select(F.col("doc_id").alias(id_col), F.concat(F.lit("b"), "shard").alias("shard"))
    docs.join(placed, id_col).repartition("shard").write.partitionBy("shard").parquet(path)


ORACLE = f"""with d as (select doc_id, strlen(text) as n_bytes, ('0x' || substr(md5(doc_id::varchar), 1, 13))::bigint as h from documents),
p as (select doc_id, n_bytes, depth, lpad(bin(h), {BITS}, '0')[1:depth] as shard from d cross join range(0, 41) t(depth)),
s as (select *, sum(n_bytes) over (partition by depth, shard)::bigint as shard_bytes from p),
f as (select *, row_number() over (partition by doc_id order by depth) as place from s where shard_bytes <= {LIMIT})
select doc_id, n_bytes::bigint as n_bytes, shard, depth::int as depth, shard_bytes from f where place = 1"""
