"""Sharding by extendible hashing.

A row's address is 60 bits: 36 of md5(id), then 24 of md5(text), so that rows that share an id can still be told
apart.  The directory starts as one bucket of depth 0; a bucket that holds more than ``limit`` bytes is split on the
next bit, and only such buckets are.  Buckets that fit are the shards.

Only (id, address, bytes) is shuffled, never a text.  Bytes are first summed by an address prefix; sums over every
shorter prefix follow from those cells, and the shortest prefix that fits is the shard of all rows below it.  Cells
that are still too large are summed again on more bits, those cells alone.

A row larger than ``limit``, and rows equal in id and text that together exceed it, can't be split by any bit: they
form a shard of full depth flagged ``oversize``.  A null text has no bytes, a null id the address of ''.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

BITS = 60
#: Bytes of a shard in production.
LIMIT = 16 << 20


def address(id_col: Column, text_col: Column) -> Column:
    text = F.coalesce(text_col, F.lit("")).cast("binary")
    name = F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")
    return F.conv(F.concat(F.substring(F.md5(name), 1, 9), F.substring(F.md5(text), 1, 6)), 16, 10).cast("long")


def assign(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, shard, depth, n_bytes, shard_bytes, oversize) of every row; shard is 'depth:prefix'."""
    return _placed(docs, limit, id_col, text_col).drop("address")


def _placed(docs: DataFrame, limit: int, id_col: str, text_col: str) -> DataFrame:
    sized = written(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            address(F.col(id_col), F.col(text_col)).alias("address"),
            F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"),
        ),
        "shard-addresses",
    )
    total = sized.agg(F.sum("n_bytes")).first()[0] or 0
    low, high = 0, min(BITS, 6 + max(0, math.ceil(math.log2(max(1, total / limit)))))
    parts = []
    rest = sized
    while True:
        cell = F.shiftright("address", BITS - high)
        cells = rest.groupBy(cell.alias("cell")).agg(F.sum("n_bytes").alias("cell_bytes"))
        buckets = (
            cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high))))
            .groupBy("depth", F.expr(f"shiftright(cell, {high} - depth)").alias("prefix"))
            .agg(F.sum("cell_bytes").alias("shard_bytes"))
            .where((F.col("shard_bytes") <= limit) | (F.col("depth") == BITS))
        )
        paths = cells.select("cell", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {high} - depth)"))
        leaf = F.min(F.struct("depth", "prefix", "shard_bytes"))
        directory = written(paths.hint("shuffle_hash").join(buckets, ["depth", "prefix"], "left").groupBy("cell").agg(F.min(F.when(F.col("shard_bytes").isNotNull(), F.struct("depth", "prefix", "shard_bytes"))).alias("leaf")), "shard-directory")
        placed = rest.withColumn("cell", cell).join(directory.hint("merge"), "cell", "left")
        parts.append(
            placed.where(F.col("leaf").isNotNull()).select(
                "doc_id",
                "address",
                F.concat_ws(":", F.col("leaf.depth"), F.col("leaf.prefix")).alias("shard"),
                F.col("leaf.depth").alias("depth"),
                "n_bytes",
                F.col("leaf.shard_bytes").alias("shard_bytes"),
                (F.col("leaf.shard_bytes") > limit).alias("oversize"),
            )
        )
        if high == BITS or directory.where(F.col("leaf").isNull()).isEmpty():
            break
        rest = written(placed.where(F.col("leaf").isNull()).select("doc_id", "address", "n_bytes"), "shard-rest")
        low, high = high + 1, min(BITS, high + 12)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` as one Parquet folder per shard under ``path`` (column ``shard``), every row once.

    An address has one shard, so rows find theirs by address, repeated ids too.  Rows go to tasks by a range of (shard,
    id), so a large shard may be written by several tasks.  A column ``shard`` of ``docs`` gives way."""
    placed = _placed(docs, limit, id_col, text_col).select(F.col("address").alias("__address"), "shard").distinct()
    rows = docs.drop("shard").withColumn("__address", address(F.col(id_col), F.col(text_col)))
    out = rows.join(placed.hint("merge"), "__address").drop("__address")
    out.repartitionByRange(F.col("shard"), F.col(id_col)).write.partitionBy("shard").parquet(path)


def oracle(limit: int) -> str:
    """DuckDB SQL for :func:`assign` over documents."""
    return f"""
WITH s AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 9) || substr(md5(coalesce(text, '')), 1, 6) AS BIGINT) AS address,
                  CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, row_number() OVER () AS k FROM documents),
d AS (SELECT s.*, CAST(depth AS INTEGER) AS depth, address >> ({BITS} - depth) AS prefix FROM s, range(0, {BITS + 1}) t(depth)),
b AS (SELECT *, CAST(sum(n_bytes) OVER (PARTITION BY depth, prefix) AS BIGINT) AS shard_bytes FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY depth) AS pick FROM b WHERE shard_bytes <= {limit} OR depth = {BITS})
SELECT doc_id, depth || ':' || prefix AS shard, depth, n_bytes, shard_bytes, shard_bytes > {limit} AS oversize FROM r WHERE pick = 1"""
