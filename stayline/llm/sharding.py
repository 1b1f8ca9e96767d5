"""Sharding by extendible hashing.

A document's key is 60 bits of a hash. A shard is a prefix of the keys: the shortest one
whose documents fit the byte limit. The bytes are first summed by a prefix fine enough
for nearly all shards, a table whose size follows the number of shards; every shorter
prefix is summed from it. Documents under a prefix that is still too large go through
another round with more bits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.operators.joins import fits_broadcast
from stayline.session import checkpointed

KEY_BITS = 60
MORE_BITS = 4
# of a directory that every task gets
DIRECTORY_BYTES = 8_000_000


def _key() -> Column:
    text = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("text"))
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def _directory(rows: DataFrame, least: int, bits: int, limit: int) -> DataFrame:
    """Each prefix of ``bits`` bits with its shard's depth, bytes and documents, or null if none fits.

    A prefix with a single key cannot be split and is a shard whatever its size.
    """
    fine = checkpointed(
        rows.groupBy(F.shiftright("key", KEY_BITS - bits).alias("fine")).agg(
            F.sum("bytes").alias("bytes"),
            F.count(F.lit(1)).alias("docs"),
            F.min("key").alias("low"),
            F.max("key").alias("high"),
        )
    )
    nodes = fine.withColumn("depth", F.explode(F.sequence(F.lit(least), F.lit(bits))))
    nodes = nodes.withColumn("prefix", F.expr(f"shiftright(fine, {bits} - depth)"))
    sums = (
        nodes.groupBy("depth", "prefix")
        .agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"), F.min("low").alias("low"), F.max("high").alias("high"))
        .where((F.col("bytes") <= limit) | (F.col("low") == F.col("high")) | (F.col("depth") == KEY_BITS))
    )
    fits = nodes.select("fine", "depth", "prefix").join(sums, ["depth", "prefix"])
    shard = fits.groupBy("fine").agg(F.min(F.struct("depth", "prefix", "bytes", "docs")).alias("shard"))
    return checkpointed(fine.select("fine").join(shard, "fine", "left"))


def assign_shards(docs: DataFrame, byte_limit: int) -> DataFrame:
    """Every row with its shard: the bits of its hash prefix, so that no shard exceeds the limit.

    Adds ``bytes`` (UTF-8 length of the text; null: 0), ``shard`` (a string of 0 and 1, empty
    if all rows fit one shard), ``depth`` (its length), ``shard_bytes`` and ``shard_docs``;
    input columns of these names are replaced. A shard is split only while it is too large.

    The key hashes id and text (a null counts as empty). A single document above the limit
    becomes a shard of its own, and so do equal rows that together exceed it: the hash cannot
    tell them apart, and ``shard_bytes`` says so.
    """
    added = ["bytes", "shard", "depth", "shard_bytes", "shard_docs"]
    named = {c: f"__{c}" for c in ("key", "fine")}
    rows = docs.select(
        *(c for c in docs.columns if c not in added),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"),
        _key().alias(named["key"]),
    )
    keys = checkpointed(rows.select(F.col(named["key"]).alias("key"), "bytes"))
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    least, bits = 0, min(KEY_BITS, MORE_BITS + max(1, math.ceil(math.log2(total / byte_limit + 1))))
    parts = []
    while True:
        directory = _directory(keys, least, bits, byte_limit)
        found = directory.where("shard IS NOT NULL").withColumnRenamed("fine", named["fine"])
        # the directory grows with the data: it is sent to every task only while it is small
        small = fits_broadcast(found, DIRECTORY_BYTES)
        found = F.broadcast(found) if small else found.hint("merge")
        at = F.shiftright(named["key"], KEY_BITS - bits)
        parts.append(
            rows.withColumn(named["fine"], at)
            .join(found, named["fine"])
            .select(
                *(c for c in rows.columns if c != named["key"]),
                F.when(F.col("shard.depth") == 0, "")
                .otherwise(F.lpad(F.bin("shard.prefix"), F.col("shard.depth"), F.lit("0")))
                .alias("shard"),
                F.col("shard.depth").cast("long").alias("depth"),
                F.col("shard.bytes").alias("shard_bytes"),
                F.col("shard.docs").alias("shard_docs"),
            )
        )
        missing = directory.where("shard IS NULL").select("fine")
        if missing.isEmpty():
            break
        keys = checkpointed(
            keys.withColumn("fine", F.shiftright("key", KEY_BITS - bits)).join(missing, "fine").drop("fine")
        )
        least, bits = bits + 1, min(KEY_BITS, bits + 2 * MORE_BITS)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write each shard to a folder of its own, from one task."""
    sharded.repartition("shard").write.partitionBy("shard").parquet(path)
