"""Sharding by weighted rendezvous hashing of stable record keys.

Every shard scores every key, ``-weight / ln(u(key, shard))``, and the highest score owns the key. A
new shard can only win keys for itself, so growing from n to n + 1 shards moves one row in n + 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..iterate import cut

CHUNK = 65_536  # copies of one identical row that are numbered by one expansion


def score(key: Column, shard: int, weight: float = 1.0) -> Column:
    """Score of ``shard`` for ``key``; u has 52 bits of md5, never 0 or 1."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{shard}"))), 1, 13), 16, 10).cast("double")
    return -F.lit(float(weight)) / F.ln((bits + 0.5) / F.lit(float(1 << 52)))


def owner(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the highest score; ties go to the higher number."""
    return F.array_max(F.array(*[F.struct(score(key, i, w).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]))["shard"]


def shard_rows(docs: DataFrame, weights: Sequence[float] = (1.0,) * 16, grown: Sequence[float] = (1.0,), rows_per_bucket: int = 20_000) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` per row of ``docs(doc_id, text)``.

    ``size``: UTF-8 bytes plus 1 (null text: 1, and the checksum of the empty text). ``shard`` depends
    on the id and the weights alone; rows without id share one key. ``grown_shard``: with the shards of
    ``grown`` added. ``slot`` numbers the rows of a shard from 0 without gaps, by a hash of the id, then id (null last),
    size and checksum: rows are range-partitioned in that order, counted by (shard, partition), offsets are running
    sums of those counts and only one partition is ranked at a time, so a shard is never one task, nor are the rows
    of one id or without id. Identical rows are counted once and numbered in chunks.
    Empty table: no rows; other columns are not read.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    text = F.coalesce(F.col("text"), F.lit(""))
    placed = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    copies = placed.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    # one pass of hashing: the present shards' winner, then the new shards against it
    old = F.array_max(F.array(*[F.struct(score(key, i, w).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]))
    new = F.array_max(F.array(F.col("best"), *[F.struct(score(key, len(weights) + i, w).alias("score"), F.lit(len(weights) + i).alias("shard")) for i, w in enumerate(grown)]))
    order = F.conv(F.substring(F.md5(F.concat(F.lit("slot/"), key)), 1, 15), 16, 10).cast("long")
    place = [F.col("shard"), F.col("h"), F.col("doc_id").asc_nulls_last(), F.col("size"), F.col("text_crc32")]
    ranked = copies.withColumn("best", old).select("doc_id", "size", "text_crc32", "copies", F.col("best.shard").alias("shard"), new["shard"].alias("grown_shard"), order.alias("h"))
    ranged = ranked.repartitionByRange(1 + docs.count() // rows_per_bucket, *place)
    stored = cut(ranged.withColumn("bucket", F.spark_partition_id()))
    counts = stored.groupBy("shard", "bucket").agg(F.sum("copies").alias("rows"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy(*place[1:]).rowsBetween(Window.unboundedPreceding, -1)
    first = stored.withColumn("start", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(offsets, ["shard", "bucket"]).withColumn("start", F.col("start") + F.col("offset"))
    chunks = first.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / CHUNK))))
    size = F.least(F.lit(CHUNK).cast("long"), F.col("copies") - F.col("chunk") * CHUNK)
    one = chunks.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), size - 1)))
    return one.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"), (F.col("start") + F.col("chunk") * CHUNK + F.col("k")).alias("slot"), F.col("grown_shard").cast("int")
    )
