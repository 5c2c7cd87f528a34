"""Shards by proportional stratified interleaving.

Rows of each source are shuffled by a seeded hash and ranked; a row of rank r among n gets the
fractional rank (r + u) / n, where u in [0, 1) is a seeded hash of the source. Sorted by it, every
stretch of the table holds the sources in their proportions, so cutting the order into equal
numbers of rows gives shards with the mixture of the whole and row counts at most one apart (the
law `rows`). The offset u spreads the rows of sources that have only a few: without it all sources
of one row would meet in the middle.

Ranks and places come from counts of hash buckets and rows numbered inside a bucket: a source
with most of the rows is spread over all buckets, and no window holds more than a bucket.
Defined cases: a null source is a source of its own; a null text has no bytes; equal rows are
told apart by nothing, so either may take either place; an empty table gives no rows; further
columns stay, but for earlier ones named like the three added.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HASH_SPAN = 1 << 62
ADDED = ("fraction", "shard", "slot")


def _numbered(df: DataFrame, keys: list[str], bucket: str, *order: str) -> DataFrame:
    """shard_rank: rows before this one in (keys, bucket, order), counted per key."""
    groups = [*keys, bucket]
    counts = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("shard_n"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(
        Window.unboundedPreceding, -1)
    base = counts.select(*[F.col(g).alias(f"base_{g}") for g in groups],
                         F.coalesce(F.sum("shard_n").over(before), F.lit(0)).alias("shard_base"))
    inside = Window.partitionBy(*groups).orderBy(*order)
    match = F.lit(True)
    for g in groups:
        match = match & F.col(g).eqNullSafe(F.col(f"base_{g}"))
    return (df.withColumn("shard_rank", F.row_number().over(inside) - 1).join(base, match)
            .withColumn("shard_rank", F.col("shard_rank") + F.col("shard_base"))
            .drop("shard_base", *[f"base_{g}" for g in groups]))


def shards(docs: DataFrame, n_shards: int, source: str = "source", key: str = "doc_id",
           seed: int = 17) -> DataFrame:
    """`docs` with shard, slot (gapless from 0 in a shard) and fraction, its fractional rank.

    `docs` is read several times and carries its columns through two shuffles: give narrow
    columns and join the texts by key, or use `write_shards`.
    """
    total = docs.count()
    buckets = math.isqrt(total) + 1  # of about sqrt(total) rows each
    given = docs.select(F.struct(*[c for c in docs.columns if c not in ADDED]).alias("shard_row"),
                        F.col(source).alias("shard_source"), F.col(key).alias("shard_key"))
    rows = (given.withColumn("shard_hash", F.shiftrightunsigned(
                F.xxhash64(F.lit(seed), "shard_key"), 2))
            .withColumn("shard_bucket", F.floor(
                F.col("shard_hash") / F.lit(float(HASH_SPAN)) * buckets)))
    offset = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "shard_source"), 11) / F.lit(
        float(1 << 53))
    ranked = _numbered(rows, ["shard_source"], "shard_bucket", "shard_hash", "shard_key")
    per_source = given.groupBy(F.col("shard_source").alias("shard_name")).agg(
        F.count(F.lit(1)).alias("shard_of"))
    spread = (ranked.join(per_source, F.col("shard_source").eqNullSafe(F.col("shard_name")))
              .withColumn("fraction",
                          (F.col("shard_rank") + offset) / F.col("shard_of"))
              .withColumn("shard_bucket", F.floor(F.col("fraction") * buckets))
              .withColumn("shard_one", F.lit(0)))
    placed = _numbered(spread, ["shard_one"], "shard_bucket", "fraction", "shard_source",
                       "shard_key")
    # Row p of N goes to shard p * S div N; the first row of shard s is the ceiling of s * N / S.
    return (placed.withColumn("shard", F.expr(
                f"cast(shard_rank * {n_shards} div {total} as int)"))
            .withColumn("slot", F.expr(
                f"shard_rank - (cast(shard as long) * {total} + {n_shards} - 1) div {n_shards}"))
            .select("shard_row.*", *ADDED))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, key: str = "doc_id") -> None:
    """Write `docs` below `path` in a folder per shard, in slot order, joined by its key.

    A shard is written by as many tasks as its share of the rows needs; files follow slots.
    """
    (docs.join(placed.select(key, "shard", "slot"), key)
     .repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
