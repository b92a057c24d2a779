"""Sharding by jump consistent hashing (Lamping and Veach, 2014)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key. A key jumps from bucket to bucket until the next jump would leave
    the range; one more shard therefore only takes keys into itself and no ring table is kept."""
    state = keys.astype(np.uint64)
    at = np.full(len(state), -1, dtype=np.int64)
    ahead = np.zeros(len(state), dtype=np.int64)
    moving = np.flatnonzero(ahead < shards)
    with np.errstate(over="ignore"):
        while len(moving):
            at[moving] = ahead[moving]
            state[moving] = state[moving] * np.uint64(2862933555777941757) + np.uint64(1)
            draw = (state[moving] >> np.uint64(33)).astype(np.float64) + 1.0
            ahead[moving] = ((at[moving] + 1) * (float(1 << 31) / draw)).astype(np.int64)
            moving = moving[ahead[moving] < shards]
    return at


def jump_shard(key: Column, shards: int) -> Column:
    """Shard number 0 .. shards-1 of a 64-bit key column."""
    if shards < 1:
        raise ValueError("at least one shard")

    @F.pandas_udf("int")
    def numbered(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy(dtype=np.int64), shards).astype(np.int32))

    return numbered(key)


def assign_shards(
    docs: DataFrame,
    shards: int,
    key: str = "doc_id",
    text: str = "text",
    overhead: int = 16,
) -> DataFrame:
    """``docs`` (all its columns but the text) with size, text_crc32, law, shard, slot, grown_shard.

    The key alone and the number of shards decide the shard; the text stays where it is: only its
    size and checksum travel. Slots number the rows of a shard without gaps. They come from one
    shuffle on (shard, bucket): rows are numbered inside a bucket, and the sizes of earlier buckets
    (shards x buckets rows, whatever the data) are added. Buckets are hashes of the whole row, so
    neither a shard nor one repeated key makes a hot task.

    A null key hashes like a key of its own (one shard holds all of them); a null or empty text has
    size ``overhead`` and checksum 0; repeated rows share a shard and get slots of their own. An
    empty table gives an empty result. Columns of ``docs`` that are called like a result column are
    replaced by it.
    """
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    body = F.coalesce(F.col(text), F.lit(""))
    kept = [c for c in docs.columns if c not in {text, "size", "text_crc32", "law", "shard", "slot", "grown_shard"}]
    placed = docs.select(
        *kept,
        (F.octet_length(body) + F.lit(overhead)).cast("bigint").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.xxhash64(F.col(key)).alias("_key"),
    )
    placed = placed.select(
        "*",
        jump_shard(F.col("_key"), shards).alias("shard"),
        jump_shard(F.col("_key"), shards + 1).alias("grown_shard"),
        F.pmod(F.xxhash64("_key", "size", "text_crc32"), F.lit(buckets)).alias("_bucket"),
    )
    inside = Window.partitionBy("shard", "_bucket").orderBy(F.col(key).asc_nulls_last(), "text_crc32", "size")
    ranked = placed.withColumn("_place", F.row_number().over(inside))
    sizes = placed.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    return ranked.join(starts, ["shard", "_bucket"]).select(
        *kept,
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("_start") + F.col("_place") - 1).cast("bigint").alias("slot"),
        "grown_shard",
    )
