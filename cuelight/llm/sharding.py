"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

The shard of a row depends on its stable key and on the number of shards
alone, so no ring table is kept and nothing has to be broadcast. When shard
``n`` is appended, a row either stays where it is or goes to shard ``n``.

Slots number the rows of a shard without gaps. A shard holds an unbounded
number of rows, so no task ever sees a whole shard: rows are dealt to
``buckets`` per shard, counted there (partial aggregation), and a slot is the
prefix sum of the earlier buckets plus the rank in the own bucket. What is
broadcast has ``shards * buckets`` rows, whatever the input.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelight.llm.common import stable, text_of

#: The multiplier of the generator in the published algorithm (fixed value).
JUMP_MULTIPLIER = np.uint64(2862933555777941757)


def jump_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, 0 to ``shards - 1``, of each 64-bit key."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    state = np.ascontiguousarray(keys).astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(state), np.int64)
    moving = np.arange(len(state))
    jump = np.zeros(len(state), np.int64)
    with np.errstate(over="ignore"):
        while len(moving):
            shard[moving] = jump[moving]
            state[moving] = state[moving] * JUMP_MULTIPLIER + np.uint64(1)
            span = (state[moving] >> np.uint64(33)).astype(np.float64) + 1.0
            jump[moving] = ((shard[moving] + 1) * (2.0**31 / span)).astype(np.int64)
            moving = moving[jump[moving] < shards]
    return shard


def shard_column(key: Column, shards: int) -> Column:
    """Shard of a 64-bit key column, evaluated on Arrow batches of keys only."""

    @F.pandas_udf("int")
    def jump(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_shard(keys.to_numpy(), shards).astype(np.int32))

    return jump(key)


def shard_documents(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", buckets: int = 256) -> DataFrame:
    """Key, size, crc32, shard, slot and the shard with one shard more, for each row.

    A null key is a key like any other; a null text has no bytes. Repeated rows
    share a shard and get slots of their own; among equal (key, text) rows the
    order of slots is arbitrary. An empty table gives an empty result. Columns
    of ``docs`` other than ``key`` and ``text`` are neither read nor returned.
    """
    hashed = F.xxhash64(F.col(key))
    narrow = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(text_of(text)) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.encode(text_of(text), "UTF-8")).alias("text_crc32"),
        shard_column(hashed, shards).alias("shard"),
        shard_column(hashed, shards + 1).alias("grown_shard"),
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)).cast("int").alias("bucket"),
    )
    narrow = stable(narrow)  # the bucket of a row must be the same in both passes
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        narrow.groupBy("shard", "bucket")
        .agg(F.count("*").alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    )
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (
        narrow.withColumn("rank", F.row_number().over(within))
        .join(F.broadcast(base), ["shard", "bucket"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("base") + F.col("rank") - 1).cast("long").alias("slot"),
            "grown_shard",
        )
    )


def write_shards(df: DataFrame, path: str, shards: int = 16, key: str = "doc_id") -> None:
    """All columns of ``df`` as Parquet under ``path``, one folder per shard."""
    name = "shard" if "shard" not in df.columns else "jump_shard"
    df.withColumn(name, shard_column(F.xxhash64(F.col(key)), shards)).write.partitionBy(name).parquet(path)
