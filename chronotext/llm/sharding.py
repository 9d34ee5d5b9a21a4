"""Sharding by jump consistent hashing: a stable key and the number of shards decide where a row lives.

No ring or routing table is kept. Going from n to n + 1 shards, a row either stays or moves to the new shard, and
about 1 / (n + 1) of the rows move. Each row also gets its slot, a number without gaps from 0 within its shard, in
the order of (key, size, checksum), found from one range-partitioned pass and the row counts of its partitions.

Defined results: a null text has no bytes and the checksum of nothing; a null key counts as key 0; rows that are
repeated each get a slot of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key (Lamping and Veach's jump consistent hash), for all keys at once."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    state = keys.astype(np.int64).view(np.uint64).copy()
    at, ahead = np.zeros(len(state), np.int64), np.zeros(len(state), np.int64)
    going = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(going):
            at[going] = ahead[going]
            state[going] = state[going] * np.uint64(2862933555777941757) + np.uint64(1)
            ahead[going] = ((at[going] + 1) * (float(1 << 31) / ((state[going] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
            going = going[ahead[going] < shards]
    return at


def shard_of(key: F.Column, shards: int) -> F.Column:
    """The shard of an integer key as a column."""

    @F.pandas_udf("int")
    def find(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.fillna(0).to_numpy(np.int64), shards).astype(np.int32))

    return find(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def assign(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each row: its key, size (bytes of the text and 1), text_crc32, shard, slot, and grown_shard with one more shard."""
    raw = F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))
    rows = docs.select(F.col(key), (F.length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32"), shard_of(F.col(key), shards).alias("shard"), shard_of(F.col(key), shards + 1).alias("grown_shard"))
    # the row's own number last: no value, however often it occurs, is too large for a range
    ordered = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(F.col("shard"), F.col(key), F.col("size"), F.col("text_crc32"), F.col("_row"))
    order = ["shard", key, "size", "text_crc32", "_row"]
    placed = written(ordered.sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "shards")
    counts = placed.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    # a row for each partition and shard in it: at most partitions + shards of them
    before = counts.select("shard", "_part", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_part")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("shard", "_part").orderBy(*order[1:]))
    return placed.withColumn("_at", within).join(before, ["shard", "_part"]).select(key, "size", "text_crc32", "shard", (F.col("_before") + F.col("_at") - 1).cast("long").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int, key: str = "doc_id") -> None:
    """The rows of `docs` as one folder for each shard; adding a shard rewrites only the rows that move into it."""
    docs.withColumn("shard", shard_of(F.col(key), shards)).repartition("shard", F.pmod(F.xxhash64(key), F.lit(64))).write.partitionBy("shard").parquet(path)


def moved(docs: DataFrame, shards: int, key: str = "doc_id") -> DataFrame:
    """The rows that leave their shard when one more is appended, all of them for the new one."""
    return docs.where(shard_of(F.col(key), shards) != shard_of(F.col(key), shards + 1))
