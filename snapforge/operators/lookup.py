"""Lookups in a sharded table of (_shard_id, k, v): by key, by many keys, by range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapforge.operators.sharding import SHARD


def point(kv: DataFrame, shard: int, key: bytes) -> DataFrame:
    """The row of one key: the shard prunes folders, the key is pushed down to row groups."""
    return kv.where((F.col(SHARD) == shard) & (F.col("k") == F.lit(key)))


def multi_get(kv: DataFrame, keys: DataFrame) -> DataFrame:
    """keys (pos, _shard_id, k) with v, null where there is none, and found, which tells a null value from a miss. Repeated keys get a row each; keys without a shard miss."""
    return keys.join(kv.withColumn("found", F.lit(True)), [SHARD, "k"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def listed(kv: DataFrame, wanted: dict[int, list[bytes]]) -> DataFrame:
    """Rows of listed keys, given by shard: only these shards' folders are read, and in them the row groups that may hold a key."""
    keys = sorted({k for own in wanted.values() for k in own})
    return kv.where(F.col(SHARD).isin(sorted(wanted)) & F.col("k").isin([F.lit(k) for k in keys]) if keys else F.lit(False))


def key_range(kv: DataFrame, start: Column | bytes | None = None, end: Column | bytes | None = None) -> DataFrame:
    """Rows with start <= k < end in unsigned byte order; None is open. Not sorted."""
    own = lambda x: x if isinstance(x, Column) else F.lit(x)
    if start is not None:
        kv = kv.where(F.col("k") >= own(start))
    return kv if end is None else kv.where(F.col("k") < own(end))


def scan(kv: DataFrame, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
    """key_range in key order: a range-partitioned sort."""
    return key_range(kv, start, end).orderBy("k")


def group_keys(keys: DataFrame) -> DataFrame:
    """(_shard_id, keys): requested keys by shard in order of pos; those without a shard under null. For request lists, not tables."""
    return keys.groupBy(SHARD).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "k"))), lambda x: x["k"]).alias("keys"))


def shards_for_keys(keys: DataFrame, shards: DataFrame) -> DataFrame:
    """keys (pos, _shard_id, k) with their shard's row; shards without a row are empty: row_count 0, no url."""
    return keys.join(shards, SHARD, "left").withColumn("row_count", F.coalesce("row_count", F.lit(0)))


def ranked_in_shard(kv: DataFrame) -> DataFrame:
    """kv with each key's place in its shard."""
    return kv.withColumn("place", F.row_number().over(Window.partitionBy(SHARD).orderBy("k")) - 1)
