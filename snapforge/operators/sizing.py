"""Sizes: pages for a table of cells, and how to read a snapshot's shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_SIZES = (4096, 8192, 16384, 32768, 65536)
#: Bytes of a cell besides its key and value.
CELL_OVERHEAD = 12
SHARD_LIMIT, TOTAL_LIMIT = 16 << 20, 2 << 30


def inline_threshold(page: int) -> int:
    """The largest payload that a page of this size holds without overflow."""
    return (page - 12) * 64 // 255 - 23


def page_size(payload: Column) -> Column:
    """The least page that holds a payload inline, or the largest."""
    out = F.lit(PAGE_SIZES[-1])
    for page in reversed(PAGE_SIZES):
        out = F.when(payload <= inline_threshold(page), F.lit(page)).otherwise(out)
    return out.cast("int")


def recommend_page_size(cells: DataFrame, value_bytes: str, key_bytes: str) -> DataFrame:
    """p95_value_bytes (nearest rank), max_key_bytes and page_size. No cells: nulls and the least page.

    The percentile is exact, from counts by length, so no value is gathered.
    """
    made = cells.agg(F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value_bytes})").cast("long").alias("p95_value_bytes"), F.max(key_bytes).cast("long").alias("max_key_bytes"))
    payload = F.coalesce(F.col("p95_value_bytes"), F.lit(0)) + F.coalesce(F.col("max_key_bytes"), F.lit(0)) + CELL_OVERHEAD
    return made.withColumn("page_size", page_size(payload))


def access_mode(shards: DataFrame, db_bytes: str = "db_bytes", shard_limit: int = SHARD_LIMIT, total_limit: int = TOTAL_LIMIT) -> DataFrame:
    """max_bytes, total_bytes and mode: range if a shard or their total reaches its limit, else download."""
    made = shards.agg(F.coalesce(F.max(db_bytes), F.lit(0)).cast("long").alias("max_bytes"), F.coalesce(F.sum(db_bytes), F.lit(0)).cast("long").alias("total_bytes"))
    return made.withColumn("mode", F.when((F.col("max_bytes") >= shard_limit) | (F.col("total_bytes") >= total_limit), "range").otherwise("download"))
