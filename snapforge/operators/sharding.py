"""Which shard a row goes to: by key hash, by routing expression, or by vector; and the statistics of shards."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapforge.errors import ConfigError, ShardAssignmentError
from snapforge.functions.expressions import by_columns, check_columns, check_routing_values, compile_expression
from snapforge.functions.hashing import hash_shard, shard_of

SHARD = "_shard_id"
#: Categories up to so many are compared in place; longer lists are joined, and Spark checks their size before it broadcasts them.
IN_PLACE = 256
#: Categories that may be inferred: they are held by the driver and the manifest.
MAX_CATEGORIES = 100_000


@dataclass(frozen=True)
class HashSharding:
    """By the hash of the key, over num_shards, or over as many as max_keys_per_shard needs."""

    num_shards: int | None = None
    max_keys_per_shard: int | None = None

    def __post_init__(self):
        if (self.num_shards is None) == (self.max_keys_per_shard is None):
            raise ConfigError("give num_shards or max_keys_per_shard")
        if (self.num_shards or self.max_keys_per_shard or 0) < 1:
            raise ConfigError("shards and keys per shard are positive")


@dataclass(frozen=True)
class ExpressionSharding:
    """By a routing expression: its integers are shards, or its values are categories.

    routing_values: the categories, a value's place being its shard; `infer`: they are the distinct
    values that occur, in order.
    """

    expression: str
    columns: Mapping[str, str] = field(default_factory=dict)
    routing_values: Sequence | None = None
    infer: bool = False
    num_shards: int | None = None

    def __post_init__(self):
        kind = compile_expression(self.expression, self.columns, lambda name: F.col(name)).type if _active() else None
        if self.routing_values is not None:
            if self.infer:
                raise ConfigError("routing values are given or inferred")
            check_routing_values(self.routing_values)
        elif not self.infer and kind == "bytes":
            raise ConfigError("shards are numbers: give routing values, or infer them")

    @classmethod
    def by_columns(cls, columns: Mapping[str, str], num_shards: int | None = None, separator: str = ":") -> ExpressionSharding:
        return cls(by_columns(columns, num_shards, separator), columns, infer=num_shards is None, num_shards=num_shards)


def _active() -> bool:
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession() is not None


def check_no_clash(df: DataFrame, name: str = SHARD) -> None:
    if name in df.columns:
        raise ConfigError(f"the input has a column {name} of its own")


def num_shards_for(df: DataFrame, max_keys_per_shard: int) -> int:
    """max(1, ceil(rows / max_keys_per_shard))."""
    return max(1, math.ceil(df.count() / max_keys_per_shard))


def num_shards_frame(df: DataFrame, max_keys_per_shard: int) -> DataFrame:
    """The same as one row, without an action."""
    return df.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(max_keys_per_shard))).cast("long").alias("num_shards"))


def tokens(df: DataFrame, sharding: ExpressionSharding) -> DataFrame:
    """(token, shard): the distinct categories in order. One row per shard; null categories are left out."""
    made = compile_expression(sharding.expression, sharding.columns)
    distinct = df.select(made.column.alias("token")).where("token IS NOT NULL").distinct()
    return distinct.select("token", (F.row_number().over(Window.orderBy("token")) - 1).alias("shard"))


def infer_routing_values(df: DataFrame, sharding: ExpressionSharding) -> list:
    """The distinct categories in order, a shard each; more than MAX_CATEGORIES are an error. Strings are in the order of their UTF-8 bytes, as in `tokens`."""
    made = compile_expression(sharding.expression, sharding.columns)
    found = [r[0] for r in df.select(made.column.alias("token")).where("token IS NOT NULL").distinct().limit(MAX_CATEGORIES + 1).collect()]
    if len(found) > MAX_CATEGORIES:
        raise ConfigError(f"more than {MAX_CATEGORIES} categories: each would be a shard")
    return sorted(bytes(v) if isinstance(v, bytearray) else v for v in found)  # code points order as UTF-8 bytes do


def token_shard(df: DataFrame, token: Column, values: Sequence, name: str = SHARD, strict: bool = True) -> DataFrame:
    """df with the place of each row's token among values. Unknown tokens are an error, or null if not strict."""
    refuse = F.raise_error(F.concat(F.lit("no such routing value: "), F.coalesce(token.cast("string"), F.lit("null")))).cast("int")
    if len(values) <= IN_PLACE:
        at = F.array_position(F.array(*[F.lit(v) for v in values]), token) if values else F.lit(None).cast("long")
        found = F.when(F.coalesce(at, F.lit(0)) > 0, (at - 1).cast("int"))
        return df.withColumn(name, found.otherwise(refuse) if strict else found)
    rows = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(values)], f"_value {'bigint' if isinstance(values[0], int) else 'string' if isinstance(values[0], str) else 'binary'}, _place int")
    joined = df.withColumn("_token", token).join(rows, F.col("_token") == F.col("_value"), "left")
    found = F.when(F.col("_place").isNotNull(), F.col("_place"))
    return joined.withColumn(name, found.otherwise(F.raise_error(F.lit("no such routing value")).cast("int")) if strict else found).drop("_token", "_value", "_place")


def with_shard_id(df: DataFrame, sharding: HashSharding | ExpressionSharding, key: str, name: str = SHARD, strict: bool = True) -> DataFrame:
    """df with its rows' shards. Null keys and direct results that are null have a null shard, which a build refuses where it writes."""
    check_no_clash(df, name)
    if isinstance(sharding, HashSharding):
        n = sharding.num_shards or num_shards_for(df, sharding.max_keys_per_shard)
        return df.withColumn(name, hash_shard(F.col(key), n))
    check_columns(df, sharding.columns)
    made = compile_expression(sharding.expression, sharding.columns)
    if sharding.routing_values is not None or sharding.infer:
        values = sharding.routing_values if sharding.routing_values is not None else infer_routing_values(df, sharding)
        return token_shard(df, made.column, values, name, strict)
    return df.withColumn(name, made.column.cast("int"))


def dense_shards(df: DataFrame, name: str = SHARD) -> DataFrame:
    """num_shards, distinct_shards and dense: are the shards 0 to n - 1, each with rows. No rows: one shard."""
    x = df.agg(F.max(name).alias("m"), F.count_distinct(name).alias("d"))
    n = F.coalesce(F.col("m") + 1, F.lit(1)).cast("long")
    return x.select(n.alias("num_shards"), F.col("d").alias("distinct_shards"), (F.col("m").isNull() | (F.col("d") == n)).alias("dense"))


def resolve_num_shards(df: DataFrame, name: str = SHARD) -> int:
    found = dense_shards(df, name).first()
    if not found["dense"]:
        raise ShardAssignmentError(f"shards are not dense: {found['distinct_shards']} of {found['num_shards']} occur")
    return found["num_shards"]


def few_groups(df: DataFrame, by: str, *made: Column) -> DataFrame:
    """df.groupBy(by).agg(*made), where strings or bytes are among the least and greatest that are made.

    Spark can't change those in place, and for them sorts all rows of a task by group. A set beside them
    makes it hold each group's values as objects, in memory that grows with the groups instead. Over 128
    groups in one task (spark.sql.objectHashAggregate.sortBased.fallbackThreshold) it sorts what is left.
    """
    return df.groupBy(by).agg(*made, F.collect_set(F.lit(True)).alias("_held")).where(F.size("_held") > 0).drop("_held")


def shard_stats(df: DataFrame, key: str, name: str = SHARD) -> DataFrame:
    """Shard, row_count (input rows, repeated keys counted each), min_key and max_key. Combined before the shuffle."""
    made = F.count("*").alias("row_count"), F.min(key).alias("min_key"), F.max(key).alias("max_key")
    return few_groups(df, name, *made) if dict(df.dtypes)[key] in ("string", "binary") else df.groupBy(name).agg(*made)


def all_shards(stats: DataFrame, num_shards: int, name: str = SHARD) -> DataFrame:
    """stats with a row of no keys for every shard that has none."""
    ids = stats.sparkSession.range(num_shards).select(F.col("id").cast("int").alias(name))
    return ids.join(stats, name, "left").withColumn("row_count", F.coalesce("row_count", F.lit(0)))


def last_write_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key: that of the greatest order. Rows that tie on key and order are told apart by nothing.

    An aggregation rather than a window, so repeated keys are reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def routing_agrees(df: DataFrame, key: str, num_shards: int, rows: int = 20, name: str = SHARD) -> bool:
    """Do the shards of a few rows agree with what a reader computes for one key at a time."""
    return all(r[name] == shard_of(bytes(r[key]) if isinstance(r[key], bytearray) else r[key], num_shards) for r in df.select(key, name).limit(rows).collect())
