"""Building a snapshot: assign, shuffle one shard to a partition, write, count, publish."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapforge.errors import ConfigError, ShardAssignmentError
from snapforge.functions.keys import check_encoding, decode_key, encode_key
from snapforge.operators.sharding import SHARD, ExpressionSharding, HashSharding, check_no_clash, few_groups, infer_routing_values, last_write_wins, num_shards_for, resolve_num_shards, routing_agrees, with_shard_id
from snapforge.sources.manifest import Manifest, ManifestStore
from snapforge.sources.runs import RunRegistry


BAD_SHARD = "a row is assigned to shard "
REPEATED = "this key repeats: "


@dataclass(frozen=True)
class BuildResult:
    manifest: Manifest
    rows_written: int
    num_shards: int


def _describe(sharding: HashSharding | ExpressionSharding, values: Sequence | None) -> dict:
    if isinstance(sharding, HashSharding):
        return {"strategy": "hash", "algorithm": "xxh3_64"}
    show = lambda v: {"bytes": v.hex()} if isinstance(v, (bytes, bytearray)) else v
    return {"strategy": "expression", "expression": sharding.expression, "columns": dict(sharding.columns), "routing_values": None if values is None else [show(v) for v in values]}


def new_run_id() -> str:
    return f"{datetime.now(UTC):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"


def refuse_repeats(dealt: DataFrame, key: str, value: str, shown: Column) -> DataFrame:
    """dealt, whose `value` is an error in each second row of a key.

    Rows are dealt by shard already, so the window takes them as they lie, and its sort is that of the
    written files: repeats cost no shuffle of their own.
    """
    place = F.row_number().over(Window.partitionBy(SHARD, key).orderBy(key))
    kind = dealt.schema[value].dataType
    return dealt.withColumn("_place", place).withColumn(value, F.when(F.col("_place") > 1, F.raise_error(F.concat(F.lit(REPEATED), shown)).cast(kind)).otherwise(F.col(value))).drop("_place")


def build_snapshot(
    df: DataFrame, root: str, key: str, value: Column, sharding: HashSharding | ExpressionSharding, key_encoding: str = "u64be",
    order: Sequence[str] = (), vector: tuple[str, str, Sequence[str]] | None = None, run_id: str | None = None, custom: dict | None = None, files_per_shard: int = 1,
    emit: Callable[[str, dict], None] | None = None, registry: RunRegistry | None = None,
) -> BuildResult:
    """Write df as an immutable snapshot under root and make it current.

    Rows become (_shard_id, k, v), and with vector = (id column, vector column, payload columns) also
    (vec_id, embedding, payload). Of rows with one key the one of the greatest `order` is kept, while
    row counts are of input rows; without `order` repeated keys are an error, as shuffled rows have no order.
    One partition holds one shard, sorted by key, so lookups prune by folder and by row group. Shards
    too large for one task are split by key range over about files_per_shard tasks; that is also the way
    to one sorted shard of everything (HashSharding(1)). emit is called with events: see snapforge.metrics.
    registry keeps a record of the build while it runs, and of how it ended.
    """
    if registry is not None:
        run_id = run_id or new_run_id()
        with registry.running(run_id):
            return build_snapshot(df, root, key, value, sharding, key_encoding, order, vector, run_id, custom, files_per_shard, emit)
    emit = emit or (lambda event, fields: None)
    check_no_clash(df)
    check_encoding(dict(df.dtypes)[key], key_encoding)
    run_id = run_id or new_run_id()
    store = ManifestStore(df.sparkSession, root)
    values = None
    if isinstance(sharding, ExpressionSharding) and (sharding.infer or sharding.routing_values is not None):
        values = list(sharding.routing_values) if sharding.routing_values is not None else infer_routing_values(df, sharding)
        sharding = ExpressionSharding(sharding.expression, sharding.columns, routing_values=values)
    if isinstance(sharding, HashSharding) and sharding.num_shards is None:
        sharding = HashSharding(num_shards_for(df, sharding.max_keys_per_shard))
    rows = with_shard_id(df, sharding, key)
    if isinstance(sharding, HashSharding):
        n = sharding.num_shards
    elif values is not None:
        n = max(1, len(values))
    else:
        n = sharding.num_shards or resolve_num_shards(rows)
    if isinstance(sharding, HashSharding) and not routing_agrees(rows.where(F.col(key).isNotNull()), key, n):
        raise ShardAssignmentError("rows are not assigned as a reader would route their keys")
    # the shards are checked where they are written: the input isn't read for it
    valid = F.col(SHARD).isNotNull() & (F.col(SHARD) >= 0) & (F.col(SHARD) < n)
    wrong = F.raise_error(F.concat(F.lit(BAD_SHARD), F.coalesce(F.col(SHARD).cast("string"), F.lit("None")), F.lit(f" of {n}"))).cast("int")
    rows = rows.withColumn(SHARD, F.when(valid, F.col(SHARD)).otherwise(wrong))

    made = rows.select(SHARD, encode_key(F.col(key), key_encoding).alias("k"), value.alias("v"), *(_vector(*vector) if vector else ()), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    kept = last_write_wins(made, [SHARD, "k"], [f"_o{i}" for i in range(len(order))]) if order else made
    columns = [SHARD, "k", "v", *(["vec_id", "embedding", "payload"] if vector else [])]
    emit("write_started", {"run_id": run_id, "num_shards": n})
    dealt = kept.select(*columns).repartitionById(n, SHARD) if files_per_shard == 1 else kept.select(*columns).repartitionByRange(n * files_per_shard, SHARD, "k")
    shards = (dealt if order else refuse_repeats(dealt, "k", "v", F.hex("k"))).sortWithinPartitions(SHARD, "k")
    try:
        shards.write.partitionBy(SHARD).parquet(store.folder(run_id, "data"))
    except Exception as error:
        store.files.delete(f"runs/run_id={run_id}")
        if found := re.search(re.escape(BAD_SHARD) + r"\S+ of \d+", str(error)):
            raise ShardAssignmentError(found[0]) from error
        if found := re.search(re.escape(REPEATED) + r"([0-9A-F]*)", str(error)):
            raise ConfigError(f"the key {found[1].lower()} repeats: say which row is the last with order") from error
        raise
    written = df.sparkSession.read.schema(kept.select(*columns).schema).parquet(store.folder(run_id, "data"))
    kind = dict(df.dtypes)[key]
    stats = few_groups(  # the input is not read again, unless its rows were reduced
        written, SHARD, F.count("*").alias("num_keys"), F.min("k").alias("_min"), F.max("k").alias("_max"), F.sum(F.length("k") + F.coalesce(F.length("v"), F.lit(0))).cast("long").alias("db_bytes")
    )
    stats = stats.join(made.groupBy(SHARD).agg(F.count("*").alias("row_count")), SHARD) if order else stats.withColumn("row_count", F.col("num_keys"))
    stats = stats.select(SHARD, "row_count", "num_keys", decode_key(F.col("_min"), key_encoding, kind).alias("min_key"), decode_key(F.col("_max"), key_encoding, kind).alias("max_key"), "db_bytes")
    stats.coalesce(1).sortWithinPartitions(SHARD).write.parquet(store.folder(run_id, "shards"))  # a row for each shard
    total = df.sparkSession.read.schema(stats.schema).parquet(store.folder(run_id, "shards")).agg(F.coalesce(F.sum("row_count"), F.lit(0))).first()[0]
    schemas = {"data": kept.select(*columns).schema.json(), "shards": stats.schema.json()}
    manifest = Manifest(run_id, datetime.now(UTC).isoformat(), n, key, kind, key_encoding, _describe(sharding, values), int(total), schemas=schemas, custom=(custom or {}) | ({"vector": {"id": vector[0], "column": vector[1]}} if vector else {}))
    emit("shards_written", {"run_id": run_id, "rows_written": int(total)})
    store.publish(manifest)
    emit("published", {"run_id": run_id})
    return BuildResult(manifest, int(total), n)


def _vector(id_column: str, vector_column: str, payload: Sequence[str]) -> list[Column]:
    made = F.to_json(F.struct(*[F.col(c) for c in sorted(payload)]), {"ignoreNullFields": "false"}) if payload else F.lit(None).cast("string")
    return [F.col(id_column).alias("vec_id"), F.col(vector_column).cast("array<float>").alias("embedding"), made.alias("payload")]
