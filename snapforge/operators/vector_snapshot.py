"""Vector snapshots: shards by cluster, by hyperplanes, by a column or by a routing expression; searches that probe a few shards."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import UTC, datetime

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapforge.errors import ConfigError, ManifestError, ShardAssignmentError, StateError
from snapforge.functions.vectors import metric_name
from snapforge.operators import vectors
from snapforge.operators.sharding import SHARD, ExpressionSharding, resolve_num_shards, shard_stats, with_shard_id
from snapforge.operators.snapshot import BAD_SHARD, new_run_id
from snapforge.sources.manifest import Manifest, ManifestStore


@dataclass(frozen=True)
class ClusterSharding:
    """By the nearest of num_shards centroids, given or trained on at most `sample` vectors."""

    num_shards: int
    centroids: np.ndarray | None = None
    sample: int = 100_000
    share: float = 0.1


@dataclass(frozen=True)
class PlaneSharding:
    """By the signs of projections on random hyperplanes."""

    num_shards: int
    bits: int = 8
    seed: int = 42


@dataclass(frozen=True)
class ColumnSharding:
    """By a column that has the shard."""

    num_shards: int
    column: str


def vector_id(df: DataFrame, name: str) -> Column:
    """An id as it is if it is an integer or a string, as an integer if it is another number or a boolean, else as a string."""
    kind = dict(df.dtypes)[name]
    if kind in ("tinyint", "smallint", "int", "bigint", "string"):
        return F.col(name)
    return F.col(name).cast("bigint" if kind in ("float", "double", "boolean") or kind.startswith("decimal") else "string")


def as_vector(df: DataFrame, name: str) -> Column:
    """A vector as floats, from an array of numbers or a string that lists them. A string that lists none is null, which a build refuses."""
    return F.from_json(F.col(name), "array<float>") if dict(df.dtypes)[name] == "string" else F.col(name).cast("array<float>")


def build_vector_snapshot(df: DataFrame, root: str, id_column: str, vector_column: str, sharding: ClusterSharding | PlaneSharding | ColumnSharding | ExpressionSharding, payload: Sequence[str] = (), metric: str = "l2", run_id: str | None = None) -> Manifest:
    """Write df's vectors under root by shard and make them current.

    Null vectors and repeated ids are an error; what routes them is kept beside them. Vectors are arrays of
    numbers or strings like "[0.5, 1]"; ids are integers or strings, other numbers become integers and the rest strings.
    """
    metric = metric_name(metric)
    store = ManifestStore(df.sparkSession, root)
    run_id = run_id or new_run_id()
    df = df.withColumn(id_column, vector_id(df, id_column)).withColumn(vector_column, as_vector(df, vector_column))
    vector = F.col(vector_column)
    routing: np.ndarray | None = None
    if isinstance(sharding, ClusterSharding):
        routing = sharding.centroids
        if routing is None:
            rows = df.select(vector.alias("embedding"))
            sample = vectors.sample_for_training(rows, sharding.sample, sharding.share)
            if len(sample) < sharding.num_shards:
                sample = vectors.sample_for_training(rows, sharding.sample, 1.0)
            routing = vectors.kmeans(sample, sharding.num_shards)
        shard, n, kind = vectors.assign_cluster(vector, routing, metric), sharding.num_shards, "cluster"
    elif isinstance(sharding, PlaneSharding):
        first = df.select(F.size(vector)).where(F.col(vector_column).isNotNull()).first()
        routing = vectors.hyperplanes(sharding.bits, first[0] if first else 1, sharding.seed)
        shard, n, kind = vectors.assign_lsh(vector, routing, sharding.num_shards), sharding.num_shards, "lsh"
    elif isinstance(sharding, ColumnSharding):
        shard, n, kind = F.col(sharding.column).cast("int"), sharding.num_shards, "explicit"
    else:
        kind, n = "expression", 0
    rows = with_shard_id(df, sharding, id_column) if kind == "expression" else df.withColumn(SHARD, shard)
    n = n or sharding.num_shards or resolve_num_shards(rows)
    rows = rows.withColumn(SHARD, F.when(vector.isNotNull(), F.col(SHARD)))
    valid = F.col(SHARD).isNotNull() & (F.col(SHARD) >= 0) & (F.col(SHARD) < n)
    wrong = F.raise_error(F.concat(F.lit(BAD_SHARD), F.coalesce(F.col(SHARD).cast("string"), F.lit("None")), F.lit(f" of {n}"))).cast("int")
    rows = rows.withColumn(SHARD, F.when(valid, F.col(SHARD)).otherwise(wrong))
    made = F.to_json(F.struct(*[F.col(c) for c in sorted(payload)]), {"ignoreNullFields": "false"}) if payload else F.lit(None).cast("string")
    table = rows.select(SHARD, F.col(id_column).alias("vec_id"), vector.alias("embedding"), made.alias("payload"))
    try:
        table.repartitionById(n, SHARD).sortWithinPartitions(SHARD, "vec_id").write.partitionBy(SHARD).parquet(store.folder(run_id, "data"))
    except Exception as error:
        store.files.delete(f"runs/run_id={run_id}")
        if found := re.search(re.escape(BAD_SHARD) + r"\S+ of \d+", str(error)):
            raise ShardAssignmentError(found[0]) from error
        raise
    schemas = {"data": table.schema}
    written = df.sparkSession.read.schema(table.schema).parquet(store.folder(run_id, "data"))
    stats = shard_stats(written, "vec_id")
    stats.coalesce(1).write.parquet(store.folder(run_id, "shards"))  # a row for each shard
    schemas["shards"] = stats.schema
    if repeated := written.groupBy("vec_id").count().where("count > 1").limit(1).collect():  # across shards: an id's vectors may lie in several
        store.files.delete(f"runs/run_id={run_id}")
        raise ConfigError(f"the vector id {repeated[0]['vec_id']} repeats")
    total = df.sparkSession.read.schema(stats.schema).parquet(store.folder(run_id, "shards")).agg(F.coalesce(F.sum("row_count"), F.lit(0))).first()[0]
    if routing is not None:
        for r in written.select(SHARD, "embedding").limit(20).collect():
            if _probe(kind, np.asarray(r["embedding"], np.float32), routing, n, 1, metric) != [r[SHARD]]:
                raise ShardAssignmentError("vectors are not assigned as a reader would route them")
        store.files.write(f"runs/run_id={run_id}/routing", json.dumps(routing.tolist()))
    custom = {"vector": {"id": id_column, "column": vector_column, "metric": metric, "sharding": kind}}
    manifest = Manifest(run_id, datetime.now(UTC).isoformat(), n, id_column, dict(df.dtypes)[id_column], "raw", {"strategy": kind}, int(total), custom=custom, schemas={part: made.json() for part, made in schemas.items()})
    store.publish(manifest)
    return manifest


def _probe(kind: str, q: np.ndarray, routing: np.ndarray, num_shards: int, num_probes: int, metric: str) -> list[int]:
    """The shards where a reader looks for a vector, the nearest first."""
    found = vectors.probe_clusters(q, routing, num_probes, metric) if kind == "cluster" else vectors.probe_lsh(q, routing, num_shards, num_probes)
    return [int(x) for x in found]


class VectorSnapshot:
    """A reader of the current vector snapshot, until refresh()."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, ManifestStore(spark, root)
        self._use(self.store.load_latest())

    def _use(self, manifest: Manifest) -> None:
        if "vector" not in manifest.custom:
            raise ConfigError("not a vector snapshot")
        self.manifest, self.metric = manifest, manifest.custom["vector"]["metric"]
        self.rows = self.store.data(manifest.run_id).withColumnRenamed(SHARD, "shard")
        text = self.store.files.read(f"runs/run_id={manifest.run_id}/routing")
        self.routing = None if text is None else np.array(json.loads(text), np.float32)

    def route(self, query: Sequence[float], num_probes: int = 1, shards: Sequence[int] | None = None) -> list[int]:
        """The shards that a query is sent to: those given, the nearest of a trained routing, or all."""
        if shards is not None:
            if bad := [s for s in shards if not 0 <= s < self.manifest.num_shards]:
                raise ConfigError(f"no such shards: {bad}")
            return list(shards)
        q, kind = np.asarray(query, np.float32), self.manifest.custom["vector"]["sharding"]
        return _probe(kind, q, self.routing, self.manifest.num_shards, num_probes, self.metric) if self.routing is not None else list(range(self.manifest.num_shards))

    def search(self, queries: Sequence[Sequence[float]], k: int = 10, num_probes: int = 1, shards: Sequence[int] | None = None) -> DataFrame:
        """(query_id, rank, vec_id, score, payload) for a batch of queries, numbered from 0. Only probed shards' folders are read."""
        asked = [(i, [float(x) for x in q], self.route(q, num_probes, shards)) for i, q in enumerate(queries)]
        frame = self.spark.createDataFrame(asked, "query_id int, embedding array<float>, shards array<int>")
        rows = self.rows.where(F.col("shard").isin(sorted({s for _, _, own in asked for s in own})))
        return vectors.exact_search(rows, frame, k, self.metric, carry=("payload",))

    def search_table(self, queries: DataFrame, k: int = 10, shards: Sequence[int] | None = None) -> DataFrame:
        """The same for a table (query_id, embedding) of queries, in all shards or those given."""
        rows = self.rows if shards is None else self.rows.where(F.col("shard").isin(list(shards)))
        return vectors.exact_search(rows, queries, k, self.metric, carry=("payload",))

    def shards(self) -> DataFrame:
        ids = self.spark.range(self.manifest.num_shards).select(F.col("id").cast("int").alias(SHARD))
        return ids.join(self.store.shards(self.manifest.run_id), SHARD, "left").withColumn("row_count", F.coalesce("row_count", F.lit(0)))

    def refresh(self) -> bool:
        try:
            run_id = self.store.current()
            made = None if run_id in (None, self.manifest.run_id) else self.store.load(run_id)
        except (ManifestError, StateError):
            return False
        if made is None:
            return False
        self._use(made)
        return True
