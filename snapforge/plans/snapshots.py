"""Registered queries that build snapshots in the shared folder and read them back, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snapforge.errors import ConfigError, SnapshotError
from snapforge.functions.keys import callable_value, json_value
from snapforge.metrics import Recorder
from snapforge.operators import lifecycle
from snapforge.operators.sharding import SHARD, ExpressionSharding, HashSharding, few_groups
from snapforge.operators.snapshot import build_snapshot
from snapforge.operators.vector_snapshot import ColumnSharding, PlaneSharding, VectorSnapshot, build_vector_snapshot
from snapforge.plans.catalog import EVERY, K, VECTORS, _distance_sql, _ranked_sql, _shared, query, table
from snapforge.plans.sql import hashed
from snapforge.sources.attempts import attempts_in, clean_attempts
from snapforge.sources.manifest import Files, Manifest, ManifestStore, MemoryFiles
from snapforge.sources.reader import Snapshot
from snapforge.sources.records import Columns, from_records
from snapforge.sources.runs import RunRegistry


def _root(spark: SparkSession) -> str:
    return f"{_shared(spark)}/snapshot-{uuid.uuid4().hex}"


def _text(name: str):  # noqa: ANN202
    return F.encode(F.col(name).cast("string"), "UTF-8")


def _orders(spark: SparkSession, sf_dir: str, root: str, shards: int = 8) -> Snapshot:
    build_snapshot(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), root, "o_orderkey", _text("o_orderstatus"), HashSharding(shards))
    return Snapshot(spark, root)


@query("SELECT k AS key, o_orderstatus AS v, o_orderkey IS NOT NULL AS found FROM range(0, 30000, 30) r(k) LEFT JOIN orders ON o_orderkey = k")
def snapshot_get_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of 1,000 keys, looked up in their own shards."""
    found = _orders(spark, sf_dir, _root(spark)).multi_get(list(range(0, 30_000, 30)))
    return found.select("key", F.decode("v", "UTF-8").alias("v"), "found")


@query("SELECT 7::BIGINT AS key, (SELECT o_orderstatus FROM orders WHERE o_orderkey = 7) AS v")
def snapshot_point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _orders(spark, sf_dir, _root(spark)).get(7)
    return spark.createDataFrame([(7, None if v is None else v.decode())], "key bigint, v string")


@query("SELECT o_orderkey AS key, o_orderstatus AS v FROM orders WHERE o_orderkey >= 500 AND o_orderkey < 1500")
def snapshot_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _orders(spark, sf_dir, _root(spark)).scan(500, 1500)
    return found.select(F.conv(F.hex("k"), 16, 10).cast("long").alias("key"), F.decode("v", "UTF-8").alias("v"))


@query("SELECT 5 AS key, NULL::VARCHAR AS v, 0::BIGINT AS row_count, 4::BIGINT AS num_shards")
def snapshot_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot of no rows opens, and every key misses."""
    root = _root(spark)
    build_snapshot(table(spark, sf_dir, "orders").where("o_orderkey < 0"), root, "o_orderkey", _text("o_orderstatus"), HashSharding(4))
    s = Snapshot(spark, root)
    assert s.get(5) is None and s.scan().count() == 0
    return s.shards().agg(F.lit(5).alias("key"), F.lit(None).cast("string").alias("v"), F.sum("row_count").alias("row_count"), F.count("*").alias("num_shards"))


@query(f"SELECT (h % 8)::INT AS shard_id, count(*) AS row_count, min(o_orderkey) AS min_key, max(o_orderkey) AS max_key, sum(8 + octet_length(encode(o_orderstatus)))::BIGINT AS db_bytes FROM ({hashed('orders', 'o_orderkey', 'o_orderkey, o_orderstatus')}) GROUP BY 1")
def snapshot_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard table that a build wrote."""
    return _orders(spark, sf_dir, _root(spark)).shard_table.select(F.col(SHARD).alias("shard_id"), "row_count", "min_key", "max_key", "db_bytes")


@query("SELECT 'o_orderkey' AS key_column, 'u64be' AS key_encoding, 8 AS num_shards, count(*) AS rows_written FROM orders")
def snapshot_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the published manifest says, read back."""
    root = _root(spark)
    _orders(spark, sf_dir, root)
    m = ManifestStore(spark, root).load_latest()
    return spark.createDataFrame([(m.key_column, m.key_encoding, m.num_shards, m.rows_written)], "key_column string, key_encoding string, num_shards int, rows_written bigint")


HISTORY = "SELECT * FROM (VALUES ('third', 2, 0), ('second', 1, 1), ('first', 0, 2)) t(run_id, n_rows, place)"


def _three(spark: SparkSession, sf_dir: str, root: str) -> ManifestStore:
    for i, name in enumerate(("first", "second", "third")):
        build_snapshot(table(spark, sf_dir, "region").where(F.col("r_regionkey") < i).select(F.col("r_regionkey").cast("long").alias("k"), "r_name"), root, "k", _text("r_name"), HashSharding(2), run_id=name)
    return ManifestStore(spark, root)


@query(HISTORY)
def manifest_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of a store, newest first."""
    store = _three(spark, sf_dir, _root(spark))
    rows = {m.run_id: m.rows_written for m in store.manifests()}
    sizes = spark.createDataFrame(list(rows.items()), "run_id string, n_rows int")
    return lifecycle.ranked(store.history()).select("run_id", F.col("place").cast("int").alias("place")).join(sizes, "run_id")


@query("SELECT * FROM (VALUES ('published', 'third'), ('rolled back by 1', 'second'), ('rolled back to', 'first'), ('refreshed', 'first')) t(step, run_id)")
def publish_and_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current run after each step, and what an open reader sees once it refreshes."""
    root = _root(spark)
    store = _three(spark, sf_dir, root)
    reader = Snapshot(spark, root)
    steps = [("published", store.current()), ("rolled back by 1", store.rollback(offset=1)), ("rolled back to", store.rollback(run_id="first"))]
    assert reader.refresh() and not reader.refresh()
    return spark.createDataFrame([*steps, ("refreshed", reader.manifest.run_id)], "step string, run_id string")


@query("SELECT 'second' AS run_id")
def cold_start_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current manifest can't be read: a reader opens the newest other."""
    root = _root(spark)
    _three(spark, sf_dir, root).files.write("runs/run_id=third/manifest", "{broken")
    return spark.createDataFrame([(Snapshot(spark, root).manifest.run_id,)], "run_id string")


@query("SELECT * FROM (VALUES ('first', 'deleted'), ('second', 'deleted'), ('unpublished', 'deleted'), ('third', 'kept')) t(run_id, state)")
def cleanup_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old runs and one that was never published are deleted, the current one is not."""
    root = _root(spark)
    store = _three(spark, sf_dir, root)
    table(spark, sf_dir, "region").write.parquet(store.folder("unpublished", "data"))
    gone = store.clean(keep_last=1, unpublished=True, dry_run=False)
    return spark.createDataFrame([*[(r, "deleted") for r in gone], *[(r, "kept") for r in store.run_ids()]], "run_id string, state string")


@query("SELECT count(*) AS n, sum(n_nationkey)::BIGINT AS total, min(n_name) AS first, max(n_regionkey)::BIGINT AS region FROM nation")
def records_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python records by functions of a record: key, value, a routing column."""
    records = (r.asDict() for r in table(spark, sf_dir, "nation").toLocalIterator())
    made = from_records(spark, records, lambda r: r["n_nationkey"], lambda r: r["n_name"].encode(), Columns(region=lambda r: r["n_regionkey"]), batch=7)
    return made.agg(F.count("*").alias("n"), F.sum("key").alias("total"), F.decode(F.min("value"), "UTF-8").alias("first"), F.max("region").alias("region"))


@query("SELECT n_nationkey, upper(n_name) || ':' || n_regionkey AS v FROM nation")
def value_callable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by a function of a row."""
    df = table(spark, sf_dir, "nation")
    return df.select("n_nationkey", F.decode(callable_value(df.columns, lambda r: f"{r['n_name'].upper()}:{r['n_regionkey']}".encode()), "UTF-8").alias("v"))


@query("SELECT c_custkey AS key, c_mktsegment AS segment FROM customer")
def snapshot_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards by the distinct values of a column; every key is found through the column it was routed by."""
    root = _root(spark)
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    build_snapshot(df, root, "c_custkey", json_value(df, ["c_mktsegment"]), ExpressionSharding("c_mktsegment", {"c_mktsegment": "string"}, infer=True))
    keys = df.select(F.col("c_custkey").alias("pos"), F.col("c_custkey").alias("key"), "c_mktsegment")
    found = Snapshot(spark, root).multi_get(keys).where("found")
    return found.select("key", F.get_json_object(F.decode("v", "UTF-8"), "$.c_mktsegment").alias("segment"))


REFUSED = "SELECT * FROM (VALUES ('a shard beyond the last', true), ('a column named as the shard', true), ('a null key', true), ('a repeated key', true), ('a repeated vector id', true), ('an unknown category', true)) t(what, refused)"


@query(REFUSED)
def builds_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a build refuses; nothing of it is published."""
    df = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), "n_name")
    value = _text("n_name")
    vectors = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 7).alias("vec_id"), "embedding", F.lit(0).alias("s"))
    tries = {
        "a shard beyond the last": lambda root: build_snapshot(df, root, "id", value, ExpressionSharding("id % 4", {"id": "int"}, num_shards=3)),
        "a column named as the shard": lambda root: build_snapshot(df.withColumn(SHARD, F.lit(1)), root, "id", value, HashSharding(3)),
        "a null key": lambda root: build_snapshot(df.withColumn("id", F.when(F.col("id") > 3, F.col("id"))), root, "id", value, HashSharding(3)),
        "a repeated key": lambda root: build_snapshot(df.withColumn("id", F.col("id") % 5), root, "id", value, HashSharding(3)),
        "a repeated vector id": lambda root: build_vector_snapshot(vectors, root, "vec_id", "embedding", ColumnSharding(1, "s")),
        "an unknown category": lambda root: build_snapshot(df, root, "id", value, ExpressionSharding("n_name", {"n_name": "string"}, routing_values=["nowhere"])),
    }
    rows = []
    for what, build in tries.items():
        root = _root(spark)
        try:
            build(root)
            refused = False
        except (SnapshotError, Exception):  # noqa: BLE001, B014
            refused = True
        rows.append((what, refused and ManifestStore(spark, root).current() is None))
    return spark.createDataFrame(rows, "what string, refused boolean")


@query("SELECT * FROM (VALUES ('good', 'succeeded', true), ('bad', 'failed', true)) t(run_id, status, has_lease)")
def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of a build that ends well and of one that is refused."""
    root = _root(spark)
    df, registry = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("k"), "r_name"), RunRegistry(spark, root)
    build_snapshot(df, f"{root}/s", "k", _text("r_name"), HashSharding(2), run_id="good", registry=registry)
    try:
        build_snapshot(df.withColumn("k", F.lit(1).cast("long")), f"{root}/s", "k", _text("r_name"), HashSharding(2), run_id="bad", registry=registry)
    except ConfigError:
        pass
    return registry.records().select("run_id", "status", F.col("lease_until").isNotNull().alias("has_lease"))


@query("SELECT r_regionkey::INT AS db_id, 'db=' || lpad(r_regionkey::VARCHAR, 5, '0') || '/attempt=' || CASE WHEN r_regionkey % 2 = 0 THEN '00' ELSE '01' END AS kept FROM region")
def attempts_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tries at each shard; of odd shards the second won. The tries that lost are deleted."""
    root = _root(spark)
    shards = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("db_id"))
    tries = [f"db={r['db_id']:05d}/attempt={n:02d}" for r in shards.toLocalIterator() for n in (0, 1)]
    for name in tries:
        Files(spark, root).write(f"{name}/rows", name)
    found = attempts_in(spark, root)
    winners = lifecycle.select_winners(found.where("attempt = db_id % 2").withColumn("task_attempt_id", F.lit(None).cast("long")))
    assert len(clean_attempts(spark, root, winners)) == len(tries) // 2 == len(clean_attempts(spark, root, winners, dry_run=False))
    return attempts_in(spark, root).select("db_id", F.regexp_extract("db_url", "(db=.*)", 1).alias("kept"))


@query("SELECT count(*) AS n, true AS in_order, 4 AS files FROM orders")
def single_sorted_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One shard, its files sorted and split by ranges of keys: no file's keys reach into another's."""
    root = _root(spark)
    build_snapshot(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), root, "o_orderkey", _text("o_orderstatus"), HashSharding(1), files_per_shard=4)
    rows = Snapshot(spark, root).kv.select("k", F.input_file_name().alias("file"))
    spans = few_groups(rows, "file", F.count("*").alias("n"), F.min("k").alias("low"), F.max("k").alias("high"))  # a row for each file
    before = F.lag("high").over(Window.orderBy("low"))
    return spans.select("n", (F.coalesce(before < F.col("low"), F.lit(True))).alias("ok")).agg(F.sum("n").alias("n"), F.bool_and("ok").alias("in_order"), F.count("*").cast("int").alias("files"))


@query("SELECT * FROM (VALUES ('reader_opened', 1), ('lookup', 2), ('reader_refreshed', 1), ('reader_closed', 1), ('write_started', 2), ('shards_written', 2), ('published', 2)) t(event, n)")
def events_emitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two builds and a reader tell their collector."""
    root, seen = _root(spark), Recorder()
    df = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("k"), "r_name")
    build_snapshot(df, root, "k", _text("r_name"), HashSharding(2), emit=seen)
    with Snapshot(spark, root, emit=seen) as s:
        build_snapshot(df, root, "k", _text("r_name"), HashSharding(3), emit=seen)
        assert s.get(0) is not None and s.refresh() and len(s.get_many([0, 1, 9])) == 3
    return spark.createDataFrame(list(seen.counts.items()), "event string, n int")


@query("SELECT * FROM (VALUES ('b', 0), ('a', 1)) t(run_id, place)")
def memory_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests kept in memory: published, listed, rolled back, deleted."""
    store = ManifestStore(spark, "memory", MemoryFiles())
    for i, name in enumerate(("gone", "a", "b")):
        store.publish(Manifest(name, f"2024-01-0{i + 1}T00:00:00+00:00", 1, "k", "bigint", "u64be", {"strategy": "hash"}))
    assert store.rollback(offset=1) == "a" == store.load_latest().run_id and store.clean(keep_last=2, dry_run=False) == ["gone"]
    return lifecycle.ranked(store.history()).select("run_id", F.col("place").cast("int").alias("place"))


@query(f"WITH {VECTORS} SELECT vec_id, len(e) AS n, (vec_id % 3)::INT AS shard FROM v")
def vectors_coerced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors given as strings, and ids as floating numbers, in a snapshot by a column."""
    root = _root(spark)
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("double").alias("vec_id"), F.to_json("embedding").alias("embedding"), (F.col("vec_id") % 3).cast("int").alias("s"))
    build_vector_snapshot(own, root, "vec_id", "embedding", ColumnSharding(3, "s"))
    return VectorSnapshot(spark, root).rows.select("vec_id", F.size("embedding").cast("long").alias("n"), "shard")


@query(f"WITH {VECTORS} SELECT vec_id AS query_id, vec_id, 1 AS rank FROM v WHERE vec_id % {EVERY} = 0")
def vectors_by_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards by the signs of projections on random planes: each vector is found in the one shard it is sent to."""
    root = _root(spark)
    own = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    build_vector_snapshot(own, root, "vec_id", "embedding", PlaneSharding(8, bits=5))
    reader = VectorSnapshot(spark, root)
    asked = {i: r for i, r in enumerate(own.where(F.col("vec_id") % EVERY == 0).toLocalIterator())}
    hits = reader.search([r["embedding"] for r in asked.values()], k=1, num_probes=1)
    ids = spark.createDataFrame([(i, r["vec_id"]) for i, r in asked.items()], "query_id int, id bigint")
    return hits.join(ids, "query_id").select(F.col("id").alias("query_id"), "vec_id", "rank")


ASKED_SQL = f"q AS (SELECT vec_id AS query_id, e AS q FROM v WHERE vec_id % {EVERY} = 0)"


@query(f"WITH {VECTORS}, {ASKED_SQL} {_ranked_sql('SELECT query_id, vec_id, ' + _distance_sql('q', 'e', 'cosine') + ' AS score FROM q, v')} WHERE rank <= {K}")
def vector_snapshot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by a column that names their shard, searched in all shards for every 50th vector."""
    root = _root(spark)
    own = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label", (F.col("vec_id") % 4).cast("int").alias("s"))
    build_vector_snapshot(own, root, "vec_id", "embedding", ColumnSharding(4, "s"), payload=["label"], metric="cosine")
    asked = own.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return VectorSnapshot(spark, root).search_table(asked, K).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@query(f"WITH {VECTORS}, {ASKED_SQL} SELECT query_id, rank, vec_id, score, lang FROM ({_ranked_sql('SELECT query_id, vec_id, ' + _distance_sql('q', 'e', 'l2') + ' AS score FROM q, v')} WHERE rank <= {K}) JOIN documents ON doc_id = vec_id")
def unified_snapshot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One snapshot of values and vectors: hits come with their row's value."""
    root = _root(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    build_snapshot(docs, root, "doc_id", _text("lang"), HashSharding(4), vector=("vec_id", "embedding", ["label"]))
    asked = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    hits = Snapshot(spark, root).search(asked, K)
    return hits.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"), F.decode("v", "UTF-8").alias("lang"))
