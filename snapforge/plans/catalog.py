"""Registered queries of the snapshot engine over the test tables, and their SQL.

All run over whole tables. Vector searches ask every row whose id is divisible by EVERY, against all rows.
"""

from __future__ import annotations

import functools
import tempfile
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapforge.functions.expressions import compile_expression
from snapforge.functions.hashing import hash_digest, hash_shard
from snapforge.functions.keys import binary_value, encode_key, json_value, show_value
from snapforge.functions.vectors import distance
from snapforge.operators import lifecycle, lookup, sharding, sizing, vectors
from snapforge.operators.sharding import SHARD, ExpressionSharding, HashSharding
from snapforge.plans.sql import hashed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if there is one."""

    def add(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql:
            SQL[run.__name__] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shards(df: DataFrame, key: str, n: int) -> DataFrame:
    return sharding.with_shard_id(df, HashSharding(n), key)


# Sharding by hash


@query(f"SELECT (h % 8)::INT AS shard_id, count(*) AS row_count, min(o_orderkey) AS min_key, max(o_orderkey) AS max_key FROM ({hashed('orders', 'o_orderkey', 'o_orderkey')}) GROUP BY 1")
def hash_shard_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_stats(_shards(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 8), "o_orderkey").withColumnRenamed(SHARD, "shard_id")


@query(f"SELECT l_orderkey, l_linenumber, (h % 16)::INT AS shard_id FROM ({hashed('lineitem', 'l_orderkey', 'l_orderkey, l_linenumber')})")
def hash_shard_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shards(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", 16).withColumnRenamed(SHARD, "shard_id")


@query(f"SELECT p_partkey, h::VARCHAR AS digest FROM ({hashed('part', 'p_partkey', 'p_partkey')})")
def hash_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", hash_digest(F.col("p_partkey")).cast("string").alias("digest"))


@query()
def hash_shard_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String keys: XXH3 of their bytes, which SQL has no function for."""
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", hash_shard(F.col("c_name"), 7).alias("shard_id"))


@query("SELECT greatest(1, ceil(count(*) / 1000.0))::BIGINT AS num_shards FROM lineitem")
def num_shards_from_max_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.num_shards_frame(table(spark, sf_dir, "lineitem"), 1000)


@query(f"WITH s AS (SELECT (h % 512)::INT AS shard_id, count(*) AS row_count, min(s_suppkey) AS min_key, max(s_suppkey) AS max_key FROM ({hashed('supplier', 's_suppkey', 's_suppkey')}) GROUP BY 1) SELECT r.range::INT AS shard_id, coalesce(row_count, 0) AS row_count, min_key, max_key FROM range(512) r LEFT JOIN s ON s.shard_id = r.range")
def shard_empty_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = sharding.shard_stats(_shards(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey", 512), "s_suppkey")
    return sharding.all_shards(stats, 512).withColumnRenamed(SHARD, "shard_id")


# Keys and values


@query("SELECT o_orderkey, printf('%016X', o_orderkey) AS k FROM orders")
def key_u64be(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.hex(encode_key(F.col("o_orderkey"), "u64be")).alias("k"))


@query("SELECT c_custkey, printf('%08X', c_custkey) AS k FROM customer")
def key_u32be(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.hex(encode_key(F.col("c_custkey"), "u32be")).alias("k"))


@query("SELECT c_custkey, hex(encode(c_name)) AS k FROM customer")
def key_utf8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.hex(encode_key(F.col("c_name"), "utf8")).alias("k"))


@query("""SELECT o_orderkey, '{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS v FROM orders""")
def value_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    return df.select("o_orderkey", F.decode(json_value(df, ["o_orderstatus", "o_orderkey", "o_custkey"]), "UTF-8").alias("v"))


@query("SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes, md5(coalesce(text, '')) AS digest FROM documents")
def value_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = binary_value(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(v).cast("long").alias("n_bytes"), F.md5(v).alias("digest"))


@query("SELECT c_custkey, base64(encode(c_name)) AS b64, lower(hex(encode(c_name))) AS hexed FROM customer")
def value_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = binary_value(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", show_value(v, "base64").alias("b64"), show_value(v, "hex").alias("hexed"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def dedup_last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.last_write_wins(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"])


# Lookups


def _kv(df: DataFrame, key: str, value: str, n: int, kind: str = "u64be") -> DataFrame:
    return _shards(df, key, n).select(SHARD, encode_key(F.col(key), kind).alias("k"), F.col(value).alias("v"))


@query("WITH k AS (SELECT DISTINCT l_orderkey * 3 AS key FROM lineitem) SELECT key, o_totalprice AS v FROM k LEFT JOIN orders ON o_orderkey = key")
def multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = _kv(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice", 8)
    keys = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 3).alias("key")).distinct()
    asked = _shards(keys, "key", 8).withColumn("k", encode_key(F.col("key"), "u64be"))
    return lookup.multi_get(kv, asked).select("key", "v")


@query("SELECT o_orderkey AS key, o_totalprice AS v FROM orders WHERE o_orderkey = 7")
def point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    from snapforge.functions.hashing import shard_of

    kv = _shards(table(spark, sf_dir, "orders"), "o_orderkey", 8).where((F.col("o_orderkey") == 7) & (F.col(SHARD) == shard_of(7, 8)))
    return kv.select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("v"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey >= 100 AND p_partkey < 300")
def range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", encode_key(F.col("p_partkey"), "u64be").alias("k"))
    return lookup.key_range(rows, (100).to_bytes(8, "big"), (300).to_bytes(8, "big")).select("p_partkey", "p_name")


@query("SELECT c_name, c_custkey FROM customer WHERE c_name >= 'Customer#000000100' AND c_name < 'Customer#0000002'")
def range_scan_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_name", "c_custkey", encode_key(F.col("c_name"), "utf8").alias("k"))
    return lookup.key_range(rows, b"Customer#000000100", b"Customer#0000002").select("c_name", "c_custkey")


@query(f"WITH s AS (SELECT (h % 8)::INT AS shard_id, count(*) AS row_count FROM ({hashed('orders', 'o_orderkey', 'o_orderkey')}) GROUP BY 1), k AS (SELECT c_custkey, (h % 8)::INT AS shard_id FROM ({hashed('customer', 'c_custkey', 'c_custkey')})) SELECT c_custkey, k.shard_id, coalesce(row_count, 0) AS row_count FROM k LEFT JOIN s USING (shard_id)")
def shards_for_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = sharding.shard_stats(_shards(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 8), "o_orderkey").select(SHARD, "row_count")
    keys = _shards(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 8)
    return lookup.shards_for_keys(keys, stats).select("c_custkey", F.col(SHARD).alias("shard_id"), "row_count")


@query(f"SELECT (h % 3)::INT AS shard_id, list(s_suppkey ORDER BY s_suppkey)::VARCHAR AS keys FROM ({hashed('supplier', 's_suppkey', 's_suppkey')}) GROUP BY 1")
def group_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _shards(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey", 3).select(SHARD, F.col("s_suppkey").alias("pos"), F.col("s_suppkey").alias("k"))
    return lookup.group_keys(keys).select(F.col(SHARD).alias("shard_id"), F.concat(F.lit("["), F.array_join(F.transform("keys", lambda x: x.cast("string")), ", "), F.lit("]")).alias("keys"))


# Routing expressions


@query("SELECT o_orderkey, (o_orderkey % 4)::INT AS shard_id FROM orders")
def expression_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = ExpressionSharding("o_orderkey % 4", {"o_orderkey": "int"})
    return sharding.with_shard_id(table(spark, sf_dir, "orders").select("o_orderkey"), spec, "o_orderkey").withColumnRenamed(SHARD, "shard_id")


@query("SELECT c_custkey, CASE WHEN c_custkey < 300 THEN 0 WHEN c_custkey < 600 THEN 1 WHEN c_custkey < 900 THEN 2 ELSE 3 END::INT AS shard_id FROM customer")
def expression_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = ExpressionSharding("key < 300 ? 0 : key < 600 ? 1 : key < 900 ? 2 : 3", {"key": "int"})
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    return sharding.with_shard_id(rows, spec, "key").select(F.col("key").alias("c_custkey"), F.col(SHARD).alias("shard_id"))


@query(f"SELECT o_orderkey, (h % 5)::INT AS shard_id FROM ({hashed('orders', 'o_orderkey', 'o_orderkey')})")
def expression_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = ExpressionSharding.by_columns({"o_orderkey": "int"}, 5)
    return sharding.with_shard_id(table(spark, sf_dir, "orders").select("o_orderkey"), spec, "o_orderkey").withColumnRenamed(SHARD, "shard_id")


@query("SELECT c_custkey, (list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], c_mktsegment) - 1)::INT AS shard_id FROM customer")
def expression_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = ExpressionSharding("c_mktsegment", {"c_mktsegment": "string"}, routing_values=["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])
    rows = sharding.with_shard_id(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), spec, "c_custkey", strict=False)
    return rows.select("c_custkey", F.col(SHARD).alias("shard_id"))


@query("SELECT event_type AS token, (dense_rank() OVER (ORDER BY event_type) - 1)::INT AS shard FROM (SELECT DISTINCT event_type FROM events)")
def expression_inferred_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.tokens(table(spark, sf_dir, "events"), ExpressionSharding("event_type", {"event_type": "string"}, infer=True)).select("token", F.col("shard").cast("int").alias("shard"))


@query("WITH t AS (SELECT doc_id, lang || ':' || source AS token FROM documents) SELECT doc_id, token, (dense_rank() OVER (ORDER BY token) - 1)::INT AS shard_id FROM t")
def expression_multi_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    spec = ExpressionSharding.by_columns({"lang": "string", "source": "string"})
    rows = sharding.with_shard_id(docs, spec, "doc_id")
    return rows.select("doc_id", compile_expression(spec.expression, spec.columns).column.alias("token"), F.col(SHARD).alias("shard_id"))


@query("SELECT coalesce(max(user_id % 16) + 1, 1)::BIGINT AS num_shards, count(DISTINCT user_id % 16) AS distinct_shards, count(DISTINCT user_id % 16) = coalesce(max(user_id % 16) + 1, 1) AS dense FROM events")
def expression_num_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.with_shard_id(table(spark, sf_dir, "events").select("user_id"), ExpressionSharding("user_id % 16", {"user_id": "int"}), "user_id")
    return sharding.dense_shards(rows)


@query("SELECT p_partkey, p_name, CASE WHEN starts_with(p_brand, 'Brand#1') OR p_size >= 40 THEN 'a' WHEN contains(p_type, 'BRASS') AND NOT (p_size IN (1, 2, 3)) THEN 'b' ELSE 'c' || p_size::VARCHAR END AS token, (length(p_name) + p_size // 7 - p_size % 7)::BIGINT AS number FROM part")
def expression_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {"p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int"}
    token = compile_expression("p_brand.startsWith('Brand#1') || p_size >= 40 ? 'a' : p_type.contains(\"BRASS\") && !(p_size in [1, 2, 3]) ? 'b' : 'c' + string(p_size)", columns)
    number = compile_expression("size(p_name) + p_size / 7 - p_size % 7", columns)
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", token.column.alias("token"), number.column.alias("number"))


# Attempts, runs, sizes


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts for shards, made of line items: one for each shard and line number."""
    rows = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 64).cast("int").alias("db_id"), F.col("l_linenumber").alias("attempt")).agg(F.count("*").alias("row_count"), F.max(F.col("l_partkey") % 97).alias("t"))
    return rows.select("db_id", "attempt", F.when(F.col("t") % 3 == 0, None).otherwise(F.col("t")).cast("long").alias("task_attempt_id"), "row_count", F.concat(F.lit("s3://x/"), "db_id", F.lit("/"), "attempt").alias("db_url"))


ATTEMPTS = "a0 AS (SELECT (l_orderkey % 64)::INT AS db_id, l_linenumber AS attempt, count(*) AS row_count, max(l_partkey % 97) AS t FROM lineitem GROUP BY 1, 2), a AS (SELECT db_id, attempt, CASE WHEN t % 3 = 0 THEN NULL ELSE t END AS task_attempt_id, row_count, 's3://x/' || db_id || '/' || attempt AS db_url FROM a0), w AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY db_id ORDER BY attempt, coalesce(task_attempt_id, 9223372036854775807), db_url) = 1)"


@query(f"WITH {ATTEMPTS} SELECT * FROM w")
def winner_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.select_winners(_attempts(spark, sf_dir))


@query(f"WITH {ATTEMPTS} SELECT db_id, attempt, db_url FROM a WHERE db_url NOT IN (SELECT db_url FROM w)")
def loser_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = _attempts(spark, sf_dir)
    return lifecycle.losers(attempts, lifecycle.select_winners(attempts)).select("db_id", "attempt", "db_url")


@query(f"WITH {ATTEMPTS} SELECT (SELECT sum(row_count) FROM w)::BIGINT AS rows_written, (SELECT count(*) FROM a) AS num_attempts, (SELECT count(*) FROM w) AS num_winners")
def build_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = _attempts(spark, sf_dir)
    return lifecycle.build_stats(attempts, lifecycle.select_winners(attempts))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs, made of events: one for each user."""
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("run_id")).agg(F.max("ts").alias("published_at"))


RUNS = "r AS (SELECT user_id::VARCHAR AS run_id, max(ts) AS published_at FROM events GROUP BY 1)"


@query(f"WITH {RUNS} SELECT run_id, published_at FROM r ORDER BY published_at DESC, run_id DESC LIMIT 10")
def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.history(_runs(spark, sf_dir), 10)


@query(f"WITH {RUNS} SELECT run_id, published_at FROM r ORDER BY published_at DESC, run_id DESC LIMIT 1 OFFSET 3")
def history_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.nth_newest(_runs(spark, sf_dir), 3)


@query(f"WITH {RUNS}, n AS (SELECT run_id FROM r ORDER BY published_at DESC, run_id DESC LIMIT 20), m AS (SELECT max(published_at) AS t FROM r), cur AS (SELECT min(run_id) AS run_id FROM r), p AS (SELECT run_id FROM r WHERE run_id IN (SELECT run_id FROM n) AND published_at >= (SELECT t FROM m) - INTERVAL 2 DAY UNION SELECT run_id FROM cur) SELECT run_id FROM r WHERE run_id NOT IN (SELECT run_id FROM p)")
def cleanup_stale_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    newest, current = runs.agg(F.max("published_at"), F.min("run_id")).first()
    protected = lifecycle.protected_runs(runs, current, F.lit(newest) - F.expr("INTERVAL 2 DAYS"), 20)
    return lifecycle.stale_runs(runs.select("run_id"), protected)


@query("WITH c AS (SELECT octet_length(encode(coalesce(text, ''))) AS v FROM documents), p AS (SELECT quantile_disc(v, 0.95)::BIGINT AS p95_value_bytes, 8::BIGINT AS max_key_bytes FROM c) SELECT *, CASE WHEN p95_value_bytes + 20 <= 1002 THEN 4096 WHEN p95_value_bytes + 20 <= 2030 THEN 8192 WHEN p95_value_bytes + 20 <= 4086 THEN 16384 WHEN p95_value_bytes + 20 <= 8198 THEN 32768 ELSE 65536 END::INT AS page_size FROM p")
def page_size_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "documents").select(F.length(binary_value(F.col("text"))).alias("v"), F.lit(8).alias("k"))
    return sizing.recommend_page_size(cells, "v", "k")


SHARD_BYTES = f"s AS (SELECT (h % 16)::INT AS shard_id, sum(n)::BIGINT AS db_bytes FROM ({hashed('pages', 'page_id', 'page_id, octet_length(encode(html)) AS n')}) GROUP BY 1)"


@query(f"WITH {SHARD_BYTES} SELECT max(db_bytes) AS max_bytes, sum(db_bytes)::BIGINT AS total_bytes, CASE WHEN max(db_bytes) >= 16777216 OR sum(db_bytes) >= 2147483648 THEN 'range' ELSE 'download' END AS mode FROM s")
def access_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _shards(table(spark, sf_dir, "pages").select("page_id", F.octet_length("html").alias("n")), "page_id", 16)
    return sizing.access_mode(rows.groupBy(SHARD).agg(F.sum("n").alias("db_bytes")))


@query(f"WITH s AS (SELECT (h % 8)::INT AS shard_id, count(*) AS n FROM ({hashed('orders', 'o_orderkey', 'o_orderkey')}) GROUP BY 1) SELECT 8::BIGINT AS num_shards, sum(n)::BIGINT AS row_count, min(n) AS least_rows, max(n) AS most_rows FROM s")
def snapshot_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = sharding.all_shards(sharding.shard_stats(_shards(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 8), "o_orderkey"), 8)
    return stats.agg(F.count("*").alias("num_shards"), F.sum("row_count").alias("row_count"), F.min("row_count").alias("least_rows"), F.max("row_count").alias("most_rows"))


@query(f"WITH {RUNS}, m AS (SELECT max(published_at) AS t FROM r) SELECT run_id, date_diff('second', published_at, t)::BIGINT AS age_seconds, CASE WHEN date_diff('second', published_at, t) > 86400 THEN 'degraded' ELSE 'healthy' END AS status FROM r, m")
def snapshot_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    newest = runs.agg(F.max("published_at")).first()[0]
    age = (F.unix_seconds(F.date_trunc("second", F.lit(newest)).cast("timestamp")) - F.unix_seconds(F.date_trunc("second", "published_at").cast("timestamp"))).alias("age_seconds")
    return runs.select("run_id", age).withColumn("status", F.when(F.col("age_seconds") > 86_400, "degraded").otherwise("healthy"))


# Vectors

#: The first vectors of the table serve as centroids, planes and queries, so that SQL can name them too.
CENTROIDS, PLANES, K = 16, 8, 10
#: Searches over the whole table ask every row whose id is divisible by this.
EVERY = 50


def _distance_sql(a: str, b: str, metric: str) -> str:
    if metric == "l2":
        return f"list_sum(list_transform(range(1, 65), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))"
    dot = f"list_inner_product({a}, {b})"
    return f"-{dot}" if metric == "dot_product" else f"1 - {dot} / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})) + 1e-10)"


VECTORS = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def _first(spark: SparkSession, sf_dir: str, n: int) -> np.ndarray:
    rows = _vectors(spark, sf_dir).where(F.col("vec_id") < n).orderBy("vec_id").collect()
    return np.array([r["embedding"] for r in rows])


def _cluster(metric: str) -> None:
    sql = f"WITH {VECTORS}, c AS (SELECT vec_id AS centroid, e AS c FROM v WHERE vec_id < {CENTROIDS}) SELECT vec_id, arg_min(centroid, (d, centroid))::INT AS shard_id FROM (SELECT vec_id, centroid, {_distance_sql('e', 'c', metric)} AS d FROM v, c) GROUP BY vec_id"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _vectors(spark, sf_dir).select("vec_id", vectors.assign_cluster(F.col("embedding"), _first(spark, sf_dir, CENTROIDS), metric).alias("shard_id"))

    run.__name__ = f"cluster_assign_{metric}"
    query(sql)(run)


for _metric in ("l2", "cosine", "dot_product"):
    _cluster(_metric)


@query(f"WITH {VECTORS}, p AS (SELECT vec_id AS i, e AS p FROM v WHERE vec_id < {PLANES}) SELECT vec_id, sum(CASE WHEN list_inner_product(e, p) > 0 THEN 1 << i ELSE 0 END)::BIGINT AS code, (sum(CASE WHEN list_inner_product(e, p) > 0 THEN 1 << i ELSE 0 END) % 6)::INT AS shard_id FROM v, p GROUP BY vec_id")
def lsh_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes = _first(spark, sf_dir, PLANES)
    return _vectors(spark, sf_dir).select("vec_id", vectors.lsh_code(F.col("embedding"), planes.tolist()).alias("code"), vectors.assign_lsh(F.col("embedding"), planes, 6).alias("shard_id"))


@query(f"WITH {VECTORS} SELECT a.vec_id AS a, b.vec_id AS b, round({_distance_sql('a.e', 'b.e', 'cosine')}, 6) AS d FROM v a JOIN v b ON b.vec_id = a.vec_id + 1")
def vector_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _vectors(spark, sf_dir)
    after = own.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    met = own.withColumnsRenamed({"vec_id": "a", "embedding": "x"}).join(after, "a")
    return met.select("a", "b", F.round(distance(F.col("x"), F.col("y"), "cosine"), 6).alias("d"))


def _every(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries of a search over the whole table: they grow with it."""
    return _vectors(spark, sf_dir).where(F.col("vec_id") % EVERY == 0).withColumnRenamed("vec_id", "query_id")


def _ranked_sql(scored: str, columns: str = "") -> str:
    return f"SELECT query_id, rank, vec_id, round(score, 6) AS score{columns} FROM (SELECT query_id, vec_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id))::INT AS rank FROM ({scored}))"


EVERY_SQL = f"q AS (SELECT vec_id AS query_id, e AS q FROM v WHERE vec_id % {EVERY} = 0)"


def _knn_every(metric: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return vectors.exact_search(_vectors(spark, sf_dir), _every(spark, sf_dir), K, metric).withColumn("score", F.round("score", 6))

    run.__name__ = f"knn_{metric}"
    query(f"WITH {VECTORS}, {EVERY_SQL} {_ranked_sql(f'SELECT query_id, vec_id, {_distance_sql('q', 'e', metric)} AS score FROM q, v')} WHERE rank <= {K}")(run)


for _metric in ("l2", "cosine", "dot_product"):
    _knn_every(_metric)


@query(f"WITH {VECTORS}, c AS (SELECT vec_id AS centroid, e AS c FROM v WHERE vec_id < {CENTROIDS}), d AS (SELECT vec_id, e, centroid, {_distance_sql('e', 'c', 'l2')} AS d FROM v, c), s AS (SELECT vec_id, any_value(e) AS e, arg_min(centroid, (d, centroid)) AS shard FROM d GROUP BY vec_id), p AS (SELECT vec_id AS query_id, e AS q, centroid AS shard FROM d WHERE vec_id % {EVERY} = 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, centroid) <= 3) {_ranked_sql(f'SELECT query_id, vec_id, {_distance_sql('q', 'e', 'l2')} AS score FROM p JOIN s USING (shard)')} WHERE rank <= {K}")
def knn_probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes come from the plan; only the centroids are on the driver."""
    centers = _first(spark, sf_dir, CENTROIDS)
    own = _vectors(spark, sf_dir).withColumn("shard", vectors.assign_cluster(F.col("embedding"), centers))
    asked = _every(spark, sf_dir).withColumn("shards", vectors.assign_probes(F.col("embedding"), centers, 3))
    return vectors.exact_search(own, asked, K).withColumn("score", F.round("score", 6))


@query(f"WITH {VECTORS}, s AS (SELECT v.*, vec_id % 4 AS shard FROM v), {EVERY_SQL} {_ranked_sql(f'SELECT query_id, vec_id, {_distance_sql('q', 'e', 'cosine')} AS score FROM q, s WHERE shard IN (1, 3)')} WHERE rank <= {K}")
def knn_filtered_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit shards. The queries are shipped: two shards would be two keys of a join."""
    own = _vectors(spark, sf_dir).withColumn("shard", (F.col("vec_id") % 4).cast("int")).where(F.col("shard").isin(1, 3))
    asked = _every(spark, sf_dir).withColumn("shards", F.array(F.lit(1), F.lit(3)))
    return vectors.exact_search(own, asked, K, "cosine").withColumn("score", F.round("score", 6))


@query(f"WITH {VECTORS}, {EVERY_SQL} {_ranked_sql(f'SELECT query_id, vec_id, {_distance_sql('q', 'e', 'l2')} AS score FROM q, v', ', lang, n_chars')} JOIN documents ON doc_id = vec_id WHERE rank <= {K}")
def unified_search_hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = vectors.exact_search(_vectors(spark, sf_dir), _every(spark, sf_dir), K).withColumn("score", F.round("score", 6))
    return hits.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "n_chars"), "vec_id")


@query()
def kmeans_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids of all vectors. Seeds are drawn at random, so there is no SQL."""
    centers = vectors.kmeans_at_scale(_vectors(spark, sf_dir), 8)
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)], "centroid int, center array<float>")


# The whole way


@query("SELECT o_orderkey AS key, o_orderstatus AS v FROM orders")
def roundtrip_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build a snapshot of orders in the shared folder, and look all keys up in it."""
    from snapforge.operators.snapshot import build_snapshot
    from snapforge.sources.reader import Snapshot

    root = f"{_shared(spark)}/snapshot-{spark.sparkContext.applicationId}-{abs(hash(sf_dir)):x}"
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    build_snapshot(orders, root, "o_orderkey", F.encode("o_orderstatus", "UTF-8"), HashSharding(8))
    keys = orders.select(F.monotonically_increasing_id().alias("pos"), F.col("o_orderkey").alias("key"))
    return Snapshot(spark, root).multi_get(keys).select("key", F.decode("v", "UTF-8").alias("v"))


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="snapshots-")


def _shared(spark: SparkSession) -> str:
    return (spark.sparkContext.getConf().get("spark.checkpoint.dir") or _own_folder()).rstrip("/")
