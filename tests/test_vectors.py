import numpy as np
import pytest
from pyspark.sql import functions as F

from snapforge.errors import ConfigError
from snapforge.functions.vectors import distance, distances
from snapforge.operators import vectors
from snapforge.operators.sharding import HashSharding
from snapforge.operators.snapshot import build_snapshot
from snapforge.plans.catalog import QUERIES
from snapforge.sources.reader import Snapshot
from tests.conftest import CHECKED


def table(spark, x):
    return spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")


def brute(q, x, k, metric):
    d = distances(q[None], x, metric)[0]
    return [(int(i), float(d[i])) for i in np.lexsort((np.arange(len(x)), d))[:k]]


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot_product"])
def test_exact_search(spark, metric):
    x = np.random.default_rng(42).standard_normal((200, 16)).astype(np.float32)
    x[50] = x[3]
    x[60] = 0
    own = table(spark, x).union(spark.createDataFrame([(999, None)], "vec_id long, embedding array<float>"))
    asked = table(spark, np.vstack([x[:20], x[60]])).withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in vectors.exact_search(own.repartition(5), asked, 7, metric).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for i, q in enumerate(np.vstack([x[:20], x[60]])):
        want = brute(q, x, 7, metric)
        assert [v for _, v, _ in sorted(got[i])] == [v for v, _ in want]
        assert np.allclose([s for _, _, s in sorted(got[i])], [s for _, s in want])
    pairs = own.where("vec_id < 5").crossJoin(asked.where("query_id < 5").withColumnRenamed("embedding", "q"))
    for r in pairs.select("vec_id", "query_id", distance(F.col("q"), F.col("embedding"), metric).alias("d")).collect():
        assert r["d"] == pytest.approx(distances(x[r["query_id"]][None], x[r["vec_id"]][None], metric)[0, 0], abs=1e-9)
    assert vectors.exact_search(own, asked.limit(0), 3, metric).count() == 0
    with pytest.raises(ConfigError):
        vectors.exact_search(own, asked, 3, "manhattan")


def test_probes_hold_the_writer_s_shard(spark):
    rng = np.random.default_rng(42)
    x = rng.standard_normal((80, 32)).astype(np.float32)
    centers = vectors.kmeans(x, 4)
    assert (centers == vectors.kmeans(x, 4)).all() and centers.shape == (4, 32)
    shards = [r[1] for r in table(spark, x).select("vec_id", vectors.assign_cluster(F.col("embedding"), centers)).orderBy("vec_id").collect()]
    native = vectors.assign_cluster_frame(table(spark, x), spark.createDataFrame([(i, [float(a) for a in c]) for i, c in enumerate(centers)], "centroid int, center array<float>"))
    assert [r["shard"] for r in native.orderBy("vec_id").collect()] == shards
    for probes in (1, 2, 4):
        assert all(s == vectors.probe_clusters(v, centers, probes)[0] for s, v in zip(shards, x, strict=True))
    planes = vectors.hyperplanes(6, 32, 7)
    lsh = table(spark, x).select("vec_id", vectors.assign_lsh(F.col("embedding"), planes, 4).alias("s"), vectors.lsh_code(F.col("embedding"), planes.tolist()).alias("c")).orderBy("vec_id").collect()
    for r, v in zip(lsh, x, strict=True):
        assert r["s"] == r["c"] % 4 and vectors.probe_lsh(v, planes, 4)[0] == r["s"]
        probes = vectors.probe_lsh(v, planes, 4, 3)
        assert len(set(probes)) == len(probes) <= 3
    own = table(spark, x).withColumn("shard", vectors.assign_cluster(F.col("embedding"), centers))
    asked = spark.createDataFrame([(i, [float(a) for a in x[i]], vectors.probe_clusters(x[i], centers, 1)) for i in range(80)], "query_id long, embedding array<float>, shards array<int>")
    assert vectors.exact_search(own, asked, 1).where("query_id <> vec_id").count() == 0
    joined = vectors.search_by_join(own, asked.select("query_id", F.col("embedding").alias("query"), F.explode("shards").alias("shard")), 3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in joined] == [(r["query_id"], r["vec_id"]) for r in vectors.exact_search(own, asked, 3).orderBy("query_id", "rank").collect()]


def test_ties_and_nulls(spark):
    centers = np.zeros((288, 4), np.float32) + np.arange(288)[:, None]
    centers[[0, 96, 192, 287]] = 500
    q = centers[0]
    assert vectors.probe_clusters(q, centers, 4) == [0, 96, 192, 287]
    rows = spark.createDataFrame([(1, [500.0] * 4), (2, None)], "vec_id long, embedding array<float>")
    assert [r[0] for r in rows.select(vectors.assign_cluster(F.col("embedding"), centers)).collect()] == [0, None]
    assert [r[0] for r in rows.select(vectors.assign_lsh(F.col("embedding"), vectors.hyperplanes(3, 4), 2)).collect()][1] is None
    with pytest.raises(ConfigError):
        vectors.kmeans(np.zeros((2, 2)), 3)
    assert vectors.kmeans(np.zeros((5, 2)), 3).shape == (3, 2)


def test_kmeans_at_scale(spark):
    x = np.vstack([np.random.default_rng(i).normal(20 * i, 1, (40, 3)) for i in range(3)])
    centers = vectors.kmeans_at_scale(table(spark, x), 3)
    assert sorted(round(c.mean() / 20) for c in centers) == [0, 1, 2]
    assert vectors.sample_for_training(table(spark, x), 10, 1.0).shape == (10, 3)


def test_unified_snapshot(spark, tmp_path):
    x = np.random.default_rng(1).standard_normal((50, 8)).astype(np.float32)
    df = table(spark, x).withColumn("label", F.concat(F.lit("l"), "vec_id"))
    build_snapshot(df, str(tmp_path), "vec_id", F.encode("label", "UTF-8"), HashSharding(3), vector=("vec_id", "embedding", ["label"]))
    s = Snapshot(spark, str(tmp_path))
    hits = s.search(x[7].tolist(), k=3).orderBy("rank").collect()
    assert hits[0]["vec_id"] == 7 and hits[0]["payload"] == '{"label":"l7"}' and bytes(hits[0]["v"]) == b"l7" and s.get(7) == b"l7"
    only = s.search(x[7].tolist(), k=50, shards=[0]).collect()
    assert {s.route_key(r["vec_id"]) for r in only} == {0}


def test_probes_in_the_plan(spark):
    x = np.random.default_rng(3).standard_normal((60, 8)).astype(np.float32)
    centers = np.vstack([x[:5], x[:1]])  # two equally near ones
    rows = table(spark, x).union(spark.createDataFrame([(99, None)], "vec_id long, embedding array<float>"))
    got = {r[0]: r[1] for r in rows.select("vec_id", vectors.assign_probes(F.col("embedding"), centers, 3)).collect()}
    assert got == {**{i: vectors.probe_clusters(v, centers, 3) for i, v in enumerate(x)}, 99: None}


@pytest.mark.parametrize("name", ["knn_l2", "knn_cosine", "knn_dot_product", "knn_probed", "knn_filtered_shard", "unified_search_hydrate"])
def test_queries_grow_with_the_table(spark, name):
    own = spark.read.parquet(f"{CHECKED}/embeddings.parquet")
    want = {r[0] for r in own.where("vec_id % 50 = 0").select("vec_id").collect()}
    assert len(want) == 10 and {r["query_id"] for r in QUERIES[name](spark, CHECKED).collect()} == want


def test_kmeans_query_trains_on_all_vectors(spark, tmp_path):
    """A table stored by cluster, whose last cluster begins behind row 10,000: it gets a centroid too."""
    x = np.random.default_rng(1).normal(0, 1, (10_100, 4)).astype(np.float32)
    x[10_000:] += 1000
    table(spark, x).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    centers = [r["center"] for r in QUERIES["kmeans_train"](spark, str(tmp_path)).collect()]
    assert len(centers) == 8 and any(min(c) > 900 for c in centers)


def test_queries_in_blocks_and_repeated_ids(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4))
    own = spark.createDataFrame([(i % 50, [float(v) for v in e], f"row {i}") for i, e in enumerate(x)], "vec_id long, embedding array<float>, payload string")
    asked = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(20)], "query_id int, embedding array<float>")
    want = sorted(map(tuple, vectors.exact_search(own, asked, 5, carry=("payload",)).collect()))
    assert len(want) == 100 and all(sum(r[0] == i for r in want) == 5 for i in range(20)) and all((i, 1, i, 0.0, f"row {i}") in want for i in range(10))
    monkeypatch.setattr(vectors, "MAX_SHIPPED", 16)
    assert sorted(map(tuple, vectors.exact_search(own, asked, 5, carry=("payload",)).collect())) == want
