"""Vectors: shards by cluster or by hyperplanes, probes, exact nearest neighbours, k-means."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapforge.errors import ConfigError
from snapforge.functions.vectors import distance, distances, metric_name

#: Queries that are compared with a batch of vectors at once.
QUERY_BLOCK = 256
#: Numbers that a set of queries may have to be shipped to executors; larger sets are joined.
MAX_SHIPPED = 16 << 20


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A list column without nulls as (rows, dim)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * dim:
        raise ConfigError(f"vectors need {dim} numbers")
    return flat.reshape(-1, dim)


def assign_cluster(vector: Column, centroids: np.ndarray, metric: str = "l2") -> Column:
    """The nearest centroid; of equally near ones the first. Null for a null vector."""
    metric = metric_name(metric)

    @F.arrow_udf("int")
    def nearest(column: pa.Array) -> pa.Array:
        known = column.is_valid()
        out = np.zeros(len(column), np.int32)
        some = column.filter(known)
        if len(some):
            out[known.to_numpy(zero_copy_only=False)] = distances(matrix(some, centroids.shape[1]), centroids, metric).argmin(axis=1)
        return pa.array(out, pa.int32(), mask=~known.to_numpy(zero_copy_only=False))

    return nearest(vector)


def assign_cluster_frame(vectors: DataFrame, centroids: DataFrame, metric: str = "l2") -> DataFrame:
    """The same with built-in functions, for centroids (centroid, center) in a table: vectors (vec_id, embedding) with their shard.

    The centroids, one for each shard, become one array, so every vector is seen once.
    """
    all_centers = centroids.agg(F.array_sort(F.collect_list(F.struct("centroid", "center"))).alias("centers"))
    rows = vectors.join(F.broadcast(all_centers))  # one row
    scored = F.transform("centers", lambda c: F.struct(distance(F.col("embedding"), c["center"], metric).alias("d"), c["centroid"].alias("c")))
    return rows.select("vec_id", F.array_min(scored)["c"].alias("shard"))


def hyperplanes(bits: int, dim: int, seed: int = 42) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((bits, dim)).astype(np.float32)


def lsh_codes(vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Bit i: is the projection on plane i above 0."""
    return ((vectors.astype(np.float64) @ planes.astype(np.float64).T) > 0) @ (1 << np.arange(len(planes), dtype=np.int64))


def assign_lsh(vector: Column, planes: np.ndarray, num_shards: int) -> Column:
    @F.arrow_udf("int")
    def shard(column: pa.Array) -> pa.Array:
        known = column.is_valid()
        out = np.zeros(len(column), np.int32)
        some = column.filter(known)
        if len(some):
            out[known.to_numpy(zero_copy_only=False)] = lsh_codes(matrix(some, planes.shape[1]), planes) % num_shards
        return pa.array(out, pa.int32(), mask=~known.to_numpy(zero_copy_only=False))

    return shard(vector)


def lsh_code(vector: Column, planes: list[list[float]]) -> Column:
    """The code with built-in functions."""
    v = vector.cast("array<double>")
    dot = lambda plane: F.aggregate(F.zip_with(v, F.array(*[F.lit(float(x)) for x in plane]), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return sum((F.when(dot(p) > 0, F.lit(1 << i)).otherwise(0).cast("long") for i, p in enumerate(planes)), F.lit(0).cast("long"))


def probe_clusters(query: np.ndarray, centroids: np.ndarray, num_probes: int = 1, metric: str = "l2") -> list[int]:
    """The nearest clusters' shards, nearest first, the first of equally near ones first."""
    return [int(i) for i in np.argsort(distances(query[None], centroids, metric)[0], kind="stable")[: max(1, num_probes)]]


def assign_probes(vector: Column, centroids: np.ndarray, num_probes: int = 1, metric: str = "l2") -> Column:
    """probe_clusters for a column: an array of shards. Null for a null vector."""
    metric = metric_name(metric)

    @F.arrow_udf("array<int>")
    def nearest(column: pa.Array) -> pa.Array:
        known = column.is_valid().to_numpy(zero_copy_only=False)
        out: list[list[int] | None] = [None] * len(column)
        if known.any():
            d = distances(matrix(column.filter(pa.array(known)), centroids.shape[1]), centroids, metric)
            for i, line in zip(np.flatnonzero(known), np.argsort(d, axis=1, kind="stable")[:, : max(1, num_probes)].tolist(), strict=True):
                out[i] = line
        return pa.array(out, pa.list_(pa.int32()))

    return nearest(vector)


def probe_lsh(query: np.ndarray, planes: np.ndarray, num_shards: int, num_probes: int = 1) -> list[int]:
    """The query's shard, then those of codes that differ in one bit, bit 0 first; each once."""
    code = int(lsh_codes(query[None], planes)[0])
    codes = [code, *(code ^ (1 << i) for i in range(len(planes)))]
    return list(dict.fromkeys(c % num_shards for c in codes))[: max(1, num_probes)]


def exact_search(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2", carry: Sequence[str] = ()) -> DataFrame:
    """(query_id, rank, vec_id, score) and `carry`, columns of the vectors' rows: each query's k nearest vectors, by score, then id. Lower scores are nearer.

    vectors (vec_id, embedding[, shard]) are compared, batch by batch, with all queries (query_id,
    embedding[, shards]); each batch passes on its own k best, and a window over those, k for each batch
    and query, merges them. A query with `shards` is compared with vectors of these shards only. Null
    vectors are left out. Rows that repeat a vec_id are hits of their own. Queries are counted first; they are
    shipped up to MAX_SHIPPED numbers at a time, and more are searched in blocks, dealt by the hash of their id.
    """
    metric = metric_name(metric)
    probed = "shards" in queries.columns
    queries = queries.select("query_id", "embedding", *["shards"] * probed).where("embedding IS NOT NULL")
    n_blocks = -(-int(queries.agg(F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()[0]) // MAX_SHIPPED)
    if n_blocks > 1:
        block = F.pmod(F.xxhash64("query_id"), F.lit(2 * n_blocks))  # of uneven size: some room is left
        found = [exact_search(vectors, queries.where(block == b), k, metric, carry) for b in range(2 * n_blocks)]
        return reduce(DataFrame.unionAll, found)
    rows = queries.toArrow()
    kind = queries.schema["query_id"].dataType.simpleString()
    own_kind = vectors.schema["vec_id"].dataType.simpleString()
    carried = "".join(f", {c} {vectors.schema[c].dataType.simpleString()}" for c in carry)
    if not len(rows):
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {own_kind}, score double{carried}")
    dim = len(rows["embedding"][0])
    asked = matrix(rows["embedding"], dim)
    ids = rows["query_id"].combine_chunks()
    wanted = [np.array(x) for x in rows["shards"].to_pylist()] if probed else None

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = matrix(batch.column("embedding"), dim)
            if not len(own):
                continue
            shard = batch.column("shard").to_numpy(zero_copy_only=False) if probed else None
            order = batch.column("vec_id").to_numpy(zero_copy_only=False)
            for start in range(0, len(asked), QUERY_BLOCK):
                d = distances(asked[start : start + QUERY_BLOCK], own, metric)
                if probed:
                    for i in range(len(d)):
                        d[i, ~np.isin(shard, wanted[start + i])] = np.inf
                of, at = [], []
                for i, line in enumerate(d):
                    if k < len(line):
                        edge = np.partition(line, k - 1)[k - 1]
                        near = np.flatnonzero(line <= edge)
                    else:
                        near = np.arange(len(line))
                    near = near[np.lexsort((order[near], line[near]))][:k]
                    near = near[np.isfinite(line[near])]
                    of.append(np.full(len(near), start + i))
                    at.append(near)
                of, at = np.concatenate(of), np.concatenate(at)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), batch.column("vec_id").take(pa.array(at)), pa.array(d[of - start, at]), *[batch.column(c).take(pa.array(at)) for c in carry]], names=["query_id", "vec_id", "score", *carry])

    source = vectors.where("embedding IS NOT NULL").select("vec_id", "embedding", *["shard"] * probed, *carry)
    near = source.mapInArrow(search, f"query_id {kind}, vec_id {own_kind}, score double{carried}")
    return merge(near, k)


def merge(results: DataFrame, k: int) -> DataFrame:
    """The k best of each query over all shards' results, by score, then id. Spark prunes each partition to k first."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return results.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", *[c for c in results.columns if c not in ("query_id", "vec_id", "score")])


def search_by_join(vectors: DataFrame, probes: DataFrame, k: int = 10, metric: str = "l2") -> DataFrame:
    """exact_search with built-in functions: probes (query_id, query, shard) meet the vectors (vec_id, embedding, shard) of their shards."""
    met = probes.join(vectors, "shard").where("embedding IS NOT NULL")
    return merge(met.select("query_id", "vec_id", distance(F.col("query"), F.col("embedding"), metric).alias("score")), k)


def sample_for_training(vectors: DataFrame, n: int, share: float = 0.1, seed: int = 42) -> np.ndarray:
    """At most n vectors, for k-means; n bounds what comes to the driver."""
    rows = vectors.where("embedding IS NOT NULL").sample(share, seed=seed).select("embedding").limit(n).toArrow()
    return matrix(rows["embedding"], len(rows["embedding"][0])) if len(rows) else np.zeros((0, 0), np.float32)


def kmeans(points: np.ndarray, k: int, seed: int = 42, rounds: int = 100) -> np.ndarray:
    """k centroids of a sample by squared l2: seeds drawn in proportion to squared distance, then Lloyd's rounds. A cluster without points keeps its centroid."""
    if not 0 < k <= len(points):
        raise ConfigError(f"{k} clusters need as many points, not {len(points)}")
    rng, x = np.random.default_rng(seed), points.astype(np.float64)
    centers = [x[rng.integers(len(x))]]
    gap = ((x - centers[0]) ** 2).sum(axis=1)
    while len(centers) < k:
        total = gap.sum()
        centers.append(x[rng.choice(len(x), p=gap / total) if total > 0 else rng.integers(len(x))])
        gap = np.minimum(gap, ((x - centers[-1]) ** 2).sum(axis=1))
    c = np.array(centers)
    for _ in range(rounds):
        of = distances(x, c, "l2").argmin(axis=1)
        n = np.bincount(of, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        if np.allclose(new, c, atol=1e-6):
            break
        c = new
    return c.astype(np.float32)


def kmeans_at_scale(vectors: DataFrame, k: int, seed: int = 42, rounds: int = 20) -> np.ndarray:
    """k centroids of all vectors, by Spark's own k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.where("embedding IS NOT NULL").select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return np.array(KMeans(k=k, seed=seed, maxIter=rounds).fit(rows).clusterCenters(), np.float32)
