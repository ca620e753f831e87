"""Serving a snapshot: lookups, scans, vector search, what it holds, and whether it is fresh."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from datetime import UTC, datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapforge.errors import ConfigError, ManifestError, StateError
from snapforge.functions.expressions import compile_expression
from snapforge.functions.hashing import shard_of
from snapforge.functions.keys import encode_key, lookup_key
from snapforge.operators import lookup
from snapforge.operators.sharding import SHARD, HashSharding, token_shard, with_shard_id
from snapforge.operators.vectors import exact_search
from snapforge.sources.manifest import Manifest, ManifestStore
from snapforge.streaming.limits import TokenBucket


#: Keys of a list that are looked up by their shards; longer lists are joined.
LISTED = 10_000


class Snapshot:
    """A reader pinned to one manifest until refresh(). Spark plans read a fixed list of files, so what is under way is not disturbed."""

    def __init__(self, spark: SparkSession, root: str, run_id: str | None = None, emit: Callable[[str, dict], None] | None = None, admit: TokenBucket | None = None):
        """emit is called with the reader's events, see snapforge.metrics; admit is asked for each key or query before it is served."""
        self.spark, self.store, self.opened = spark, ManifestStore(spark, root), datetime.now(UTC)
        self.emit, self.admit, self.closed = emit or (lambda event, fields: None), admit, False
        made = self.store.load(run_id) if run_id else self.store.load_latest()
        if made is None:
            raise StateError(f"no such run: {run_id}")
        self._use(made)
        self.emit("reader_opened", {"run_id": made.run_id})

    @contextmanager
    def _served(self, event: str, **fields: int) -> Iterator[None]:
        """Wait to be admitted, then tell what was asked and how long it took: of a table that is returned, its planning."""
        if self.admit is not None:
            self.admit.acquire(max(fields.values()))
        began = time.perf_counter()
        try:
            yield
        finally:
            self.emit(event, fields | {"seconds": time.perf_counter() - began})

    def _use(self, manifest: Manifest) -> None:
        self.manifest, self.kv, self.shard_table = manifest, self.store.data(manifest.run_id), self.store.shards(manifest.run_id)

    def _open(self) -> None:
        if self.closed:
            raise StateError("the reader is closed")

    def _values(self) -> list | None:
        values = self.manifest.sharding.get("routing_values")
        return None if values is None else [bytes.fromhex(v["bytes"]) if isinstance(v, dict) else v for v in values]

    def route(self, keys: DataFrame) -> DataFrame:
        """keys (pos, key and the routing columns) with _shard_id and k. Unknown categories have a null shard, so they miss."""
        self._open()
        spec = self.manifest.sharding
        named = keys.withColumnRenamed("key", self.manifest.key_column) if self.manifest.key_column != "key" else keys
        if spec["strategy"] == "hash":
            routed = with_shard_id(named, HashSharding(self.manifest.num_shards), self.manifest.key_column)
        else:
            if missing := [c for c in spec["columns"] if c not in named.columns]:
                raise ConfigError(f"routing needs {missing}")
            made = compile_expression(spec["expression"], spec["columns"])
            values = self._values()
            routed = named.withColumn(SHARD, made.column.cast("int")) if values is None else token_shard(named, made.column, values, strict=False)
        return routed.withColumn("k", encode_key(F.col(self.manifest.key_column), self.manifest.key_encoding))

    def route_key(self, key: int | str | bytes, context: dict | None = None) -> int | None:
        """The shard of one key."""
        self._open()
        if self.manifest.sharding["strategy"] == "hash":
            return shard_of(key, self.manifest.num_shards)
        return self.route(self._frame([key], context)).first()[SHARD]

    def _frame(self, keys: Sequence, context: dict | None = None) -> DataFrame:
        rows = [(i, k) for i, k in enumerate(keys)]
        frame = self.spark.createDataFrame(rows, f"pos int, key {self.manifest.key_type}")
        for name, v in (context or {}).items():
            if name != self.manifest.key_column:
                frame = frame.withColumn(name, F.lit(v))
        return frame

    def get(self, key: int | str | bytes, context: dict | None = None) -> bytes | None:
        """The value of a key, or None. Reads one folder, and in it the row groups that may hold the key."""
        with self._served("lookup", keys=1):
            shard = self.route_key(key, context)
            if shard is None or not 0 <= shard < self.manifest.num_shards:
                return None
            rows = lookup.point(self.kv, shard, lookup_key(key, self.manifest.key_encoding)).select("v").take(1)
            return bytes(rows[0]["v"]) if rows and rows[0]["v"] is not None else None

    def multi_get(self, keys: Sequence | DataFrame, context: dict | None = None) -> DataFrame:
        """(pos, key, v, found) in any order: for a list of keys, or a table (pos, key and routing columns) of any size.

        Up to LISTED keys read only their own shards, and in them the row groups that may hold them. A table counts as one
        request, as its keys aren't counted.
        """
        self._open()
        with self._served("lookup", keys=1 if isinstance(keys, DataFrame) else len(keys)):
            return self._multi_get(keys, context)

    def _multi_get(self, keys: Sequence | DataFrame, context: dict | None) -> DataFrame:
        kv = self.kv.select(SHARD, "k", "v")
        if isinstance(keys, DataFrame) or len(keys) > LISTED:
            asked = self.route(keys if isinstance(keys, DataFrame) else self._frame(keys, context))
        else:
            wanted: dict[int, list[bytes]] = {}
            routed = self.route(self._frame(keys, context)).select("pos", self.manifest.key_column, SHARD, "k")
            if self.manifest.sharding["strategy"] == "hash":
                places = [(shard_of(k, self.manifest.num_shards), lookup_key(k, self.manifest.key_encoding)) for k in keys]
            else:
                places = [(r[SHARD], bytes(r["k"])) for r in routed.collect()]
            for shard, k in places:
                if shard is not None and 0 <= shard < self.manifest.num_shards:
                    wanted.setdefault(shard, []).append(k)
            met = lookup.listed(kv, wanted).join(F.broadcast(routed), [SHARD, "k"]).select("pos", "v", F.lit(True).alias("found"))  # LISTED keys at most are shipped
            return routed.join(met, "pos", "left").select("pos", F.col(self.manifest.key_column).alias("key"), "v", F.coalesce("found", F.lit(False)).alias("found"))
        found = lookup.multi_get(kv, asked)
        return found.select("pos", F.col(self.manifest.key_column).alias("key"), "v", "found")

    def get_many(self, keys: Sequence, context: dict | None = None) -> dict:
        """multi_get as a dict in request order, repeated keys once."""
        by = {r["pos"]: r["v"] for r in self.multi_get(keys, context).collect()}
        return {k: None if by[i] is None else bytes(by[i]) for i, k in enumerate(keys)}

    def scan(self, start: int | str | bytes | None = None, end: int | str | bytes | None = None) -> DataFrame:
        """(k, v) with start <= k < end in the order of encoded keys."""
        self._open()
        at = [None if x is None else lookup_key(x, self.manifest.key_encoding) for x in (start, end)]
        return lookup.scan(self.kv.select("k", "v"), *at)

    def search(self, queries: DataFrame | Sequence, k: int = 10, metric: str = "l2", shards: Sequence[int] | None = None) -> DataFrame:
        """(query_id, rank, vec_id, score, payload): nearest vectors of all or some shards, their payloads joined on."""
        self._open()
        if "vector" not in self.manifest.custom:
            raise ConfigError("the snapshot has no vectors")
        frame = queries if isinstance(queries, DataFrame) else self.spark.createDataFrame([(0, [float(x) for x in np.asarray(queries)])], "query_id int, embedding array<float>")
        rows = self.kv if shards is None else self.kv.where(F.col(SHARD).isin(list(shards)))
        with self._served("search", queries=1):
            return exact_search(rows, frame, k, metric, carry=("payload", "v"))

    def info(self) -> dict:
        self._open()
        m = self.manifest
        return {"run_id": m.run_id, "created_at": m.created_at, "num_shards": m.num_shards, "key_encoding": m.key_encoding, "sharding": m.sharding["strategy"], "row_count": m.rows_written, "manifest": self.store.folder(m.run_id, "manifest")}

    def shards(self) -> DataFrame:
        """A row for each shard, those without rows included."""
        self._open()
        ids = self.spark.range(self.manifest.num_shards).select(F.col("id").cast("int").alias(SHARD))
        return ids.join(self.shard_table, SHARD, "left").withColumn("row_count", F.coalesce("row_count", F.lit(0)))

    def shards_for_keys(self, keys: Sequence, context: dict | None = None) -> DataFrame:
        return lookup.shards_for_keys(self.route(self._frame(keys, context)), self.shard_table)

    def health(self, stale_after_seconds: float | None = None) -> dict:
        """healthy, degraded (older than asked for) or unhealthy (closed), and the snapshot's age."""
        age = (datetime.now(UTC) - datetime.fromisoformat(self.manifest.created_at)).total_seconds()
        status = "unhealthy" if self.closed else "degraded" if stale_after_seconds is not None and age > stale_after_seconds else "healthy"
        return {"status": status, "age_seconds": age, "run_id": self.manifest.run_id}

    def refresh(self) -> bool:
        """Go to the current snapshot. False if it is the same, or can't be read: then the old one is kept."""
        self._open()
        try:
            run_id = self.store.current()
            made = None if run_id in (None, self.manifest.run_id) else self.store.load(run_id)
        except ManifestError:
            return False
        if made is None:
            return False
        self._use(made)
        self.emit("reader_refreshed", {"run_id": made.run_id})
        return True

    def close(self) -> None:
        if not self.closed:
            self.closed = True
            self.emit("reader_closed", {"run_id": self.manifest.run_id})

    def __enter__(self) -> Snapshot:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
