from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from snapforge.errors import ConfigError, ManifestError, ShardAssignmentError, ShardCoverageError, StateError
from snapforge.functions.hashing import shard_of
from snapforge.functions.keys import json_value
from snapforge.operators import lifecycle, sharding, sizing
from snapforge.operators.sharding import SHARD, ExpressionSharding, HashSharding
from snapforge.operators.snapshot import build_snapshot
from snapforge.sources.manifest import Manifest, ManifestStore
from snapforge.sources.reader import Snapshot
from snapforge.sources.runs import RunRegistry
from snapforge.streaming.publish import publish_each_batch


def frame(spark, n=71):
    return spark.createDataFrame([(i, f"payload-{i}", "ab"[i % 2]) for i in range(n)], "id long, payload string, grp string")


def test_every_key_is_in_one_shard(spark, tmp_path):
    df = frame(spark)
    made = build_snapshot(df, str(tmp_path), "id", F.encode("payload", "UTF-8"), HashSharding(5))
    assert (made.rows_written, made.num_shards) == (71, 5)
    with Snapshot(spark, str(tmp_path)) as s:
        stats = s.shards().collect()
        assert sum(r["row_count"] for r in stats) == 71 and all(r["row_count"] for r in stats)
        assert min(r["min_key"] for r in stats) == 0 and max(r["max_key"] for r in stats) == 70 and all(r["db_bytes"] > 0 for r in stats)
        where = {int.from_bytes(r["k"], "big"): r[SHARD] for r in s.kv.collect()}
        assert len(where) == 71 and all(shard_of(k, 5) == v == s.route_key(k) for k, v in where.items())
        assert s.get(3) == b"payload-3" and s.get(1000) is None
        assert s.get_many([5, 99, 5, 0]) == {5: b"payload-5", 99: None, 0: b"payload-0"}
        assert [int.from_bytes(r["k"], "big") for r in s.scan(10, 20).collect()] == list(range(10, 20))
        assert s.scan().count() == 71 and s.scan(end=3).count() == 3
        assert sharding.routing_agrees(sharding.with_shard_id(df, HashSharding(5), "id"), "id", 5)
        files = {f.rsplit("/", 2)[1] for f in s.kv.inputFiles()}
        assert files == {f"{SHARD}={i}" for i in range(5)} and len(s.kv.inputFiles()) == 5
    with pytest.raises(StateError):
        s.get(1)
    assert s.health()["status"] == "unhealthy"


def test_lookup_prunes(spark, tmp_path):
    from snapforge.operators import lookup

    build_snapshot(frame(spark), str(tmp_path), "id", F.encode("payload", "UTF-8"), HashSharding(5))
    plan = lookup.point(Snapshot(spark, str(tmp_path)).kv, 2, bytes(8))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_shard_id" in plan and "PushedFilters: [IsNotNull(k), EqualTo(k" in plan


def test_empty_shards_and_max_keys(spark, tmp_path):
    build_snapshot(frame(spark, 3), str(tmp_path), "id", F.encode("payload", "UTF-8"), HashSharding(50))
    s = Snapshot(spark, str(tmp_path))
    assert s.shards().count() == 50 and s.shard_table.count() <= 3 and s.get(2) == b"payload-2" and s.get(7) is None
    rows = {r["pos"]: r["row_count"] for r in s.shards_for_keys([0, 77]).collect()}
    assert rows[0] >= 1 and len(rows) == 2
    assert build_snapshot(frame(spark), str(tmp_path), "id", F.encode("payload", "UTF-8"), HashSharding(max_keys_per_shard=10)).num_shards == 8
    assert build_snapshot(frame(spark).limit(0), str(tmp_path), "id", F.encode("payload", "UTF-8"), HashSharding(max_keys_per_shard=10)).num_shards == 1


def test_last_write_wins(spark, tmp_path):
    df = frame(spark, 10).withColumn("seq", F.lit(1)).union(frame(spark, 4).withColumn("payload", F.lit("new")).withColumn("seq", F.lit(2)))
    value = F.encode("payload", "UTF-8")
    with pytest.raises(ConfigError, match="repeats"):
        build_snapshot(df, str(tmp_path), "id", value, HashSharding(3))
    assert ManifestStore(spark, str(tmp_path)).current() is None
    made = build_snapshot(df, str(tmp_path), "id", value, HashSharding(3), order=["seq"])
    s = Snapshot(spark, str(tmp_path))
    assert made.rows_written == 14 and s.kv.count() == 10 and s.get(2) == b"new" and s.get(7) == b"payload-7"


def test_categories(spark, tmp_path):
    df = frame(spark)
    build_snapshot(df, str(tmp_path), "id", json_value(df), ExpressionSharding("grp", {"grp": "string"}, infer=True))
    s = Snapshot(spark, str(tmp_path))
    assert s.info()["num_shards"] == 2 and s.route_key(1, {"grp": "b"}) == 1 and s.route_key(1, {"grp": "z"}) is None
    assert s.get(1, {"grp": "b"}) == b'{"grp":"b","id":1,"payload":"payload-1"}' and s.get(1, {"grp": "a"}) is None and s.get(1, {"grp": "z"}) is None
    assert s.get_many([1, 2], {"grp": "z"}) == {1: None, 2: None}
    with pytest.raises(ConfigError):
        s.get(1)
    with pytest.raises(Exception, match="no such routing value"):
        build_snapshot(df, str(tmp_path), "id", json_value(df), ExpressionSharding("grp", {"grp": "string"}, routing_values=["a"]))
    many = spark.createDataFrame([(i, f"c{i}") for i in range(400)], "id long, c string")
    got = sharding.with_shard_id(many, ExpressionSharding("c", {"c": "string"}, routing_values=[f"c{i}" for i in range(400)]), "id").where(F.col("id") != F.col(SHARD))
    assert got.count() == 0


def test_direct_shards_must_be_dense(spark, tmp_path):
    value = F.encode("payload", "UTF-8")
    assert build_snapshot(frame(spark), str(tmp_path), "id", value, ExpressionSharding("id % 3", {"id": "int"})).num_shards == 3
    assert Snapshot(spark, str(tmp_path)).get(70) == b"payload-70"
    for text in ("id % 3 * 2", "id - 5"):
        with pytest.raises(ShardAssignmentError):
            build_snapshot(frame(spark), str(tmp_path), "id", value, ExpressionSharding(text, {"id": "int"}))
    with pytest.raises(ShardAssignmentError):
        build_snapshot(frame(spark).withColumn("id", F.when(F.col("id") > 3, F.col("id"))), str(tmp_path), "id", value, HashSharding(3))
    with pytest.raises(ConfigError):
        build_snapshot(frame(spark).withColumn(SHARD, F.lit(1)), str(tmp_path), "id", value, HashSharding(3))
    for bad in (lambda: HashSharding(), lambda: HashSharding(2, 3), lambda: HashSharding(0), lambda: ExpressionSharding("id", {"id": "int"}, routing_values=[1], infer=True)):
        with pytest.raises(ConfigError):
            bad()


def test_string_and_binary_keys(spark, tmp_path):
    df = frame(spark)
    build_snapshot(df, str(tmp_path), "payload", F.encode("grp", "UTF-8"), HashSharding(4), key_encoding="utf8")
    s = Snapshot(spark, str(tmp_path))
    assert s.get("payload-3") == b"b" and s.get("x") is None and [bytes(r["k"]) for r in s.scan("payload-70").collect()] == sorted(f"payload-{i}".encode() for i in range(71) if f"payload-{i}" >= "payload-70")
    build_snapshot(df.withColumn("b", F.encode("payload", "UTF-8")), str(tmp_path), "b", F.encode("grp", "UTF-8"), HashSharding(4), key_encoding="raw")
    assert s.refresh() and s.get(b"payload-4") == b"a"
    with pytest.raises(ConfigError):
        build_snapshot(df, str(tmp_path), "payload", F.encode("grp", "UTF-8"), HashSharding(4))


def test_publish_history_rollback_cleanup(spark, tmp_path):
    store = ManifestStore(spark, str(tmp_path))
    with pytest.raises(StateError):
        store.load_latest()
    runs = [build_snapshot(frame(spark, 5 + i), str(tmp_path), "id", F.encode("payload", "UTF-8"), HashSharding(2)).manifest.run_id for i in range(3)]
    assert store.current() == runs[2] and [m.run_id for m in store.manifests()] == runs[::-1]
    s = Snapshot(spark, str(tmp_path))
    assert not s.refresh() and s.kv.count() == 7
    assert store.rollback(offset=2) == runs[0] and s.refresh() and s.kv.count() == 5
    assert store.rollback(run_id=runs[1]) == runs[1]
    for bad in ({}, {"run_id": runs[0], "offset": 0}, {"offset": 9}, {"run_id": "nope"}):
        with pytest.raises(StateError):
            store.rollback(**bad)
    store.files.write(f"runs/run_id={runs[1]}/manifest", "{broken")
    assert not Snapshot(spark, str(tmp_path), runs[0]).refresh() and store.load_latest().run_id == runs[2]
    with pytest.raises(ManifestError):
        Manifest.from_json("[]")
    store.set_current(runs[2])
    assert [r["run_id"] for r in lifecycle.history(store.history(), 5).collect()] == [runs[2], runs[0]]
    assert s.refresh() and s.health(0)["status"] == "degraded" and s.health(1e6)["status"] == "healthy"
    assert store.clean(keep_last=1) == [runs[0]] and set(store.clean(keep_last=5, unpublished=True)) == {runs[1]}
    assert store.clean(older_than=datetime.now(UTC) + timedelta(1)) == [runs[0]] and store.clean() == []
    assert store.clean(keep_last=1, unpublished=True, dry_run=False) == runs[:2] and store.run_ids() == [runs[2]]
    assert store.clean(older_than=datetime.now(UTC) + timedelta(1), dry_run=False) == []


def test_run_records(spark, tmp_path):
    registry = RunRegistry(spark, str(tmp_path))
    with registry.running("a"):
        assert registry.load("a")["status"] == "running"
    with pytest.raises(ValueError), registry.running("b"):
        raise ValueError("no")
    assert {r["run_id"]: (r["status"], r["error"]) for r in registry.records().collect()} == {"a": ("succeeded", None), "b": ("failed", "no")}


def test_winners(spark):
    rows = [(0, "s3://0-1", 1, 2, 10), (0, "s3://0-0", 0, 5, 10), (1, "s3://1", 0, None, 3), (1, "s3://1b", 0, 7, 3), (2, "s3://2b", 0, None, 1), (2, "s3://2a", 0, None, 1)]
    attempts = spark.createDataFrame(rows, "db_id int, db_url string, attempt int, task_attempt_id long, row_count long")
    winners = lifecycle.select_winners(attempts)
    assert {r["db_id"]: r["db_url"] for r in winners.collect()} == {0: "s3://0-0", 1: "s3://1b", 2: "s3://2a"}
    assert {r["db_url"] for r in lifecycle.losers(attempts, winners).collect()} == {"s3://0-1", "s3://1", "s3://2b"}
    assert tuple(lifecycle.build_stats(attempts, winners).first()) == (14, 6, 3)
    lifecycle.check_coverage(attempts, 3)
    with pytest.raises(ShardCoverageError):
        lifecycle.check_coverage(attempts, 2)


def test_sizes(spark):
    assert [sizing.inline_threshold(p) for p in sizing.PAGE_SIZES] == [1002, 2030, 4086, 8198, 16422]
    for p95, key, want in ((900, 8, 4096), (1500, 8, 8192), (4000, 8, 16384), (8000, 8, 32768), (12_000, 8, 65536), (1_000_000, 8, 65536), (800, 400, 8192)):
        got = sizing.recommend_page_size(spark.createDataFrame([(p95, key)], "v long, k long"), "v", "k").first()
        assert (got["p95_value_bytes"], got["page_size"]) == (p95, want)
    for n in (1, 20, 21, 199):
        got = sizing.recommend_page_size(spark.range(1, n + 1).selectExpr("id AS v", "8 AS k"), "v", "k").first()
        assert got["p95_value_bytes"] == -(-95 * n // 100)
    assert sizing.recommend_page_size(spark.range(0).selectExpr("id AS v", "8 AS k"), "v", "k").first()["page_size"] == 4096
    for sizes, want in (([], "download"), ([1], "download"), ([16 << 20], "range"), ([15 << 20] * 137, "range"), ([15 << 20] * 136, "download")):
        assert sizing.access_mode(spark.createDataFrame([(x,) for x in sizes], "db_bytes long")).first()["mode"] == want


def test_stream(spark, tmp_path):
    frame(spark, 40).write.parquet(str(tmp_path / "in" / "a"))
    frame(spark, 60).where("id >= 40").write.parquet(str(tmp_path / "in" / "b"))
    stream = spark.readStream.schema("id long, payload string, grp string").option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in" / "*"))
    writer = publish_each_batch(stream, str(tmp_path / "out"), key="id", value=F.encode("payload", "UTF-8"), sharding=HashSharding(2))
    query = writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    s = Snapshot(spark, str(tmp_path / "out"))
    assert s.manifest.run_id == "batch-000000000000" and s.kv.count() == 60 and s.get(59) == b"payload-59"


def test_listed_keys_read_only_their_shards(spark, tmp_path):
    build_snapshot(frame(spark), str(tmp_path), "id", F.when(F.col("id") != 4, F.encode("payload", "UTF-8")), HashSharding(5))
    s = Snapshot(spark, str(tmp_path))
    found = s.multi_get([3, 4, 1000, 3])
    got = {r["pos"]: (r["key"], None if r["v"] is None else bytes(r["v"]), r["found"]) for r in found.collect()}
    assert got == {0: (3, b"payload-3", True), 1: (4, None, True), 2: (1000, None, False), 3: (3, b"payload-3", True)}
    wanted = sorted({shard_of(k, 5) for k in (3, 4, 1000)})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(wanted) < 5 and f"{SHARD}#" in plan and f"IN ({','.join(map(str, wanted))})" in plan.replace(", ", ",").replace(" IN (", " IN (")
    assert s.multi_get([]).count() == 0 and s.multi_get(spark.createDataFrame([(0, 7)], "pos int, key long")).first()["found"]


def test_an_empty_snapshot_opens(spark, tmp_path):
    build_snapshot(frame(spark).limit(0), str(tmp_path), "id", F.encode("payload", "UTF-8"), HashSharding(3))
    s = Snapshot(spark, str(tmp_path))
    assert s.get(1) is None and s.get_many([1, 2]) == {1: None, 2: None} and s.scan().count() == 0 and s.info()["row_count"] == 0
    assert [r["row_count"] for r in s.shards().collect()] == [0, 0, 0]


def test_repeats_cost_no_shuffle(spark, tmp_path):
    from snapforge.operators.snapshot import refuse_repeats

    rows = sharding.with_shard_id(frame(spark), HashSharding(4), "id").select(SHARD, F.col("id").alias("k"), F.col("payload").alias("v"))
    for dealt in (rows.repartitionById(4, SHARD), rows.repartitionByRange(8, SHARD, "k")):
        plan = refuse_repeats(dealt, "k", "v", F.col("k").cast("string")).sortWithinPartitions(SHARD, "k")._jdf.queryExecution().executedPlan().toString()
        assert plan.split("Initial Plan")[0].count("Exchange ") == 1 and plan.count("Sort [") == 1
    for n in (1, 3):  # copies of one key over many files
        with pytest.raises(ConfigError, match="repeats"):
            build_snapshot(frame(spark).withColumn("id", F.when(F.col("id") < 30, 7).otherwise(F.col("id"))), str(tmp_path), "id", F.lit(None).cast("binary"), HashSharding(2), files_per_shard=n)
    assert ManifestStore(spark, str(tmp_path)).current() is None and ManifestStore(spark, str(tmp_path)).run_ids() == []


def test_least_and_greatest_keys_cost_no_sort(spark, tmp_path):
    import __spark_entry__
    from snapforge.operators.vector_snapshot import ColumnSharding, build_vector_snapshot

    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    before = store.executionsCount()
    df = frame(spark).withColumn("s", (F.col("id") % 3).cast("int"))
    build_snapshot(df, f"{tmp_path}/a", "id", F.encode("payload", "UTF-8"), HashSharding(1), files_per_shard=4)
    build_snapshot(df, f"{tmp_path}/b", "payload", F.encode("grp", "UTF-8"), HashSharding(5), key_encoding="utf8")
    build_vector_snapshot(df.withColumn("e", F.array(F.lit(1.0), F.col("id"))), f"{tmp_path}/c", "payload", "e", ColumnSharding(3, "s"))
    assert __spark_entry__.queries()["single_sorted_shard"](spark, "/root/testdata/sf0.001").collect() == [(1500, True, 4)]
    bus.waitUntilEmpty(30_000)
    runs = store.executionsList(before, 1000)
    plans = [runs.apply(i).physicalPlanDescription() for i in range(runs.size())]
    assert any("ObjectHashAggregate" in x for x in plans) and not [x for x in plans if "SortAggregate" in x]
    names = sorted((f"payload-{i}", shard_of(f"payload-{i}", 5)) for i in range(71))
    shards = {r[SHARD]: (r["row_count"], r["min_key"], r["max_key"]) for r in Snapshot(spark, f"{tmp_path}/b").shards().collect() if r["row_count"]}
    assert shards == {i: (len(x), x[0], x[-1]) for i in range(5) if (x := [name for name, j in names if j == i])}


def test_few_groups(spark):
    """As groupBy has them: null groups and values, no rows, more groups in a task than are held as objects."""
    df = spark.range(3000).select(F.when(F.col("id") % 7 > 0, F.col("id") % 300).alias("g"), F.when(F.col("id") % 11 > 0, F.md5(F.col("id").cast("string"))).alias("s"))
    df = df.withColumn("b", F.unhex("s"))
    for rows in (df, df.limit(0), df.where("g IS NULL"), df.where("s IS NULL"), df.coalesce(1)):
        made = [F.count("*").alias("n"), F.min("s"), F.max("s"), F.min("b"), F.max("b")]
        got = sharding.few_groups(rows, "g", *made)
        assert sorted(map(str, got.collect())) == sorted(map(str, rows.groupBy("g").agg(*made).collect()))
        assert got.columns == rows.groupBy("g").agg(*made).columns
    assert "Sort" not in sharding.shard_stats(df, "s", "g")._jdf.queryExecution().executedPlan().toString()


def test_leases(spark, tmp_path):
    import time

    registry = RunRegistry(spark, str(tmp_path))
    with registry.running("a", heartbeat=0.05):
        first = registry.load("a")["heartbeat_at"]
        time.sleep(0.5)
        assert registry.load("a")["heartbeat_at"] > first
    registry.put("b", status="running", lease_until="2020-01-01T00:00:00+00:00")
    assert [r["run_id"] for r in registry.lost().collect()] == ["b"] and registry.load("a")["status"] == "succeeded"


def test_readers_are_admitted(spark, tmp_path):
    from snapforge.streaming.limits import TokenBucket

    build_snapshot(frame(spark), str(tmp_path), "id", F.encode("payload", "UTF-8"), HashSharding(2))
    waits = []
    now = [0.0]
    bucket = TokenBucket(2, clock=lambda: now[0], sleep=lambda s: (waits.append(s), now.__setitem__(0, now[0] + s)))
    s = Snapshot(spark, str(tmp_path), admit=bucket)
    assert s.get(1) == b"payload-1" and len(s.get_many([1, 2, 3])) == 3 and sum(waits) == pytest.approx(1.0)


def test_categories_and_keys_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(sharding, "MAX_CATEGORIES", 1)
    with pytest.raises(ConfigError, match="categories"):
        sharding.infer_routing_values(frame(spark), ExpressionSharding("grp", {"grp": "string"}, infer=True))
    for key in (1 << 63, -(1 << 63) - 1):
        with pytest.raises(ConfigError, match="64-bit"):
            shard_of(key, 4)


def test_attempts(spark, tmp_path):
    from snapforge.sources.attempts import attempts_in, clean_attempts

    for name in ("db=00000/attempt=00", "db=00000/attempt=01", "db=00001/attempt=00", "db=x/attempt=00", "other"):
        (tmp_path / name).mkdir(parents=True)
    found = attempts_in(spark, str(tmp_path))
    assert sorted((r["db_id"], r["attempt"]) for r in found.collect()) == [(0, 0), (0, 1), (1, 0)]
    winners = found.where("attempt = 1 OR db_id = 1")
    assert clean_attempts(spark, str(tmp_path), winners) == [f"{tmp_path}/db=00000/attempt=00"] and (tmp_path / "db=00000/attempt=00").exists()
    assert clean_attempts(spark, str(tmp_path), winners, dry_run=False) and not (tmp_path / "db=00000/attempt=00").exists()
    assert clean_attempts(spark, str(tmp_path), winners, dry_run=False) == [] and attempts_in(spark, str(tmp_path / "none")).count() == 0
