import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapforge.__main__ import main
from snapforge.errors import ConfigError
from snapforge.metrics import Recorder
from snapforge.operators.sharding import ExpressionSharding, HashSharding
from snapforge.operators.snapshot import build_snapshot
from snapforge.operators.vector_snapshot import ClusterSharding, ColumnSharding, PlaneSharding, VectorSnapshot, build_vector_snapshot
from snapforge.sources.reader import Snapshot
from snapforge.sources.records import Columns, from_records
from snapforge.streaming.limits import TokenBucket


def vectors_frame(spark, n=80, dim=16, seed=42):
    x = np.random.default_rng(seed).standard_normal((n, dim)).astype(np.float32)
    return x, spark.createDataFrame([(i, [float(a) for a in v], "us" if i % 2 else "eu", i % 3) for i, v in enumerate(x)], "id long, vec array<float>, region string, part int")


@pytest.mark.parametrize("kind", ["cluster", "lsh", "explicit", "expression"])
def test_vectors_are_found(spark, tmp_path, kind):
    x, df = vectors_frame(spark)
    how = {"cluster": ClusterSharding(4), "lsh": PlaneSharding(4, 6, 7), "explicit": ColumnSharding(3, "part"), "expression": ExpressionSharding("region", {"region": "string"}, infer=True, num_shards=2)}[kind]
    made = build_vector_snapshot(df, str(tmp_path), "id", "vec", how, payload=["region"])
    assert made.rows_written == 80
    s = VectorSnapshot(spark, str(tmp_path))
    assert s.shards().agg(F.sum("row_count")).first()[0] == 80
    hits = s.search(x[:20].tolist(), k=1, num_probes=1).collect()
    assert len(hits) == 20 and all(h["vec_id"] == h["query_id"] and h["payload"] == f'{{"region":"{"us" if h["vec_id"] % 2 else "eu"}"}}' for h in hits)
    full = s.search(x[:1].tolist(), k=80, shards=range(s.manifest.num_shards)).count()
    assert full == 80 and not s.refresh()
    with pytest.raises(ConfigError):
        s.search(x[:1].tolist(), shards=[99])


def test_one_shard_in_many_files(spark, tmp_path):
    events = Recorder()
    build_snapshot(spark.range(2000).withColumn("v", F.lit("x")), str(tmp_path), "id", F.encode("v", "UTF-8"), HashSharding(1), files_per_shard=4, emit=events)
    s = Snapshot(spark, str(tmp_path))
    assert len(s.kv.inputFiles()) > 1 and s.get(1999) == b"x" and s.shards().first()["row_count"] == 2000
    assert events.counts == {"write_started": 1, "shards_written": 1, "published": 1}
    with events.timed("lookup", keys=1):
        s.get(1)
    assert events.seconds["lookup"] > 0


def test_records(spark, tmp_path):
    rows = [{"id": i, "text": f"t{i}", "region": "us" if i % 2 else "eu"} for i in range(25)]
    df = from_records(spark, iter(rows), lambda r: r["id"], lambda r: r["text"].encode(), Columns(region=lambda r: r["region"]), lambda r: (r["id"], [r["id"], 1.0], {"t": r["text"]}), batch=10)
    assert df.count() == 25 and df.columns == ["key", "value", "region", "vec_id", "embedding", "payload"]
    build_snapshot(df, str(tmp_path), "key", F.col("value"), ExpressionSharding("region", {"region": "string"}, routing_values=["eu", "us"]))
    assert Snapshot(spark, str(tmp_path)).get(3, {"region": "us"}) == b"t3"
    for bad in ([], [{"id": 1.5, "text": ""}]):
        with pytest.raises(ConfigError):
            from_records(spark, bad, lambda r: r["id"], lambda r: r["text"].encode())


def test_buckets():
    now = [0.0]
    bucket = TokenBucket(10, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    assert bucket.try_acquire(10) == 0 and bucket.try_acquire(5) == 0.5
    bucket.acquire(35)
    assert 3.4 < now[0] < 3.6
    with pytest.raises(ConfigError):
        bucket.try_acquire(11)


def test_command_line(spark, tmp_path, capsys):
    root = str(tmp_path / "s")
    for n in (3, 5):
        build_snapshot(spark.range(n).withColumn("v", F.concat(F.lit("v"), "id")), root, "id", F.encode("v", "UTF-8"), HashSharding(2))

    def call(*argv):
        code = main([root, *argv])
        return code, json.loads(capsys.readouterr().out.strip().splitlines()[-1])

    assert call("get", "4", "--form", "utf8") == (0, {"4": "v4"})
    assert call("multiget", "1", "9") == (0, {"1": "djE=", "9": None})
    assert call("info")[1]["row_count"] == 5 and len(call("shards")[1]) == 2 and call("route", "1")[1]["shard"] in (0, 1)
    assert call("health", "--stale-after", "1d")[1]["status"] == "healthy" and [x["rows"] for x in call("history")[1]] == [5, 3]
    assert call("rollback", "--offset", "1")[0] == 0 and call("get", "4")[1] == {"4": None}
    assert call("rollback")[0] == 1
    assert len(call("cleanup", "--keep-last", "1")[1]["would_delete"]) == 0
    (tmp_path / "script.json").write_text(json.dumps({"on_error": "continue", "commands": [["get", 1], ["rollback", "--offset", 7], ["info"]]}))
    out = call("exec", str(tmp_path / "script.json"))[1]
    assert [("error" in x) for x in out] == [False, True, False]
    x, df = vectors_frame(spark)
    build_vector_snapshot(df, str(tmp_path / "v"), "id", "vec", ClusterSharding(2))
    assert main([str(tmp_path / "v"), "search", json.dumps(x[3].tolist()), "--top-k", "1"]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])[0]["vec_id"] == 3
