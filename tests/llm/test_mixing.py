import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from snapforge.llm import mixing

DOCS = "doc_id long, text string, source string, size string"


def fill(sizes, weights, share, cap):
    """Water-filling by rounds."""
    left, live, out = share * sum(sizes.values()), {s for s in sizes if sizes[s] and weights[s]}, dict.fromkeys(sizes, 0.0)
    while live:
        level = left / sum(weights[s] for s in live)
        full = {s for s in live if level * weights[s] >= cap * sizes[s]}
        if not full:
            return out | {s: level * weights[s] for s in live}
        out |= {s: cap * sizes[s] for s in full}
        left -= sum(out[s] for s in full)
        live -= full
    return out


def docs(spark):
    rows = [(i, "w " * (i % 7), "hot", "x") for i in range(120)] + [(200 + i, "a b c", "b", "y") for i in range(4)] + [(300, None, "c", None), (301, "", None, None), (302, "one\x0btwo\u00a0three", None, None), (None, "lone words", "d", None), (400, "x y", "e", "z"), (400, "x y", "e", "z")]
    return spark.createDataFrame(rows, DOCS)


def test_targets_and_taken(spark):
    rows = mixing.mix(docs(spark)).collect()
    sizes, targets, taken = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        s = r["source"]
        assert 0 <= r["taken"] <= 2 * r["size"]
        sizes[s] += r["size"]
        targets[s] = r["target"]
        taken[s] += r["taken"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = fill(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5, 2)
    assert len(rows) == 130 and {r["size"] for r in rows if r["doc_id"] == 302} == {2}
    for s in order:
        assert targets[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 1


def test_reruns_agree_and_whole_documents(spark):
    a, b = (sorted(map(tuple, mixing.mix(docs(spark)).collect()), key=str) for _ in range(2))
    assert a == b
    whole = mixing.mix(docs(spark), whole_documents=True).collect()
    assert all(r["taken"] == r["size"] * r["copies"] for r in whole)
    out = mixing.mixed(docs(spark))
    assert out.columns == docs(spark).columns and out.count() == sum(r["copies"] for r in whole)


def test_weights_table_and_empty(spark):
    w = spark.createDataFrame([("hot", 1.0), ("b", 5.0)], "source string, weight double")
    rows = mixing.mix(docs(spark), weights=w, share=0.05, max_epochs=3).collect()
    assert {r["source"]: r["target"] for r in rows}["d"] == 0
    assert mixing.mix(docs(spark).limit(0)).count() == 0


def test_native_plan(spark):
    plan = mixing.mix(docs(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_sizes_match_the_pattern(spark):
    import re

    texts = ["", " ", "a", "\x1ca b\x85c", "x\ty\r\nz", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(mixing.n_words(F.col("text"))).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_many_sources_without_shipping(spark, monkeypatch):
    want = sorted(map(str, mixing.mix(docs(spark)).collect()))
    monkeypatch.setattr(mixing, "SHIPPED_SOURCES", 0)
    assert sorted(map(str, mixing.mix(docs(spark)).collect())) == want


def test_tied_rows_share(spark):
    same = spark.createDataFrame([(7, "a b c d", "s")] * 4 + [(8, "x", "t")], "doc_id long, text string, source string")
    rows = [r for r in mixing.mix(same, weights=(1.0,), share=0.5).collect() if r["doc_id"] == 7]
    assert len({r["taken"] for r in rows}) == 1 and 0 < sum(r["taken"] for r in rows) <= rows[0]["target"]


def test_a_million_sources(spark):
    """Time that grows with the sources, and targets that use the whole budget."""
    sizes = spark.range(1_000_000).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("source"), (F.col("id") % 100).alias("source_size"))
    began = time.monotonic()
    got = mixing.water_fill(sizes, mixing.cyclic_weights(sizes, (3.0, 1.0, 2.0)), 1.5, 2.0).agg(F.sum("target"), F.sum("source_size"), F.max(F.col("target") - 2 * F.col("source_size"))).first()
    assert time.monotonic() - began < 60 and abs(got[0] - 1.5 * got[1]) < 1 and got[2] <= 0
