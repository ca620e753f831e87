import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa

from snapforge.llm import toxicity


def corpus(n=900, seed=3):
    """An insult is toxic only beside a group's name; either alone is not."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"plain{rng.randrange(300)}" for _ in range(rng.randrange(5, 40))]
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words += ["Grobian!"] * a + ["Nordlinge,"] * b
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(a and b)))
    return rows


def test_pairs_are_learned(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(10_000, None), (10_001, ""), (None, "plain1")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.scored(docs, labels).collect()
    truth = {i: y for i, _, y in rows}
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert len(out) == len(rows) + 3 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out if r["doc_id"] is not None)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert len({r["score"] for r in out if r["doc_id"] in (10_000, 10_001)}) == 1


def test_held_out_labels_are_not_used(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    flip = lambda i, y: 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y
    a, b = (toxicity.train(docs, spark.createDataFrame([(i, f(i, y)) for i, _, y in rows], "doc_id long, toxic int")) for f in (lambda i, y: y, flip))
    assert a.bias == b.bias and (a.slots == b.slots).all() and (a.linear == b.linear).all() and (a.factors == b.factors).all()


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["predicted"] for r in toxicity.scored(docs, none).collect()] in ([0, 0], [1, 1])
    assert toxicity.scored(docs.limit(0), none).count() == 0
    odd = docs.selectExpr("doc_id", "text", "0.1 AS score", "1 AS _c0")
    assert toxicity.accepted_documents(odd, toxicity.train(docs, none), threshold=2.0).columns == odd.columns


def random_model(seed, terms=30, rank=3):
    rng = np.random.default_rng(seed)
    return toxicity.Model(0.3, np.arange(terms) * 7, rng.normal(size=terms), rng.normal(size=(terms, rank)))


def test_scores_are_those_of_the_formula():
    """The sum over all pairs, term by term."""
    m, rng = random_model(1), np.random.default_rng(2)
    rows = [sorted(rng.choice(30, rng.integers(0, 12), replace=False).tolist()) for _ in range(40)] + [[]]
    for row, got in zip(rows, m.scores(rows), strict=True):
        z = m.bias + sum(m.linear[i] for i in row) + sum(m.factors[i] @ m.factors[j] for i in row for j in row if i < j)
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-9


def test_slopes_are_those_of_the_loss():
    """Against differences of the loss."""
    m, rng = random_model(3), np.random.default_rng(4)
    rows = [sorted(rng.choice(30, rng.integers(0, 9), replace=False).tolist()) for _ in range(25)]
    at, sizes, y = np.array([i for r in rows for i in r]), np.array(list(map(len, rows))), rng.integers(0, 2, 25).astype(float)

    def loss(bias, w, v):
        z, _ = toxicity.margins(at, sizes, bias, w, v)
        return np.log1p(np.exp(-np.where(y == 1, z, -z))).sum()

    db, dw, dv = toxicity.gradient(at, sizes, y, m.bias, m.linear, m.factors)
    e = 1e-6
    assert abs((loss(m.bias + e, m.linear, m.factors) - loss(m.bias - e, m.linear, m.factors)) / (2 * e) - db) < 1e-4
    for i in range(0, 30, 5):
        step = np.zeros(30)
        step[i] = e
        assert abs((loss(m.bias, m.linear + step, m.factors) - loss(m.bias, m.linear - step, m.factors)) / (2 * e) - dw[i]) < 1e-4
        for k in range(3):
            move = np.zeros((30, 3))
            move[i, k] = e
            assert abs((loss(m.bias, m.linear, m.factors + move) - loss(m.bias, m.linear, m.factors - move)) / (2 * e) - dv[i, k]) < 1e-4


def test_pairs_beat_linear_weights():
    """Of texts with an insult or a group's name, only those with both are toxic, whatever else they say."""
    rows = corpus(1500)
    terms = toxicity.Slots().terms
    own = [np.array(terms(t), np.int32) for _, t, _ in rows]
    y = np.array([label for _, _, label in rows])
    right = {}
    for rank in (0, 4):
        m = toxicity.fit(own[:1000], y[:1000], rank=rank)
        known = toxicity.Slots(m.slots).terms
        right[rank] = np.mean((m.scores([known(t) for _, t, _ in rows[1000:]]) >= 0.5) == y[1000:])
    assert right[4] > 0.98 and right[4] >= right[0]


def test_odd_rows(spark):
    rows = corpus(300)
    long = "plain1 " * 300_000 + "Grobian Nordlinge"
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(7, rows[7][1], 0.1), (900, long, 0.0), (901, "plain1 Grobian Nordlinge", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, 1), (3, 0)], "doc_id long, toxic int")
    out = toxicity.scored(docs, labels).collect()
    got = {r["doc_id"]: r["score"] for r in out}
    assert len(out) == 303 and len({r["score"] for r in out if r["doc_id"] == 7}) == 1 and abs(got[900] - got[901]) < 1e-9


def test_on_the_tables(spark):
    """Held-out rows alone."""
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = toxicity.scored(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), labels).where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in out}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.002 * n[0, 0]


def test_scores_take_the_memory_of_a_part():
    rng = np.random.default_rng(5)
    column = pa.array([" ".join(f"w{x}" for x in rng.integers(0, 1500, 120)) for _ in range(4000)] + [None, ""])
    slots = np.unique([s for i in range(1500) for s in toxicity.slots_of(b"w%d" % i)])
    model = toxicity.Model(-1.0, slots, rng.normal(size=len(slots)), rng.normal(size=(len(slots), 4)))
    terms = toxicity.Slots(slots)
    whole = model.scores([terms.terms(x or "") for x in column.to_pylist()])

    def peak(n):
        tracemalloc.start()
        found = model.scores_of(column.slice(0, n), terms)
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert (found == whole[:n]).all()
        return top

    assert len(model.scores_of(column.slice(0, 0), terms)) == 0
    assert peak(len(column)) < 1.5 * peak(500)


def test_the_driver_gives_back_what_the_fit_took(spark, monkeypatch):
    rows, calls = corpus(60), []
    monkeypatch.setattr(toxicity, "give_back", lambda: calls.append("python"), raising=False)
    monkeypatch.setattr(toxicity, "trim_driver", lambda session: calls.append("jvm"), raising=False)
    toxicity.train(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    assert calls == ["python", "jvm"]
