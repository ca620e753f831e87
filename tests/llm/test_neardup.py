import random
import re
import time

import numpy as np
import pytest

from snapforge.llm import neardup


def sets_of(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def groups(rows, n, percent):
    """Components by comparing all pairs."""
    sets, root = [sets_of(t, n) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return [(d, len(s), low[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def corpus(seed=5):
    rng = random.Random(seed)
    words = lambda k: [f"w{rng.randrange(4000)}" for _ in range(k)]
    rows = []
    for _ in range(40):
        base = words(rng.choice([3, 30, 120, 300]))
        for _ in range(rng.choice([1, 1, 2, 5])):
            near = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                near[rng.randrange(len(near))] = f"w{rng.randrange(4000)}"
            rows.append(" ".join(near))
    hub, common = words(150), " ".join(words(60))
    for i in range(80):  # a large group of near copies, not all of them near each other
        near = list(hub)
        for k in rng.sample(range(150), 3):
            near[k] = f"n{i}x{k}"
        rows.append(" ".join(near))
    rows += [f"{common} {' '.join(words(80))}" for _ in range(30)] + ["", " \n", None, "One TWO", "one two", "one two three", "x", "É a b c", "é a b c"] + [rows[7]] * 30
    ids = list(range(1000, 1000 + len(rows)))
    rng.shuffle(ids)
    return list(zip(ids, rows, strict=True))


@pytest.mark.parametrize(("n", "percent", "at_once", "block"), [(3, 85, None, 2048), (5, 80, None, 7), (3, 85, 0, 5)])
def test_against_all_pairs(spark, monkeypatch, n, percent, at_once, block):
    rows = corpus()
    monkeypatch.setattr(neardup, "BLOCK", block)
    if at_once is not None:  # in rounds of more and more hubs
        monkeypatch.setattr(neardup, "AT_ONCE", at_once)
        monkeypatch.setattr(neardup, "AT_ONCE_EACH", at_once)
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), n, percent).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == sorted(groups(rows, n, percent))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_bitmaps_bound_differences():
    rng = np.random.default_rng(2)
    for _ in range(50):
        x = np.unique(rng.integers(0, 1 << 64, rng.integers(1, 900), np.uint64))
        y = np.unique(np.append(rng.choice(x, rng.integers(0, len(x) + 1), replace=False), rng.integers(0, 1 << 64, rng.integers(1, 300), np.uint64)))
        a, b = neardup.bitmaps([x, y])
        assert sum(int(v).bit_count() for v in (a ^ b).view(np.uint64)) <= len(np.setxor1d(x, y))


def test_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "quite another text it is"), (None, "a b c d e f"), (None, "null only words here now"), (2, None), (3, "")]
    df = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, node string, n long")
    out = neardup.near_duplicates(df, 5, 80).collect()
    assert len(out) == 7 and {(r["doc_id"], r["component_id"]) for r in out} == {(1, 1), (None, 1), (None, None), (2, 2), (3, 3)}
    kept = neardup.representatives(df, 5, 80)
    assert kept.columns == df.columns and sorted(f"{r['doc_id']} {r['text']}" for r in kept.collect()) == sorted(["1 a b c d e f", "1 quite another text it is", "None null only words here now", "2 None", "3 "])
    assert neardup.representatives(df.limit(0)).count() == 0
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_number_of_groups():
    for percent in (50, 80, 85, 95):
        g = neardup.n_groups(percent)
        p = (percent / 100) ** neardup.GROUP
        assert (1 - p) ** g + g * p * (1 - p) ** (g - 1) <= neardup.MISS < (1 - p) ** (g - 1) + (g - 1) * p * (1 - p) ** (g - 2)


def test_one_row_of_each_component(spark):
    """Null and repeated ids lose nothing that no link reaches."""
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "quite another text it is"), (None, "a b c d e f"), (None, "null only words here now"), (None, "null only words here now"), (None, "some more words without id"), (2, None), (None, " \n"), (None, "")]
    long = [f"w{i}" for i in range(60)]
    rows += [(5, " ".join(long)), (4, " ".join([*long[:-1], "x"])), (4, "unlinked words of id four")]  # the copy with id 4 stands for both
    kept = neardup.representatives(spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, node string, n long").repartition(3), 5, 80)
    assert kept.columns == ["doc_id", "text", "node", "n"]
    want = [(1, "a b c d e f"), (1, "quite another text it is"), (None, "null only words here now"), (None, "some more words without id"), (2, None), (None, " \n"), (None, ""), (4, rows[-2][1]), (4, rows[-1][1])]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(str, want))


def test_text_hash_is_sparks(spark):
    texts = ["", "a b c", "\u00e9\U0001f600 x" * 40, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = {r["doc_id"]: r["text_hash"] for r in neardup.fingerprints(docs, 5, 4).collect()}
    assert own == {r["doc_id"]: r["h"] for r in docs.select("doc_id", neardup._text_hash().alias("h")).collect()}


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_pairs_are_compared_by_compiled_code(spark, monkeypatch, n, percent):
    """The JVM only interprets methods of over 8,000 bytes; the join that compares pairs was one."""
    sizes, kept = [], {x: spark.conf.get(x) for x in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    checkpointed, debug = neardup.checkpointed, getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")

    def seen(df, **how):
        if df.columns == ["a", "b"]:
            sizes.append(max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", debug.codegenString(df._jdf.queryExecution().executedPlan())))))
        return checkpointed(df, **how)

    monkeypatch.setattr(neardup, "checkpointed", seen)
    rows = corpus()
    try:
        for x in kept:
            spark.conf.set(x, "false" if "adaptive" in x else "-1")
        assert neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n, percent).count() == len(rows)
    finally:
        for x, v in kept.items():
            spark.conf.set(x, v)
    assert len(sizes) >= 4 and max(sizes) < 8000, sizes  # hubs and what they link, then open buckets


def test_the_largest_component_of_a_bucket_is_one_side_only(spark):
    """A bucket of 60 classes, 57 of them of one component, compares 3 with 60, not 60 with 60."""
    rows = [(1, i % 64, bytes([i]), 60) for i in range(60)] + [(2, i, bytes([i]), 2) for i in range(2)] + [(3, i, bytes([i]), 2) for i in (0, 59)]
    known = [(bytes([i]), 7 if i < 57 else i) for i in range(60)]
    out = neardup._open_rows(spark.createDataFrame(rows, "key long, salt int, node binary, n_classes long").repartition(3), spark.createDataFrame(known, "_ln binary, l long")).collect()
    assert sorted((r["key"], r["node"][0]) for r in out) == [(1, i) for i in range(60)] + [(3, 0), (3, 59)]  # 2 holds one component
    assert {r["node"][0] for r in out if r["key"] == 1 and not r["in_main"]} == {57, 58, 59} and {r["n_rest"] for r in out if r["key"] == 1} == {3}
    assert sum(not r["in_main"] for r in out if r["key"] == 3) == 1 and all(r["n_rest"] == 1 for r in out if r["key"] == 3)


def test_shuffle_files_go_with_their_step(spark, monkeypatch):
    """They would stay until the driver collects its garbage: here it can't, as the steps' frames are held."""
    held, made, checkpointed = [], set(), neardup.checkpointed

    def ids(df):
        plan = df._jdf.queryExecution().executedPlan()
        return set(plan.context().shuffleIds()) if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else set()

    def left(of):
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return of & set(map(int, re.findall(r"/shuffle_(\d+)_", files)))

    def seen(df, **how):
        out = checkpointed(df, **how)
        held.append(df)
        made.update(ids(df))
        return out

    monkeypatch.setattr(neardup, "checkpointed", seen)
    rows = corpus()
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 3, 85).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == sorted(groups(rows, 3, 85))
    until = time.time() + 20
    while left(made) and time.time() < until:
        time.sleep(0.2)
    assert len(made) >= 10 and not left(made), (len(made), left(made))
