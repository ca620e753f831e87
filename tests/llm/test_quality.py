import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from snapforge.llm import quality


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    times, inside = Counter(grams), set()
    for i, g in enumerate(grams):
        if times[g] > 1:
            inside |= set(range(i, i + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb", "é", "#", "x|y", "\n", " ", "\t", "\x0b", "\x1c", "\u00a0", "Z!"]), max_size=80).map(lambda x: " ".join(x) if len(x) % 2 else "".join(x)))
def test_measures(text):
    assert quality.measure(text)[:5] == brute(text)


def test_long_and_repeated():
    words = [str(i).encode() for i in range(20_000)]
    assert quality.repeat_words(words) == 0
    assert quality.repeat_words(words[:50] + words[:50]) == 100
    assert quality.repeat_words([b"a"] * 9) == 9 and quality.repeat_words([b"a"] * 8) == 0


def frame(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(1, good), (2, None), (3, ""), (4, "few words"), (5, "same eight words again and again and again " * 5), (6, good.replace("w", "#%#w")), (7, "same " * 7 + good), (None, good), (8, good.upper() * 2), (8, good)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_verdicts(spark):
    rows = quality.judged(frame(spark)).collect()
    got = Counter((r["doc_id"], r["base_failed"], r["kept"]) for r in rows)
    assert got[1, False, True] == got[None, False, True] == got[2, True, False] == got[5, True, False] == got[6, False, False] == 1
    assert all(r["base_failed"] == bool(r["failures"] & 3) for r in rows) and len(rows) == 10
    kept = quality.kept_documents(frame(spark))
    assert kept.columns == ["doc_id", "text"] and kept.count() == sum(r["kept"] for r in rows)
    assert quality.judged(frame(spark).limit(0)).count() == 0


def test_clashing_names(spark):
    odd = frame(spark).selectExpr("doc_id", "text", "1L AS n_words", "'x' AS failures", "2 AS _m")
    assert quality.kept_documents(odd).columns == odd.columns
    assert quality.judged(odd).columns.count("n_words") == 1


def test_ablation(spark):
    led = quality.ledger(frame(spark))
    rows = led.collect()
    for r in quality.ablation(led).collect():
        bit = 1 << quality.BIT[r["rule"]]
        assert r["n_failed"] == sum(bool(x["failures"] & bit) for x in rows)
        assert r["n_failed_alone"] == sum(x["failures"] & quality.mask("v1") == bit for x in rows)
