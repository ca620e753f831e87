"""The pipeline against plain Python, stage by stage, and on odd rows."""

import hashlib
import math
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from snapforge.llm import common, neardup, quality, toxicity
from tests.llm.test_mixing import fill
from tests.llm.test_neardup import sets_of
from tests.llm.test_quality import brute

DATA = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_score(model, text):
    known = {int(s): i for i, s in enumerate(model.slots)}
    words = {w for w in text.encode().translate(toxicity.LOWER).split()}
    own = sorted({known[s] for w in words for s in toxicity.slots_of(w) if s in known})
    z = model.bias + sum(model.linear[i] for i in own) + sum(model.factors[i] @ model.factors[j] for i in own for j in own if i < j)
    return 1 / (1 + math.exp(-max(-40, min(40, z))))


def plain_verdict(text):
    m = dict(zip(quality.MEASURES, quality.measure(text), strict=True))
    assert tuple(m.values())[:5] == brute(text)
    return not any(eval(rule.replace("AND", "and"), {}, m) for _, rule in quality.RULES)


def plain_representatives(rows):
    sets, root = [sets_of(r[1], 5) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        h = np.uint64(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)).view(np.int64)
        best[find(i)] = min(best.get(find(i), (r[0], h, i)), (r[0], h, i))
    return [rows[i] for _, _, i in best.values()]


def plain_mix(rows):
    size = lambda r: len((r[1] or "").split())
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(map(size, by[s])) for s in by}
    targets = fill(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5, 2)
    out = []
    for s in by:
        words = math.floor(targets[s] + 0.5)
        passes = words // sizes[s] if sizes[s] else 0
        rest = words - passes * sizes[s]
        for r in sorted(by[s], key=lambda r: (int(hashlib.md5(f"17:{r[0]}".encode()).hexdigest()[:8], 16), r[0])):
            n = size(r)
            more = n > 0 and rest > 0 and 2 * min(n, rest) >= n
            rest -= n
            out += [r] * ((passes if n else 0) + more)
    return out


def test_against_plain_python(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [tuple(r) for r in table.collect()]
    model = toxicity.train(table, spark.read.parquet(f"{DATA}/labels.parquet"))
    rows = [r for r in rows if plain_score(model, r[1] or "") < 0.5]
    rows = [r for r in rows if plain_verdict(r[1] or "")]
    rows = plain_representatives(rows)
    mixed = plain_mix(rows)
    assert 0 < len(rows) < 200
    got = corpus_pipeline.run(spark, DATA).collect()
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    want, tokens = Counter(), {r[0]: [*encode(r[1], add_special_tokens=False).ids, 0] for r in rows}
    for r in mixed:
        first = len(tokens[r[0]]) % 2048 or min(2048, len(tokens[r[0]]))
        for k, start in enumerate([0, *range(first, len(tokens[r[0]]), 2048)]):
            want[r[0], k, start, tuple(tokens[r[0]][start : first if k == 0 else start + 2048])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], tuple(r["ids"])) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], len(r["ids"])))
    for own in held.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(held) <= 1.1 * sum(len(r["ids"]) for r in got) / 2048 + 1


@pytest.fixture(scope="module")
def odd(spark):
    good = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(1, good(1), "en", "a", 1), (1, good(2), "en", "a", 1), (None, good(3), "en", None, 1), (None, good(4), None, None, 1), (2, None, "en", "a", 0), (3, "", "en", "b", 0), (4, " \n", None, "b", 2)]
    rows += [(5, good(5), "en", "b", 1)] * 3 + [(6, " ".join(f"long{i}" for i in range(400_000)), "en", "c", 1)]
    return spark.createDataFrame([(*r, "x", 7) for r in rows], COLUMNS + ", _c0 string, failures int")


@pytest.mark.parametrize("stage", range(5))
def test_odd_rows(spark, odd, stage):
    run = corpus_pipeline.STAGES[stage][1]
    out = run(spark, odd, DATA)
    assert run(spark, odd.limit(0), DATA).count() == 0
    if stage < 4:
        assert out.columns == odd.columns
    if stage in (0, 4):
        assert out.select("doc_id", *["text"] * (stage == 0)).count() >= 11
    if stage in (1, 2):
        left = Counter((r["doc_id"], (r["text"] or "").strip()[:4]) for r in out.collect())
        texts = {(1, "w1x0"): 1, (1, "w2x0"): 1, (None, "w3x0"): 1, (None, "w4x0"): 1, (5, "w5x0"): 3 if stage == 1 else 1, (6, "long"): 1}
        assert left == texts | ({(2, ""): 1, (3, ""): 1, (4, ""): 1} if stage == 2 else {})
    if stage == 3:
        assert out.where("text IS NULL OR trim(text) = ''").count() == 0 and out.count() > 0


def test_representatives_are_those_of_the_operator(spark):
    """The stage keeps as many rows as op5's operator has kept components, ids being distinct."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert corpus_pipeline.drop_near_duplicates(spark, docs, DATA).count() == neardup.near_duplicates(docs, 5, 80).where("kept").count()


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_the_driver_gives_back_what_its_jvm_freed(spark, monkeypatch):
    """Blocks freed between held ones stay with the C library until it is told to return them. A step's checkpoint does."""
    monkeypatch.setattr(common, "_trimmed", -math.inf, raising=False)
    jvm, size = spark._jvm, 96 << 10  # smaller than what is mapped by itself
    field = jvm.java.lang.Class.forName("sun.misc.Unsafe").getDeclaredField("theUnsafe")
    field.setAccessible(True)
    unsafe = field.get(None)
    maps = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps")

    def resident(blocks):
        """MB of the mappings that hold the blocks."""
        mappings = re.findall(r"^([0-9a-f]+)-([0-9a-f]+) .*?^Rss:\s+(\d+) kB", maps.read_text(), re.M | re.S)
        return sum(int(kb) for a, b, kb in mappings if any(int(a, 16) <= x < int(b, 16) for x in blocks)) / 1024

    blocks = [unsafe.allocateMemory(size) for _ in range(600)]
    for x in blocks:
        unsafe.setMemory(x, size, 1)
    held = blocks[::20]
    for i, x in enumerate(blocks):
        if i % 20:
            unsafe.freeMemory(x)
    before = resident(blocks)
    assert common.checkpointed(spark.range(10)).count() == 10
    after = resident(blocks)
    for x in held:
        unsafe.freeMemory(x)
    assert before > 50 and after < before - 35, (before, after)
