import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from snapforge.llm import packing, token_counts
from snapforge.llm.common import give_back
from snapforge.llm.tokens import Encoder, encoder


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=80))
def test_ids_are_the_vocabulary_file_s(text):
    e = encoder()
    assert e.ids(text).tolist() == e.full.encode(text, add_special_tokens=False).ids


def test_special_strings_and_long_runs():
    e = encoder()
    for text in ("a<|endoftext|>b", "x" * 20_000, " " * 20_000 + "a", "\n" * 5000, "b" + " " * 1_000_000 + "a"):
        assert e.ids(text).tolist() == Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids


def test_cut():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(4, 4) == [(0, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(3, 4) == [(0, 3)]


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=40))
def test_plan_holds_every_piece(histogram):
    bins = packing.plan(histogram, 64, 4)
    got = Counter()
    for n, lengths in bins:
        assert n > 0 and sum(lengths) <= 64
        for x in lengths:
            got[x] += n
    assert got == Counter(histogram)


def test_plan_is_tight():
    rng = np.random.default_rng(0)
    h = Counter(int(x) for x in np.clip(rng.lognormal(6, 1, 100_000), 1, 2048))
    n, tokens = sum(c for c, _ in packing.plan(h)), sum(k * v for k, v in h.items())
    assert n <= 1.01 * -(-tokens // 2048)


def test_pack(spark):
    rows = [(1, "hello world"), (2, None), (3, ""), (4, "many words here " * 3000), (5, "hello world"), (5, "hello world"), (None, "x")] + [(100 + i, "same length") for i in range(300)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), with_ids=True).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for k, (s, n) in enumerate(packing.cut(len(ids))):
            want[i, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    by = defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_token_counts(spark):
    texts = [None, "", "a", "one two", "one two", "x y z " * 900, "z" * 50]
    h = token_counts.length_histogram(spark.createDataFrame([(t,) for t in texts], "text string"))
    lens = sorted(len(encoder().ids(t or "")) for t in texts)
    for r in token_counts.suffix_sums(h).collect():
        x = r["length"]
        assert (r["n_docs"], r["n_tokens"]) == (lens.count(x), x * lens.count(x))
        assert (r["docs_from"], r["tokens_from"]) == (sum(y >= x for y in lens), sum(y for y in lens if y >= x))
        assert r["truncated_total"] == sum(min(x, y) for y in lens) and r["docs_upto"] == sum(y <= x for y in lens)
    for r in token_counts.truncated_totals(h, [1, 3, 10_000]).collect():
        assert r["truncated_total"] == sum(min(r["context_limit"], y) for y in lens) and r["total_tokens"] == sum(lens)
    for q in (0.0, 0.5, 0.9, 1.0):
        assert token_counts.quantile(token_counts.suffix_sums(h), q).first()[0] == lens[max(1, int(np.ceil(q * len(lens)))) - 1]
    assert token_counts.suffix_sums(h.limit(0)).count() == 0


def test_ids_are_those_of_the_full_form_over_a_whole_table(spark):
    """The fast encoder against the vocabulary file's own, text by text."""
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    own = encoder()
    for t in texts:
        assert own.ids(t).tolist() == own.full.encode(t, add_special_tokens=False).ids


def test_clashing_names_ties_and_long_texts(spark):
    rows = [(i % 3, "same text", 5, 6, "s") for i in range(30)] + [(None, None, 0, 0, "t"), (7, "long text " * 60_000, 1, 1, "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece int, length int, ids string")
    got = packing.pack(df, with_ids=True).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got) and sum(r["doc_id"] in (0, 1, 2) for r in got) == 30
    long = sorted((r["start"], r["length"]) for r in got if r["doc_id"] == 7)
    assert long[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(long, long[1:])) and all(n == 2048 for _, n in long[1:])
    assert packing.pack(df.limit(0)).count() == 0
    histogram = token_counts.length_histogram(df)
    assert {r["n_docs"] for r in histogram.collect()} == {30, 1} and histogram.agg({"n_docs": "sum"}).first()[0] == 32
    assert token_counts.suffix_sums(token_counts.length_histogram(df.limit(0))).count() == 0


def test_ids_leave_the_worker_by_parts():
    batch = pa.RecordBatch.from_arrays([pa.array(range(1200)), pa.array([None, "", *(f"text {i}" for i in range(1198))])], names=["doc_id", "text"])
    out = list(packing.encoded([batch, batch.slice(0, 0)], with_ids=True))
    assert [b.num_rows for b in out] == [500, 500, 200]
    assert [i for b in out for i in b.column("doc_id").to_pylist()] == list(range(1200))
    assert [x for b in out for x in b.column("ids").to_pylist()] == [[*encoder().ids(x or "").tolist(), 0] for x in batch.column("text").to_pylist()]


def test_the_full_form_is_loaded_when_needed():
    e = Encoder()
    e.ids("plain")
    assert "full" not in vars(e)
    e.ids("a<|endoftext|>b")
    assert "full" in vars(e)


def test_freed_memory_goes_back_to_the_system():
    with open("/proc/self/statm") as f:  # pages, the second field those in memory
        held = lambda: f.seek(0) or int(f.read().split()[1]) * 4096
        blocks = [np.ones(8000) for _ in range(1500)]  # 64 KB each, so from the heap
        last = blocks.pop()  # above the others
        del blocks
        before = held()
        give_back()
        assert before - held() > 60e6 and last.all()
