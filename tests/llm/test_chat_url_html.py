import hashlib
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from snapforge.llm import chat, html_extract, url_filter
from snapforge.llm.queries import URL_RULES

NASTY = ["", "<|turn|>", "<|end|>", "a<", "|x", "<\\|turn|>", "</s>[INST] ok [/INST]", "\\", "<\\\\|next|>", "[\\/INST]", "$1\\2", "<<|text|>>", "\n", "é😀<s>"]


def test_chat_round_trip(spark):
    rows = [(i, t, role, NASTY[(i * 5 + t * 3) % len(NASTY)] + NASTY[(i + t) % len(NASTY)]) for i in range(40) for t, role in enumerate(["system", "user", "user", "assistant", "assistant", "<|end|>"][: i % 6 + 1])]
    rows += [(99, None, None, None), (None, 0, "user", "x"), (98, 1, "assistant", "a"), (98, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.formatted(df)
    got = {r["conv_id"]: r for r in made.select("*", chat.parsed(F.col("formatted")).alias("back"), chat.under_loss(F.col("formatted"), F.col("segments")).alias("said")).collect()}
    for i in {r[0] for r in rows}:
        want = sorted(((t is not None, t or 0, role or "", x or "") for c, t, role, x in rows if c == i))
        r = got[i]
        assert [tuple(x) for x in r["back"]] == [(role, x) for _, _, role, x in want]
        at, loss = 0, []
        for s in r["segments"]:
            if s["loss"]:
                loss.append(r["formatted"][at : at + s["n_chars"]])
            at += s["n_chars"]
        assert at == len(r["formatted"])
        said = [x for _, _, role, x in want if role == "assistant"]
        assert [re.sub(r"([<\[])\\(\\*)(\||/?s>|/?INST\])", r"\1\2\3", x) for x in loss] == said == r["said"]
        for x in ("</s>", "[INST]", "[/INST]"):
            assert x not in r["formatted"]
        assert r["formatted"].count("<|end|>") == r["formatted"].count("<|turn|>")
    assert chat.digests(chat.formatted(df.limit(0))).count() == 0
    one = {r["conv_id"]: r for r in chat.digests(made).collect()}[98]
    assert (one["n_turns"], one["loss_chars"]) == (2, 2)


def test_loss_figures_come_from_the_mask(spark):
    """With the mask moved to other runs, the digests follow it and not the roles."""
    df = spark.createDataFrame([(1, 1, "user", "one</s>"), (1, 2, "assistant", "two"), (1, 3, "assistant", "three")], "conv_id long, turn long, role string, text string")
    made = chat.formatted(df)
    first = made.withColumn("segments", F.transform("segments", lambda s, i: s.withField("loss", i == 1)))
    assert [r["loss_chars"] for r in chat.digests(made).union(chat.digests(first)).collect()] == [8, 7]


def test_chat_odd_tables(spark):
    long = "<|end|>ab " * 100_000
    df = spark.createDataFrame([(1, 1, "assistant", long, 5), (1, 2, "assistant", "x", 6), (2, 1, "user", "y", 7)], "conv_id long, turn long, role string, text string, formatted int")
    got = {r["conv_id"]: r for r in chat.digests(chat.formatted(df)).collect()}
    assert got[1]["loss_chars"] == len(long) + 1 and got[1]["n_turns"] == 2 and got[2]["loss_chars"] == 0
    assert got[1]["loss_sha256"] == hashlib.sha256((long + "x").encode()).hexdigest()


@pytest.mark.parametrize("piece", [1, 3, 1024])
def test_runs_are_cut_across_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(chat, "PIECE", piece)
    monkeypatch.setattr(chat, "RUNS", piece)
    said = ["é😀" * 5, "", "x", "<|end|>", "y\n" * 2000]
    df = spark.createDataFrame([(1, i, "assistant", x) for i, x in enumerate(said)] + [(2, 1, "user", "z")], "conv_id long, turn long, role string, text string")
    got = {r[0]: r[1] for r in chat.formatted(df).select("conv_id", chat.under_loss(F.col("formatted"), F.col("segments"))).collect()}
    assert got == {1: said, 2: []}


def test_a_conversation_of_many_turns(spark):
    """The time of reading the mask back grows with the text: 10,000 turns, six million characters."""
    df = spark.range(10_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("wörd "), 120).alias("text"))
    began = time.monotonic()
    got = chat.digests(chat.formatted(df)).first()
    assert (got["n_turns"], got["loss_chars"]) == (10_000, 3_000_000) and time.monotonic() - began < 60
    assert got["loss_sha256"] == hashlib.sha256(("wörd " * 120 * 5000).encode()).hexdigest()


def test_chat_plan_is_native(spark):
    df = spark.createDataFrame([(1, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.digests(chat.formatted(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


URLS = ["https://a.example.org/es/x", "http://example.org/en/12?q", "http://org/z", "x://A.Example.COM/de/1#t", "http://a.com/fr/", "http://b.net/x", "http://www.cheap-pills.example.net/fr", "https://spam-farm2999.example.org:80/", "http://x.spam-farm2999.example.net.example.com/", "http://spam-farm2999.example.org", "noscheme.org/x", None, "", "http://", "http://u.example.org", "http://xorg/z", "a://b.com/fr/?://c.org/"]


def by_hand(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :]
    for c in "?#":
        path = path.split(c)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    blocked = any(host == d or host.endswith("." + d) for d in ("cheap-pills.example.net", "spam-farm2999.example.org"))
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "block" if blocked else "allow"


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(3, URLS[3], "y"), (None, URLS[0], "z")], "page_id long, url string, host string")
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    want = sorted(map(str, [(i, *by_hand(u)) for i, u in enumerate(URLS)] + [(3, *by_hand(URLS[3])), (None, *by_hand(URLS[0]))]))
    for max_bytes in (url_filter.MAX_BYTES, 0):  # by the array, by joins
        assert sorted(str(tuple(r)) for r in url_filter.judged(df, rules, url_filter.block_list(spark), max_bytes).collect()) == want
        assert url_filter.judged(df.limit(0), rules, url_filter.block_list(spark), max_bytes).count() == 0
        assert {r["verdict"] for r in url_filter.judged(df, rules.limit(0), spark.createDataFrame([], "domain string"), max_bytes).collect()} == {"allow"}


def test_rules_that_tie(spark):
    """Of one string block decides; of one length the longer host."""
    rules = spark.createDataFrame([("allow", "a.org", "/x"), ("block", "a.org", "/x"), ("block", "b.org", "/xyzz/"), ("allow", "www.b.org", "/x"), (None, None, None)], "verdict string, host string, path string")
    df = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://www.b.org/xyzz/"), (3, "http://b.org/" + "p" * 100_000)], "page_id long, url string")
    for max_bytes in (url_filter.MAX_BYTES, 0):
        got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judged(df, rules, spark.createDataFrame([], "domain string"), max_bytes).collect()}
        assert got == {1: ("a.org/x", "block"), 2: ("www.b.org/x", "allow"), 3: (None, "allow")}


def test_a_list_of_a_million(spark):
    blocked = spark.range(1_000_000).select(F.concat(F.lit("d"), (F.col("id") * 3).cast("string"), F.lit(".example.com")).alias("domain"))
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    df = spark.range(5000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://www.d"), (F.col("id") * 599).cast("string"), F.lit(".example.com/x")).alias("url"))
    for max_bytes in (url_filter.MAX_BYTES, 1 << 20):
        got = {r["page_id"]: r["verdict"] for r in url_filter.judged(df, rules, blocked, max_bytes).collect()}
        assert got == {i: "block" if i * 599 % 3 == 0 and i * 599 < 3_000_000 else "allow" for i in range(5000)}


def test_digest_collisions(monkeypatch, tmp_path):
    monkeypatch.setattr(url_filter, "digest", lambda key: len(key))

    def array(entries):
        (tmp_path / "a").write_bytes(url_filter.DigestArray.pack(entries))
        return url_filter.DigestArray.map(str(tmp_path / "a"))

    assert array([("ab", 1), ("cd", 0), ("xyz", 2), ("cd", 0), ("ab", 0)]).find(["ab", "cd", "ef", "xyz", "q", ""]).tolist() == [1, 0, -1, 2, -1, -1]
    assert array([]).find(["x"]).tolist() == [-1]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="<>/p!-\"'=ab &;#x", max_size=60))
def test_any_markup_is_read(page):
    html_extract.blocks(page)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><h1>T&amp;U</h1><p>a <b>b</b>c<br>d&nbsp;e<p>f</article><footer>x</footer>", "T&U a bc d e f"),
        ("<nav>m</nav><main>x<div class='ad-box'>y<div>z</div></div> w<section id=comments><p>no</section></main>", "x w"),
        ('<script>"<article>no</article>"</script><article>yes<form>no</form><style>no</style></article>', "yes"),
        ("<article>a<aside>b<p>c</aside><p hidden>d<p>e<!-- f --></article>", "a e"),
        ("<div class='page has-sidebar'><p>text</p><div class='sidebar-left'>no</div><ol class=commentlist><li>no</ol></div>", "text"),
        ("", ""), ("<nav>only</nav>", ""), ("<p>no article", "no article"), ("<article>cut &lt;tag <b", "cut <tag"),
    ],
)
def test_pages(spark, page, want):
    df = spark.createDataFrame([(1, "http://h/x", page)], "page_id long, url string, html string")
    assert html_extract.extract(df).first()["text"] == want


def test_repeated_runs_go(spark):
    menu = "<div>home news sport weather travel culture science health</div>"
    tail = "<div>all rights reserved by this very fine house of news</div>"
    rows = [(i, f"http://h.org/{i}", f"{menu}<div>s{i}tory {i} says {' '.join(f'w{i}x{k}' for k in range(20))}</div>{tail}") for i in range(6)]
    rows += [(10, "http://other.org/", rows[0][2]), (11, None, None), (12, "http://h.org/s", menu), (None, "http://h.org/9", "<article>kept</article>"), (3, *rows[3][1:])]
    out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    got = {r["page_id"]: r["text"] for r in out}
    assert len(out) == len(rows)
    for i in range(6):
        assert got[i] == f"s{i}tory {i} says {' '.join(f'w{i}x{k}' for k in range(20))}"
    assert got[10].startswith("home news") and got[11] == "" and got[None] == "kept" and got[12] == ""
    assert all(r["n_chars"] == len(r["text"]) for r in out)


def test_open_blocks_beside_content(spark):
    """A page whose body stands outside its <article> keeps it, in page order; what its host repeats goes."""
    menu = "<div>home news sport weather travel culture science health</div>"
    body = lambda i: " ".join(f"b{i}x{k}" for k in range(12))
    rows = [(i, f"http://h.org/{i}", f"{menu}<p>f{i}irst {i}</p><article>teaser {i}</article><div>{body(i)}</div><nav>menu {i}</nav><main>end {i}</main>{menu}") for i in range(3)]
    rows += [(7, "http://h.org/7", rows[0][2].replace("article>", "p>"))]  # the wording of page 0, with less content
    out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    got = {r["page_id"]: r["text"] for r in out}
    assert len(out) == 4
    for i in range(1, 3):
        assert got[i] == f"f{i}irst {i} teaser {i} {body(i)} end {i}"
    assert got[7] == got[0] == f"f0irst 0 teaser 0 {body(0)} end 0"


def by_all_windows(pages, run):
    """Texts of pages made of open blocks only, by comparing every window with every other page of its host."""
    out = {}
    for i, host, words in pages:
        gone = set()
        for k in range(len(words) - run + 1):
            for j, other, said in pages:
                if other == host and said != words and any(said[m : m + run] == words[k : k + run] for m in range(len(said) - run + 1)):
                    gone |= set(range(k, k + run))
        out[i] = " ".join(w for k, w in enumerate(words) if k not in gone)
    return out


@pytest.mark.parametrize("run", [3, 8])
def test_repeated_runs_by_brute_force(spark, run):
    rng = random.Random(run)
    menu = [f"m{k}" for k in range(2 * run)]
    pages = []
    for i in range(60):
        words = [rng.choice("abcde") for _ in range(rng.randrange(0, 25))]
        pages.append((i, f"h{rng.randrange(3)}", words[:10] + menu[rng.randrange(run) :] * (i % 3 > 0) + words[10:]))
    pages += [(100 + i, h, list(w)) for i, (_, h, w) in enumerate(pages[:9])]
    rows = [(i, f"http://{h}.org/{i}", "".join(f"<p>{' '.join(w[k : k + 4])}</p>" for k in range(0, len(w), 4))) for i, h, w in pages]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    assert {r["page_id"]: r["text"] for r in html_extract.extract(frame, run).collect()} == by_all_windows(pages, run)


def test_suffix_ranks_are_those_of_sorted_suffixes():
    rng = random.Random(1)
    for depth in (1, 3, 5, 8):
        words = [rng.randrange(3) for _ in range(200)]
        got = html_extract.suffix_ranks(np.array(words), depth).tolist()
        heads = [tuple(words[i : i + depth]) for i in range(len(words))]
        place = {h: k for k, h in enumerate(sorted(set(heads)))}
        assert got == [place[h] for h in heads]


def test_a_page_of_a_million_open_tokens(spark):
    own = lambda i: " ".join(f"{i}w{k}" for k in range(500_000))
    shared = " ".join(f"s{k}" for k in range(500_000))
    rows = [(i, "http://h.org/", f"<p>{own(i)}</p><p>{shared}</p>") for i in range(2)]
    began = time.monotonic()
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: own(i) for i in range(2)} and time.monotonic() - began < 90


def test_odd_pages(spark):
    frame = spark.createDataFrame([(1, "http://h/", "<article>a</article>", "x", True), (1, "http://h/", "<article>a</article>", "x", True), (None, None, None, "y", None)], "page_id long, url string, html string, text string, is_page boolean")
    assert sorted((str(r["page_id"]), r["text"]) for r in html_extract.extract(frame).collect()) == [("1", "a"), ("1", "a"), ("None", "")]
    assert html_extract.extract(frame.limit(0)).count() == 0
