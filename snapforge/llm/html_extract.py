"""Main text of HTML pages: markup regions, and a suffix array over each host's pages for what markup leaves open.

A page is parsed once, in order, into blocks. A block inside <article> or <main> is content, one inside
chrome - navigation, headers, footers, asides, forms, and elements whose class or id says advert,
notice, comments and the like - is not, and everything else is open. Open blocks are settled by their
host: over the token streams of all its pages outside content, tokens covered by a run of RUN tokens
or more that also stands in a page of another wording are boilerplate, and the unique runs stay, in
page order with the content.

The suffix array of a host's concatenated streams is built in parts. Each batch of pages sorts the
suffixes of its streams by prefix doubling, which compares tokens and stops at a depth of RUN: suffixes
that agree so far are neighbours, in one bucket. Buckets of all batches are merged by host and a 128-bit
digest of their tokens, pre-aggregated: all that is asked of a bucket is whether two pages of different
wording meet in it, which a least and a greatest page digest tell. So no host, template or page is
gathered in one task. Runs never reach over the end of a page. What repeats of RUN tokens or more cover is
the union of what repeats of RUN tokens cover.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapforge.llm.common import dealt_join, plain, written

#: Tokens that a repeated run has at least.
RUN = 8

OPEN, CONTENT, CHROME = 0, 1, 2
PARTS = pa.list_(pa.struct([("at", pa.int32()), ("text", pa.string())]))

#: Elements and words of class or id that make a region chrome.
CHROME_TAGS = frozenset("nav header footer aside form menu dialog button select datalist fieldset iframe object svg math canvas audio video map".split())
CHROME_WORDS = frozenset("ad ads adbanner adbox adsbygoogle adslot adunit advert adverts advertisement advertising alert alerts announcement aside banner breadcrumb breadcrumbs colophon comment commentlist comments consent cookie cookies copyright disclaimer discussion disqus footer gdpr header legal login masthead menu menubar modal nav navbar navigation navlinks newsletter notice notices pager pagination paywall popup privacy promo promoted promotion rail related replies reply respond responses search share sharing sidebar sidenav signup social sponsor sponsored subnav submenu subscribe toast toolbar topbar topnav widget widgets".split())
#: First words of names that say what a page has or lacks, such as has-sidebar.
ABOUT = frozenset("has have is no non not show with without".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
CONTENT_TAGS = frozenset(("article", "main"))
#: Elements whose content is never text of the page.
RAW_TAGS = ("script", "style", "template", "noscript", "textarea", "title", "head")
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK_TAGS = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
#: A start of one of these ends an open one of the same kind.
CLOSES_ITSELF = frozenset("p li dd dt option tr td th".split())

MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(?P<raw>script|style|template|noscript|textarea|title)(?=[\s/>])[^>]*>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>[^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
WORD_PART = re.compile(r"[a-z]+")


def region(tag: str, attributes: str) -> int | None:
    """What a start tag makes of what it holds: CONTENT, CHROME, or None for no change."""
    if tag in CHROME_TAGS:
        return CHROME
    found = None
    for name, *values in ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), next(filter(None, values), "").lower()
        if name == "role":
            if set(value.split()) & CHROME_ROLES:
                return CHROME
            if set(value.split()) & {"main", "article"}:
                found = CONTENT
        elif name == "hidden":
            return CHROME
        elif tag not in CONTENT_TAGS and tag not in ("html", "body"):
            for parts in map(WORD_PART.findall, value.split()):
                if parts and parts[0] not in ABOUT and parts[-1] != "free" and CHROME_WORDS & set(parts):
                    return CHROME
    return CONTENT if tag in CONTENT_TAGS else found


def blocks(page: str) -> list[tuple[int, str]]:
    """(region, text) of the blocks that have text, in page order: references decoded, white space one space."""
    out: list[tuple[int, str]] = []
    text: list[str] = []
    held: list[list] = []  # [tag, open elements of that tag, region] of those that set a region
    now = OPEN

    def flush() -> None:
        words = html.unescape("".join(text)).split() if text else ()
        text.clear()
        if words:
            out.append((now, " ".join(words)))

    def end(tag: str) -> None:
        nonlocal now
        for k in range(len(held) - 1, -1, -1):
            if held[k][0] == tag:
                held[k][1] -= 1
                if not held[k][1]:
                    flush()
                    del held[k:]
                    now = held[-1][2] if held else OPEN
                return

    at = 0
    for m in MARKUP.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        closing, rest = m["close"] or m["close2"], m["rest"] if m["tag"] else m["rest2"]
        if tag in BLOCK_TAGS:
            flush()
        if closing:
            end(tag)
            continue
        if tag in VOID_TAGS:
            continue
        if held and tag in CLOSES_ITSELF and held[-1][0] == tag:
            end(tag)
        new = region(tag, rest)
        if new is not None and now != CHROME and new != now:
            flush()
            held.append([tag, 1, new])
            now = new
        elif held:
            for x in reversed(held):
                if x[0] == tag:
                    x[1] += 1
                    break
    if at < len(page):
        text.append(page[at:])
    flush()
    return out


def suffix_ranks(tokens: np.ndarray, depth: int) -> np.ndarray:
    """The place of each suffix in the array of all of them, sorted by their first `depth` tokens; suffixes that agree so far share one. By prefix doubling."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    known = 1
    while known < depth:
        step = min(known, depth - known)
        after = np.zeros_like(rank)  # 0: the end
        after[: max(0, len(rank) - step)] = rank[step:] + 1
        rank = np.unique(rank * (len(rank) + 1) + after, return_inverse=True)[1].astype(np.int64)
        known += step
    return rank


def digests(words: list[str]) -> np.ndarray:
    """(words, 2): 128 bits of each."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in words), "<u8").reshape(-1, 2)


def run_digests(tokens: np.ndarray, run: int) -> np.ndarray:
    """(tokens, 2): 128 bits of the run from each token on, given those of the tokens; wrong where less than a run is left."""
    out = np.zeros_like(tokens)
    for j in range(min(run, len(tokens))):
        out[: len(tokens) - j] = (out[: len(tokens) - j] ^ tokens[j:]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def candidates(found: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """(at, text) of what may stay of a page, in its order: content at -1, and open blocks at their first token's place among the tokens outside content."""
    out, at = [], 0
    for kind, text in found:
        if kind != CHROME:
            out.append((-1 if kind == CONTENT else at, text))
        at += (kind != CONTENT) * (text.count(" ") + 1)
    return out


def uncovered(parts: list[tuple[int, str]], covered: np.ndarray, run: int) -> str:
    """The text that remains: content, and open tokens that no run from a position of `covered` reaches over."""
    edge = np.zeros(int(covered.max()) + run + 1 if len(covered) else 1, np.int64)
    np.add.at(edge, covered, 1)
    np.add.at(edge, covered + run, -1)
    gone = np.cumsum(edge) > 0
    out = []
    for at, text in parts:
        if at < 0 or not gone[at : at + text.count(" ") + 1].any():
            out.append(text)
        else:
            words = text.split(" ")
            hit = np.zeros(len(words), bool)
            hit[: max(0, len(gone) - at)] = gone[at : at + len(words)]
            out += [w for w, x in zip(words, hit.tolist(), strict=True) if not x]
    return " ".join(out)


def parsed(pages: DataFrame, run: int = RUN) -> DataFrame:
    """Rows of pages, and rows of buckets of their hosts' suffix arrays.

    A page: page_id, url, host, form (a digest of what it says, and where), and if markup settles it text, else
    parts and the digests d1 and d2 of the run from each token outside content on. A bucket: host, its digest
    in r1 and r2, and the least and the greatest wording, a page digest, that has it.
    """
    kind = pages.schema["page_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = plain(batch, "url").to_pylist()
            host, wording, form, text, parts, sizes, words = [], [], [], [], [], [], []
            of: dict[str, int] = {}
            for i, page in enumerate(plain(batch, "html")):
                found = blocks(page.as_py() or "")
                host.append(re.split("[/?#]", (urls[i] or "").partition("://")[2], maxsplit=1)[0].lower())
                wording.append(xxhash.xxh3_64_intdigest("\n".join(t for _, t in found)) - (1 << 63))
                form.append(xxhash.xxh3_64_intdigest("\n".join(f"{k == CONTENT:d}{t}" for k, t in found)) - (1 << 63))
                is_open = any(k == OPEN for k, _ in found)
                text.append(None if is_open else " ".join(t for k, t in found if k == CONTENT))
                parts.append(candidates(found) if is_open else None)
                own = [of.setdefault(w, len(of)) for k, t in found if k != CONTENT for w in t.split(" ")]
                sizes.append(len(own))
                words += own
            tokens, size = np.array(words, np.int64), np.array(sizes, np.int64)
            ends = np.cumsum(size)
            full = run_digests(digests(list(of))[tokens], run).view(np.int64) if len(tokens) else np.zeros((0, 2), np.int64)
            whole = [slice(e - n, max(e - n, e - run + 1)) if x is not None else None for e, n, x in zip(ends.tolist(), sizes, parts, strict=True)]
            lists = [pa.array([None if w is None else full[w, k] for w in whole], pa.list_(pa.int64())) for k in (0, 1)]
            n = batch.num_rows
            pages_of = [plain(batch, "page_id"), plain(batch, "url"), pa.array(host, pa.string()), pa.array(form, pa.int64()), pa.array(text, pa.string()), pa.array(parts, PARTS), *lists]
            yield pa.RecordBatch.from_arrays([pa.array([True] * n, pa.bool_()), *pages_of, *[pa.nulls(n, pa.int64())] * 4], names=NAMES)
            # buckets: suffixes of whole runs, by host and by their place in the array
            page = np.repeat(np.arange(n), size)
            at = np.flatnonzero(np.arange(len(tokens)) + run <= ends[page]) if len(tokens) else np.zeros(0, np.int64)
            if not len(at):
                continue
            hosts, host_of = np.unique(np.array(host, object), return_inverse=True)
            rank = suffix_ranks(tokens, run)
            bucket = host_of[page[at]] * (len(tokens) + 1) + rank[at]
            order = np.argsort(bucket, kind="stable")
            first = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            says = np.array(wording, np.int64)[page[at[order]]]
            one = at[order[first]]
            columns = [pa.array(full[one, 0]), pa.array(full[one, 1]), pa.array(np.minimum.reduceat(says, first)), pa.array(np.maximum.reduceat(says, first))]
            own_host = pa.array(hosts.tolist(), pa.string()).take(pa.array(host_of[page[one]]))
            m = len(one)
            yield pa.RecordBatch.from_arrays([pa.array([False] * m, pa.bool_()), pa.nulls(m, plain(batch, "page_id").type), pa.nulls(m, pa.string()), own_host, pa.nulls(m, pa.int64()), pa.nulls(m, pa.string()), pa.nulls(m, PARTS), *[pa.nulls(m, pa.list_(pa.int64()))] * 2, *columns], names=NAMES)

    types = f"boolean, {kind}, string, string, bigint, string, array<struct<at:int,text:string>>, array<bigint>, array<bigint>, bigint, bigint, bigint, bigint".split(", ")
    return pages.select("page_id", "url", "html").mapInArrow(read, ", ".join(f"{n} {t}" for n, t in zip(NAMES, types, strict=True)))


NAMES = ["is_page", "page_id", "url", "host", "form", "text", "parts", "d1", "d2", "r1", "r2", "least", "greatest"]


def extract(pages: DataFrame, run: int = RUN) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Null html is empty, and empty pages have the empty text. Pages keep their content and those
    open tokens that no repeated run covers; on a host whose pages all say the same, nothing repeats
    in another wording and all of it stays. Repeated rows, null ids and null urls stay; pages without a
    host are one host. Very long pages are read whole. Columns other than page_id, url and html are left
    out, whatever their names. Empty table: empty result.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    table = written(parsed(pages, run), "html")
    settled, unsettled = table.where("is_page AND parts IS NULL"), table.where("is_page AND parts IS NOT NULL").select("page_id", "url", "host", "form", "parts", "d1", "d2")
    buckets = table.where("NOT is_page").groupBy("host", "r1", "r2").agg(F.min("least").alias("a"), F.max("greatest").alias("b"))
    repeated = buckets.where("a <> b").select("host", "r1", "r2")
    asked = unsettled.select("host", "form", F.posexplode(F.arrays_zip("d1", "d2")).alias("at", "d")).select("host", "form", "at", F.col("d.d1").alias("r1"), F.col("d.d2").alias("r2")).distinct()
    covered = dealt_join(asked, repeated, ["host", "r1", "r2"], ["form"]).groupBy("host", "form").agg(F.collect_set("at").alias("covered"))
    left = dealt_join(unsettled.drop("d1", "d2"), covered, ["host", "form"], ["page_id", "url"], "left")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = []
            for parts, places in zip(batch.column("parts"), batch.column("covered"), strict=True):
                held = places.values.to_numpy(zero_copy_only=False) if places.is_valid else ()
                text.append(uncovered([(x["at"], x["text"]) for x in parts.as_py()], np.asarray(held, np.int64), run))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    remains = left.select("page_id", "url", "parts", "covered").mapInArrow(rest, f"page_id {kind}, url string, text string")
    return settled.select("page_id", "url", "text").unionByName(remains).withColumn("n_chars", F.length("text").cast("long"))
