"""URL filters by a sorted digest array.

Rules (host, path) fit a host and its subdomains where the path starts with the rule's; the longest
that fits decides. Domains of a block list decide the rest. Both lists are tables. Up to MAX_BYTES they become
one array, ascending by 64-bit xxhash, in one file that every executor fetches once and all its Python
workers map into memory. A batch of URLs is probed at once: all their host suffixes and path prefixes
of lengths that rules have, by vectorised binary search; a hit counts only if the stored string is
the probed one, so digests that collide do no harm. Larger lists are joined with the same candidates.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapforge.llm.common import dealt_join, shipped

#: Fixed values, for want of a public list: names of domains that are blocked unless a rule says otherwise, and the domains above them.
BLOCKED_NAMES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BLOCKED_TOPS = ("com", "net", "org")
#: Each name is blocked as it is and followed by a number from 1 up to under this.
BLOCKED_NUMBERS = 3000

#: The largest array that is shipped to executors; larger lists are joined instead.
MAX_BYTES = 256 << 20
BLOCK, ALLOW, LISTED = 1, 0, 2


def block_list(spark: SparkSession) -> DataFrame:
    """(domain): the fixed names, numbered, under each of the fixed tops."""
    of = lambda values: F.explode(F.array(*map(F.lit, values)))
    numbers = spark.range(BLOCKED_NUMBERS).select(F.when(F.col("id") > 0, F.col("id").cast("string")).otherwise("").alias("i"))
    return numbers.select("i", of(BLOCKED_NAMES).alias("n")).select("i", "n", of(BLOCKED_TOPS).alias("t")).select(F.concat("n", "i", F.lit(".example."), "t").alias("domain"))


def digest(key: str) -> int:
    return xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"))


class DigestArray:
    """digests ascending, where each one's string ends in the heap, and its flag; in one file."""

    def __init__(self, data: np.ndarray):
        self.n = int(data[:8].view("<u8")[0])
        at = 8
        self.digests = data[at : at + 8 * self.n].view("<u8")
        at += 8 * self.n
        self.ends = data[at : at + 8 * self.n].view("<u8")
        at += 8 * self.n
        self.flags = data[at : at + self.n]
        self.heap = data[at + self.n :]

    @staticmethod
    def pack(entries: Iterable[tuple[str, int]]) -> bytes:
        """The file's bytes for (string, flag) entries; of entries with one string the greatest flag counts."""
        best: dict[str, int] = {}
        for key, flag in entries:
            best[key] = max(flag, best.get(key, 0))
        keys = [k.encode("utf-8", "surrogatepass") for k in best]
        digests = np.fromiter(map(digest, best), "<u8", len(best))
        order = np.argsort(digests, kind="stable")
        sizes = np.fromiter(map(len, keys), "<u8", len(keys))[order]
        flags = np.fromiter(best.values(), np.uint8, len(best))[order]
        return b"".join([np.array([len(keys)], "<u8").tobytes(), digests[order].tobytes(), np.cumsum(sizes, dtype="<u8").tobytes(), flags.tobytes(), *(keys[i] for i in order)])

    @classmethod
    def map(cls, path: str) -> DigestArray:
        return cls(np.memmap(path, np.uint8, "r"))

    def find(self, keys: list[str]) -> np.ndarray:
        """The flag of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        if not self.n or not keys:
            return out
        probes = np.fromiter(map(digest, keys), np.uint64, len(keys))
        first = np.searchsorted(self.digests, probes)
        hits = np.flatnonzero(self.digests[np.minimum(first, self.n - 1)] == probes)
        for i in hits:
            at, own = int(first[i]), keys[i].encode("utf-8", "surrogatepass")
            while at < self.n and self.digests[at] == probes[i]:  # all strings of one digest
                begin = int(self.ends[at - 1]) if at else 0
                if self.heap[begin : int(self.ends[at])].tobytes() == own:
                    out[i] = self.flags[at]
                    break
                at += 1
        return out


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; without ://, empty."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """From the host's end up to ?, # or the end; without ://, empty."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def candidates(host: str, path: str, lengths: list[int]) -> list[tuple[int, str]]:
    """(length, string) of the rules that could fit, by host suffixes at dots and by path prefixes."""
    labels = host.split(".")
    suffixes = [".".join(labels[i:]) for i in range(len(labels))] if host else []
    return [(len(s) + n, s + path[:n]) for s in suffixes for n in lengths if n <= len(path)]


def entries(rules: DataFrame, blocked: DataFrame) -> DataFrame:
    """(key, flag): rules as r: and their string, domains of the list as b: and theirs."""
    own = rules.select(F.concat(F.lit("r:"), "host", "path").alias("key"), F.when(F.col("verdict") == "block", BLOCK).otherwise(ALLOW).alias("flag"))
    return own.unionAll(blocked.select(F.concat(F.lit("b:"), "domain"), F.lit(LISTED))).where("key IS NOT NULL")


def judge(host_column: Column, path_column: Column, file: str, lengths: list[int]) -> Column:
    """struct(rule, verdict) for a host and a path, by the shipped array and the lengths that rules' paths have: see judged()."""
    held: dict = {}

    @F.arrow_udf("struct<rule:string,verdict:string>")
    def _judge(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        if "array" not in held:
            held["array"] = DigestArray.map(SparkFiles.get(file))
        array = held["array"]
        keys, of = [], []
        for i, (h, p) in enumerate(zip(hosts.to_pylist(), paths.to_pylist(), strict=True)):
            for _, key in candidates(h or "", p or "", lengths):
                keys.append("r:" + key)
                of.append(i)
            for _, key in candidates(h or "", "", [0]):
                keys.append("b:" + key)
                of.append(i)
        best: list[str | None] = [None] * len(hosts)
        flags = [0] * len(hosts)
        listed = [False] * len(hosts)
        found = array.find(keys)
        for j in np.flatnonzero(found >= 0):
            i, key = of[j], keys[j][2:]
            if keys[j][0] == "b":
                listed[i] = True
            elif best[i] is None or len(key) > len(best[i]):  # longer hosts come first
                best[i], flags[i] = key, int(found[j])
        verdicts = ["block" if (flags[i] if best[i] is not None else listed[i]) else "allow" for i in range(len(hosts))]
        return pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(verdicts, pa.string())], names=["rule", "verdict"])

    return _judge(host_column, path_column)


def judge_by_join(urls: DataFrame, rules: DataFrame, blocked: DataFrame, lengths: list[int]) -> DataFrame:
    """The same for lists of any size: distinct urls (host, path) with rule and verdict.

    Candidate strings are joined with the lists, and each URL's longest hit is kept.
    """
    own = urls.select("host", "path").distinct().withColumn("_id", F.sha2(F.concat_ws("\u0001", "host", "path"), 256))
    labels = F.split("host", r"\.", -1)
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    parts = own.where("host <> ''").select("*", suffix.alias("_s"))
    prefixes = F.explode(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths] or [F.lit(None).cast("string")])).alias("_p")
    probes = parts.select("_id", "_s", prefixes).where("_p IS NOT NULL").withColumn("key", F.concat(F.lit("r:"), "_s", "_p"))
    lists = entries(rules, blocked).groupBy("key").agg(F.max("flag").alias("flag"))
    hits = dealt_join(probes, lists, ["key"], ["_id"])
    best = hits.groupBy("_id").agg(F.max_by(F.struct(F.substring("key", 3, 1 << 30).alias("key"), "flag"), F.struct(F.length("key"), F.length("_s"))).alias("_best"))
    listed = dealt_join(parts.select("_id", F.concat(F.lit("b:"), "_s").alias("key")), lists, ["key"], ["_id"]).select("_id").distinct().withColumn("_listed", F.lit(True))
    rows = own.join(best, "_id", "left").join(listed, "_id", "left")
    verdict = F.when(F.col("_best").isNotNull(), F.when(F.col("_best.flag") == BLOCK, "block").otherwise("allow")).when(F.col("_listed"), "block").otherwise("allow")
    return rows.select("host", "path", F.col("_best.key").alias("rule"), verdict.alias("verdict"))


def judged(pages: DataFrame, rules: DataFrame, blocked: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """page_id, host, path, rule and verdict for every page. rules: (verdict, host, path), verdict allow or block; blocked: (domain).

    Without a fitting rule, rule is null and the verdict is block for domains of the list and their
    subdomains, else allow. Of two fitting rules of one length the one with the longer host decides, of
    two with one string block does. Empty hosts fit nothing. Null url: empty host and path, no rule,
    allow. Very long urls are judged whole. Repeated rows and null ids have a row each. Columns other than
    page_id and url are left out. Empty table: empty result; empty lists: all are allowed. Lists of up to
    max_bytes are shipped as an array, larger ones joined, with the same result.
    """
    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    lengths = sorted(r[0] for r in rules.where("host IS NOT NULL AND path IS NOT NULL").select(F.length("path")).distinct().collect())  # as many as there are path lengths
    lists = entries(rules, blocked)
    n, size = lists.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("key")), F.lit(0))).first()
    if 8 + 17 * n + size <= max_bytes:
        found = lists.toArrow()
        file = shipped(pages.sparkSession, "digests", DigestArray.pack(zip(found["key"].to_pylist(), found["flag"].to_pylist(), strict=True)))
        return rows.withColumn("_j", judge(F.col("host"), F.col("path"), file, lengths)).select("page_id", "host", "path", "_j.rule", "_j.verdict")
    known = judge_by_join(rows, rules, blocked, lengths)
    return dealt_join(rows, known, ["host", "path"], ["page_id"]).select("page_id", "host", "path", "rule", "verdict")
