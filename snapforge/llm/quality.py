"""Quality rules as a bitmask ledger.

Every rule is evaluated once: a document gets its measurements and one long whose bit i says that rule
i failed. A policy is a set of rules, so a mask; verdicts, changes of policy and ablations are bitwise
operations and one aggregation over the ledger. Texts are not read again.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapforge.llm.common import give_back, texts

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
WINDOW = 8

#: Measurements of a text, in order. All are counts.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stutters", "n_upper", "n_letters", "n_exclamations")

#: Rules, in the order of their bits: never reorder, only append. A rule holds where a document fails.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 30 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("stutter", "100 * n_stutters > 40 * n_words"),
    ("capitals", "n_letters >= 40 AND 100 * n_upper > 60 * n_letters"),
    ("exclamations", "100 * n_exclamations > 50 * n_words"),
    ("short_words", "n_words > 0 AND 10 * word_chars < 15 * n_words"),
    ("long_words", "word_chars > 40 * n_words"),
)
BIT = {name: i for i, (name, _) in enumerate(RULES)}

#: Policies by version: the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": tuple(BIT),
}


def mask(policy: str | tuple[str, ...]) -> int:
    return sum(1 << BIT[rule] for rule in (POLICIES[policy] if isinstance(policy, str) else policy))


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of so many words that the text has twice or more, the first one included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    first: dict[bytes, int] = {}
    ids = np.fromiter(map(first.setdefault, words, range(len(words))), np.int64, len(words))  # a word's first place
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    key = np.zeros(n, np.uint64)
    for j in range(window):
        key = key * np.uint64(0xBF58476D1CE4E5B9) + mixed[j : j + n]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    a, b = order[:-1][same], order[1:][same]
    span = np.arange(window)
    twice = np.zeros(n, bool)
    if (ids[a[:, None] + span] == ids[b[:, None] + span]).all():
        twice[a] = twice[b] = True
    else:  # two windows share a key by chance
        found = [tuple(ids[i : i + window]) for i in range(n)]
        times = Counter(found)
        twice[:] = [times[x] > 1 for x in found]
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[window : window + n] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    """The MEASURES of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    gone = lambda some: len(raw) - len(raw.translate(None, some))
    upper = gone(UPPER)
    return (
        len(words), len(text) - (len(raw) - sum(map(len, words))), gone(SYMBOLS), len(lines) - len(set(lines)), repeat_words(words),
        len(lines), sum(map(bytes.__eq__, words[1:], words)), upper, upper + gone(LOWER), raw.count(b"!"),
    )


def measured(text: Column) -> Column:
    @F.arrow_udf("struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">")
    def _measure(column: pa.Array) -> pa.Array:
        rows = np.array(list(map(measure, texts(column))), np.int64).reshape(-1, len(MEASURES))
        give_back()
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x)) for x in rows.T], names=list(MEASURES))

    return _measure(text)


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """`keep`, the measurements and `failures`, the bits of all rules that a document fails.

    Null and empty texts measure 0 and fail few_words; very long ones are measured whole. Repeated rows
    and null ids stay rows of their own. Empty table: empty result. Columns of docs outside `keep` are left out; a kept column that is named like a measurement
    is an error, as its value would be lost.
    """
    if clash := set(keep) & {*MEASURES, "failures"}:
        raise ValueError(f"columns named like measurements: {sorted(clash)}")
    rows = docs.select(*keep, measured(F.col(text)).alias("_m")).select(*keep, "_m.*")
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, rule) in enumerate(RULES)]
    return rows.withColumn("failures", sum(bits[1:], bits[0]))


def passes(failures: Column, policy: str | tuple[str, ...]) -> Column:
    return failures.bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def judged(docs: DataFrame, policy: str = "v1", keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ledger with base_failed and kept: false if the base rules fail, else the policy's verdict."""
    return ledger(docs, keep, text).withColumn("base_failed", ~passes(F.col("failures"), "base")).withColumn("kept", passes(F.col("failures"), "base") & passes(F.col("failures"), policy))


def ablation(ledger_rows: DataFrame, policy: str | tuple[str, ...] = "v1") -> DataFrame:
    """(rule, n_failed, n_failed_alone): how many documents each rule of a policy rejects, and how many only it does.

    One aggregation of the bit patterns, of which there are at most 2 ** len(RULES).
    """
    names = POLICIES[policy] if isinstance(policy, str) else policy
    hit = F.col("failures").bitwiseAND(F.lit(mask(policy)).cast("long"))
    patterns = ledger_rows.groupBy(hit.alias("hit")).agg(F.count("*").alias("n"))
    bit = F.col("bit")
    has = F.col("hit").bitwiseAND(bit) != 0
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << BIT[r]).cast("long").alias("bit")) for r in names]))
    rows = patterns.select("hit", "n", rules.alias("r")).select("hit", "n", "r.rule", "r.bit")
    return rows.groupBy("rule").agg(F.sum(F.when(has, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(F.col("hit") == bit, F.col("n")).otherwise(0)).alias("n_failed_alone"))


def kept_documents(docs: DataFrame, policy: str = "v1", text: str = "text") -> DataFrame:
    """The rows whose failure bits pass the base rules and the policy, columns as they came, whatever their names.

    Null, empty and wordless texts fail few_words, so they go. Repeated rows stay or go together; rows
    with null ids are judged by their text. Very long texts are measured whole. Empty table: empty result.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    found = ledger(rows, tuple(names), names[docs.columns.index(text)])
    return found.where(passes(F.col("failures"), "base") & passes(F.col("failures"), policy)).select(*names).toDF(*docs.columns)
