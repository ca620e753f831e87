"""Packing token sequences by patterns fitted with non-negative least squares.

Documents become pieces of at most LIMIT tokens. Only the histogram of piece lengths goes to the
driver: LIMIT numbers at most, whatever the input. There
- lengths are rounded up to units, and all ways to fill a sequence exactly with up to three units
  are the patterns;
- non-negative least squares fits repeat counts of patterns to the histogram, and they are rounded down;
- what is left is packed by best fit, decreasing, again over counts by length: first into the gaps
  that rounding up left, then into new sequences.
The result is a plan of some thousand rows: pieces of one length and ranks a to b go to sequences
base to base + b - a, at one offset. A piece finds its place by its length and its rank in it.
Ranks come from counts by (length, bucket), so a length that a third of all pieces share is split.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapforge.llm.common import checkpointed, give_back, parts, plain
from snapforge.llm.tokens import VOCABULARY, encoder

LIMIT = 2048
UNIT = 4
#: Buckets that pieces of one length are ranked in.
BUCKETS = 256


def cut(n: int, limit: int = LIMIT) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all of `limit`, but for the first, which takes the remainder."""
    first = n % limit or min(n, limit)
    return [(0, first), *((s, limit) for s in range(first, n, limit))] if n else []


def encoded(batches: Iterator[pa.RecordBatch], limit: int = LIMIT, vocabulary: str = VOCABULARY, end_id: int = 0, with_ids: bool = False) -> Iterator[pa.RecordBatch]:
    """The rows of pieces() for batches of doc_id and text, the ids of a part of a batch in memory at a time."""
    encode = encoder(vocabulary).ids
    for whole in batches:
        for batch in parts(whole):
            of, rows, ids_out = [], [], []
            for i, text in enumerate(plain(batch, "text")):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), limit)):
                    part = ids[start : start + length]
                    of.append(i)
                    rows.append((k, start, length, zlib.crc32(part.tobytes())))
                    if with_ids:
                        ids_out.append(part.astype(np.int32))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            arrays = [plain(batch, "doc_id").take(pa.array(of, pa.int64())), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(ids_out, pa.list_(pa.int32()))] * with_ids, names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)
        give_back()


def pieces(docs: DataFrame, limit: int = LIMIT, vocabulary: str = VOCABULARY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids. A null text is empty: one piece, the end id alone."""
    kind = docs.schema["doc_id"].dataType
    fields = "piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return encoded(batches, limit, vocabulary, end_id, with_ids)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, {fields}")


def patterns(full: int, present: np.ndarray) -> np.ndarray:
    """All (a, b, c), a >= b >= c >= 0 and a + b + c = full, of units that are present. 0: no document."""
    a, b = (x.ravel() for x in np.meshgrid(np.arange(full + 1), np.arange(full + 1), indexing="ij"))
    c = full - a - b
    ok = (a >= b) & (b >= c) & (c >= 0)
    found = np.stack([a[ok], b[ok], c[ok]], axis=1)
    has = present.copy()
    has[0] = True
    return found[has[found].all(axis=1)]


def fit(found: np.ndarray, counts: np.ndarray, rounds: int = 2000, at_once: int = 32, tolerance: float = 1e-3) -> np.ndarray:
    """Repeat counts x >= 0 of patterns that bring the units used nearest to counts, by least squares.

    The active-set method: patterns with the steepest descent enter the set, up to at_once of them with
    no unit in common; those that a solution makes negative leave it. It ends when no slope is above
    `tolerance` times the largest count.
    """
    m, h = len(counts), counts.astype(float)
    h[0] = 0
    columns = np.zeros((m, 0))
    held, x = np.zeros(0, np.int64), np.zeros(0)
    least = tolerance * max(1.0, h.max())

    def dense(js: np.ndarray) -> np.ndarray:
        out = np.zeros((m, len(js)))
        for k in range(3):
            np.add.at(out, (found[js, k], np.arange(len(js))), 1.0)
        out[0] = 0
        return out

    for _ in range(rounds):
        rest = h - columns @ x
        slope = rest[found[:, 0]] + rest[found[:, 1]] + rest[found[:, 2]]
        slope[held] = -np.inf
        best, taken = [], set()
        for j in np.argsort(-slope)[: 16 * at_once]:
            units = {int(u) for u in found[j] if u}
            if slope[j] > least and not units & taken:
                best.append(int(j))
                taken |= units
            if len(best) == min(at_once, m - len(held)):
                break
        if not best:
            break
        held, x, columns = np.append(held, best), np.append(x, np.zeros(len(best))), np.hstack([columns, dense(np.array(best))])
        while len(held):
            gram = columns.T @ columns
            gram[np.diag_indices_from(gram)] += 1e-9
            s = np.linalg.solve(gram, columns.T @ h)
            low = s <= 1e-9
            if not low.any():
                x = s
                break
            step = min(1.0, (x[low] / np.maximum(x[low] - s[low], 1e-300)).min())
            x = np.maximum(x + step * (s - x), 0.0)
            stay = ~(low & (x <= 1e-9))
            held, x, columns = held[stay], x[stay], columns[:, stay]
    out = np.zeros(len(found))
    out[held] = x
    return out


def best_fit(rest: dict[int, int], bins: list[list], limit: int) -> None:
    """Put counts by length into bins, classes [count, lengths], longest first, each where it leaves the least gap. Changes both."""
    gaps: dict[int, list[int]] = defaultdict(list)
    for i, (_, items) in enumerate(bins):
        gaps[limit - sum(items)].append(i)
    open_gaps = np.zeros(limit + 1, bool)
    for g, at in gaps.items():
        open_gaps[g] = bool(at)
    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            fits = np.flatnonzero(open_gaps[length:])
            if not len(fits):
                each = limit // length
                for k, c in ((each, n // each), (n % each, 1)):
                    if k and c:
                        bins.append([c, [length] * k])
                        gaps[limit - k * length].append(len(bins) - 1)
                        open_gaps[limit - k * length] = True
                break
            gap = length + int(fits[0])
            i = gaps[gap].pop()
            open_gaps[gap] = bool(gaps[gap])
            count, items = bins[i]
            k = min(count, n)
            if k < count:
                bins.append([count - k, list(items)])
                gaps[gap].append(len(bins) - 1)
                open_gaps[gap] = True
            bins[i] = [k, [*items, length]]
            gaps[gap - length].append(i)
            open_gaps[gap - length] = True
            n -= k
    rest.clear()


def plan(histogram: dict[int, int], limit: int = LIMIT, unit: int = UNIT) -> list[list]:
    """Bin classes [count, lengths in order] that hold every piece of {length: count}."""
    rest = {int(k): int(v) for k, v in histogram.items() if v}
    bins: list[list] = []
    if limit in rest:
        bins.append([rest.pop(limit), [limit]])
    full = limit // unit
    counts = np.zeros(full + 1, np.int64)
    for length, n in rest.items():
        counts[-(-length // unit)] += n
    if counts.any():
        found = patterns(full, counts > 0)
        times = np.floor(fit(found, counts) + 1e-6).astype(np.int64)
        queue: dict[int, list[list[int]]] = defaultdict(list)  # by unit: [length, how many are left], shortest last
        for length in sorted(rest, reverse=True):
            queue[-(-length // unit)].append([length, rest[length]])
        for j in np.flatnonzero(times):
            units = [int(u) for u in found[j] if u]
            want = int(times[j])
            while want and all(queue[u] for u in units):
                run, lengths, need = want, [], defaultdict(int)
                for u in units:
                    need[u] += 1
                for u, k in need.items():
                    length, left = queue[u][-1]
                    if left < k:  # the last few of a length: best fit takes them
                        run = 0
                        queue[u].pop()
                        break
                    run = min(run, left // k)
                    lengths += [length] * k
                if not run:
                    continue
                for u, k in need.items():
                    queue[u][-1][1] -= run * k
                    rest[queue[u][-1][0]] -= run * k
                    if not queue[u][-1][1]:
                        queue[u].pop()
                bins.append([run, lengths])
                want -= run
    best_fit({k: v for k, v in rest.items() if v}, bins, limit)
    return bins


def places(bins: list[list]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """keys, sequences, offsets: rank r of a length is in the last row whose key, length * 2**40 + first rank, is not above its own."""
    rank: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for count, lengths in bins:
        at = 0
        for length in lengths:
            rows.append(((length << 40) + rank[length], base, at))
            rank[length] += count
            at += length
        base += count
    keys, seqs, offsets = (np.array(c, np.int64) for c in zip(*sorted(rows), strict=True)) if rows else [np.zeros(0, np.int64)] * 3
    return keys, seqs, offsets


def pack(docs: DataFrame, limit: int = LIMIT, vocabulary: str = VOCABULARY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids: a row for each piece.

    Sequences hold at most `limit` tokens, without gaps. Rows that repeat a doc_id are documents of
    their own. Null doc_id: kept. Empty table: empty result. Columns other than doc_id and text are left out.
    """
    cuts = checkpointed(pieces(docs, limit, vocabulary, end_id, with_ids))  # texts are encoded once
    cuts = cuts.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(BUCKETS)).cast("int"))
    counts = checkpointed(cuts.groupBy("length", "_b").agg(F.count("*").alias("n")))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `limit` rows
    keys, seqs, offsets = places(plan(histogram, limit))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col("length").alias("_l"), F.col("_b").alias("_fb"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    rows = cuts.join(first, (F.col("length") == F.col("_l")) & (F.col("_b") == F.col("_fb")))
    order = Window.partitionBy("length", "_b").orderBy(F.col("doc_id").asc_nulls_last(), "piece", "ids_crc32")
    rows = rows.withColumn("_rank", F.col("_first") + F.row_number().over(order) - 1)

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        own = (length.to_numpy(zero_copy_only=False) << 40) + rank.to_numpy(zero_copy_only=False)
        at = np.searchsorted(keys, own, side="right") - 1
        return pa.StructArray.from_arrays([pa.array(seqs[at] + own - keys[at]), pa.array(offsets[at])], names=["sequence_id", "offset"])

    return rows.withColumn("_p", place(F.col("length"), F.col("_rank"))).select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "_p.sequence_id", "_p.offset")
