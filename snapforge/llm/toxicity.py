"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), x_i: does the text have term i. Terms
are words and the beginnings of words, hashed to SPACE slots, and every slot that a training text
fills is a variable of the fit; none is left out beforehand. Linear weights are held back by an L1
penalty, which leaves most of them at exactly 0. A term has factors of rank RANK while its linear
weight is not 0, as in memory-adaptive factorization machines, and they learn what linear weights
can't: an insult counts more beside a group's name than alone.

The fit sees at most MAX_ROWS labelled documents; scoring sees every document, whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapforge.llm.common import give_back, parts, texts, trim_driver

#: Hashed terms.
SPACE = 1 << 20
#: Labelled rows that a model is fitted on, at most: those with the least hash of their id.
MAX_ROWS = 10_000
RANK = 4
#: Lengths of the beginnings that a word is also known by: they carry over to inflected and compound words.
BEGINNINGS = (3, 4, 5, 6)
#: The L1 penalty, in standard deviations of the number of toxic texts among random ones.
PENALTY = 0.2
#: What a factor's slope is increased by for each unit of the factor.
DECAY = 0.05
#: Passes and step sizes of the linear fit and of the joint one, and the texts of a step.
LINEAR, JOINT, BATCH = (12, 0.1), (20, 0.05), 64
#: Stripped from both ends of a word.
MARKS = b".,;:!?\"'()[]{}<>|#*$%&@~^_=+-/\\`"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def slots_of(word: bytes) -> tuple[int, ...]:
    """Where a word's terms are hashed to: itself and its beginnings, without the marks around it."""
    term = word.strip(MARKS)
    if not term:
        return ()
    letters = term.decode("utf-8", "surrogatepass")
    heads = {letters[:n] for n in BEGINNINGS if n < len(letters)}
    return tuple({xxhash.xxh3_64_intdigest(x) % SPACE for x in (b"=" + term, *(b"<" + h.encode("utf-8", "surrogatepass") for h in heads))})


class Slots(dict):
    """slots_of() for words met before, up to 200,000 of them; with a model, its own terms' places only."""

    def __init__(self, known: np.ndarray | None = None):
        self.known = None if known is None else {int(s): i for i, s in enumerate(known)}

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= 200_000:
            self.clear()
        found = slots_of(word)
        self[word] = found = found if self.known is None else tuple(self.known[s] for s in found if s in self.known)
        return found

    def terms(self, text: str) -> list[int]:
        """The distinct terms of a text, ascending."""
        out: set[int] = set()
        for word in set(text.encode("utf-8", "surrogatepass").translate(LOWER).split()):
            out.update(self[word])
        return sorted(out)


def margins(at: np.ndarray, sizes: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's sum before the sigmoid, and its sums of factors. at: places of all texts' terms, one text after the other.

    A text's sums don't depend on the texts beside it, to the last bit.
    """
    n, of = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
    z, held = bias + np.bincount(of, w[at], n), np.zeros((n, v.shape[1]))
    for k in range(v.shape[1]):
        own = v[at, k]
        held[:, k] = np.bincount(of, own, n)
        z += 0.5 * (held[:, k] ** 2 - np.bincount(of, own**2, n))
    return z, held


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def gradient(at: np.ndarray, sizes: np.ndarray, labels: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The logistic loss's slopes, summed over texts, by bias, linear weights and factors."""
    z, held = margins(at, sizes, bias, w, v)
    slope = sigmoid(z) - labels
    each, of = np.repeat(slope, sizes), np.repeat(np.arange(len(sizes)), sizes)
    dv = np.zeros_like(v)
    for k in range(v.shape[1]):
        dv[:, k] = np.bincount(at, each * (held[of, k] - v[at, k]), len(w))
    return float(slope.sum()), np.bincount(at, each, len(w)), dv


@dataclass(frozen=True)
class Model:
    bias: float
    slots: np.ndarray  # ascending
    linear: np.ndarray
    factors: np.ndarray  # a row for each slot

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        """Scores of texts by the places of their terms among the model's slots."""
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        at = np.fromiter(chain.from_iterable(rows), np.int64, int(sizes.sum()))
        return sigmoid(margins(at, sizes, self.bias, self.linear, self.factors)[0])

    def scores_of(self, column: pa.Array, slots: Slots) -> np.ndarray:
        """Scores of a text column, a part at a time: a text's terms and their sums take many times its own memory."""
        return np.concatenate([np.zeros(0), *(self.scores([slots.terms(x) for x in texts(part)]) for part in parts(column))])


class Weights:
    """Linear weights by regularised dual averaging: each follows its mean slope so far, less the L1 penalty, at Adagrad's rate."""

    def __init__(self, n: int, rate: float, penalty: float = 0.0, start: float = 0.0):
        self.total, self.seen, self.steps = np.zeros(n), np.full(n, 1e-8), 0
        self.rate, self.penalty, self.start = rate, penalty, start

    def of(self, own: np.ndarray | slice = slice(None)) -> np.ndarray:
        total = self.total[own]
        return self.start - self.rate * np.sign(total) * np.maximum(np.abs(total) - self.penalty * self.steps, 0.0) / np.sqrt(self.seen[own])

    def step(self, own: np.ndarray | slice, slope: np.ndarray) -> None:
        self.total[own] += slope
        self.seen[own] += slope * slope
        self.steps += 1


def batches(rows: list[np.ndarray], labels: np.ndarray, size: int = BATCH) -> list[tuple[np.ndarray, ...]]:
    """(terms, places among them, sizes, labels) of so many texts at a time. No copy of all terms is made."""
    out = []
    for i in range(0, len(rows), size):
        own, places = np.unique(np.concatenate(rows[i : i + size]), return_inverse=True)
        out.append((own.astype(np.int32), places.astype(np.int32), np.array([len(r) for r in rows[i : i + size]]), labels[i : i + size].astype(np.float64)))
    return out


def only(parts: list[tuple[np.ndarray, ...]], place: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """The batches with terms at their places, without those whose place is -1."""
    out = []
    for own, places, sizes, y in parts:
        at = place[own]
        stays = at >= 0
        new = np.cumsum(stays, dtype=np.int32) - 1
        known = stays[places]
        of = np.repeat(np.arange(len(sizes)), sizes)[known]
        out.append((at[stays], new[places[known]], np.bincount(of, minlength=len(sizes)), y))
    return out


def fit(rows: list[np.ndarray], labels: np.ndarray, rank: int = RANK, penalty: float = PENALTY, seed: int = 7) -> Model:
    """A model of texts, each a row of its terms' slots.

    First linear weights alone, then bias, weights and factors together, by passes over batches of texts.
    rank 0 gives the linear model. Without rows of both labels the model is its bias: the labels'
    share, half a row added to each.
    """
    n, n1 = len(labels), int((labels == 1).sum())
    bias = Weights(1, LINEAR[1], start=float(np.log((n1 + 0.5) / (n - n1 + 0.5))))
    if not 0 < n1 < n:
        return Model(bias.start, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, rank)))
    w = Weights(SPACE, LINEAR[1], penalty * float(np.sqrt(n1 * (n - n1) / n)) * BATCH / n)

    def run(parts: list[tuple[np.ndarray, ...]], passes: int, v: np.ndarray, rate: float) -> None:
        order, held = np.random.default_rng(seed), np.full_like(v, 1e-8)
        for _ in range(passes):
            for i in order.permutation(len(parts)):
                own, places, counts, y = parts[i]
                db, dw, dv = gradient(places, counts, y, bias.of()[0], w.of(own), v[own])
                bias.step(slice(None), np.array([db]))
                w.step(own, dw)
                if rank:
                    dv += DECAY * v[own]
                    held[own] += dv * dv
                    v[own] -= rate * dv / np.sqrt(held[own])

    parts = batches(rows, labels)
    run(parts, LINEAR[0], np.zeros((SPACE, 0)), 0.0)
    live = np.flatnonzero(w.of())
    v = np.random.default_rng(seed).normal(0, 0.05, (len(live), rank))
    if rank and len(live):
        place = np.full(SPACE, -1, np.int32)
        place[live] = np.arange(len(live))
        parts = only(parts, place)
        w.total, w.seen = w.total[live], w.seen[live]
        run(parts, JOINT[0], v, JOINT[1])
        return Model(float(bias.of()[0]), live, w.of(), v)
    return Model(float(bias.of()[0]), live, w.of(live), v)


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def labelled_terms(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS) -> tuple[list[np.ndarray], np.ndarray]:
    """Term slots and labels of the training rows: labelled, fold not 0, at most about max_rows of them."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    n = known.count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(max_rows / n * (1 << 30)))

    @F.arrow_udf("array<int>")
    def slots(column: pa.Array) -> pa.Array:
        terms = Slots().terms
        found = [np.array(terms(x), np.int32) for x in texts(column)]
        ends = np.cumsum([0, *map(len, found)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *found])))

    rows = docs.select("doc_id", "text").join(known, "doc_id").select("doc_id", F.xxhash64("text").alias("h"), "y", slots(F.col("text")).alias("t")).toArrow()  # some 1,000 numbers of 4 bytes for each of max_rows
    found = [x for c in rows["t"].chunks for x in np.split(c.flatten().to_numpy(), np.cumsum(pc.list_value_length(c).to_numpy())[:-1]) if len(c)]  # views
    order = pc.sort_indices(rows.select(["doc_id", "h"]), sort_keys=[("doc_id", "ascending"), ("h", "ascending")]).to_numpy()  # sums of floats depend on it
    return [found[i] for i in order], rows["y"].to_numpy()[order]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    """A model of the labelled documents outside fold 0. Labels, ids, languages and sources are no inputs of a score.

    Labelled twice, a document is toxic if one label says so. Null labels, null ids and labels without a
    document teach nothing; repeated rows of a labelled document teach as often. Without labels of both
    kinds all scores are the same.
    """
    model = fit(*labelled_terms(docs, labels, label, max_rows))
    give_back()  # the driver's Python
    trim_driver(docs.sparkSession)
    return model


def score(text: Column, model: Model) -> Column:
    """Toxicity from 0 to 1. Null and empty texts get the score of the bias. The model holds terms of at most MAX_ROWS texts, and of these only those with a weight, so it is small to ship."""
    held: dict = {}  # a task's words met before

    @F.arrow_udf("double")
    def _score(column: pa.Array) -> pa.Array:
        found = model.scores_of(column, held.setdefault("slots", Slots(model.slots)))
        give_back()
        return pa.array(found, pa.float64())

    return _score(text)


def scored(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs.

    Null and empty texts: the bias's score. Long texts count whole, by their distinct terms. Null doc_id:
    held out. Repeated rows each have a row, with one score. Columns other than doc_id and text are left
    out, so their names can't clash. Empty table: empty result.
    """
    rows = docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), score(F.col("text"), train(docs, labels, label, max_rows)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted_documents(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows that score under the threshold, columns as they came, whatever their names.

    Null and empty texts score as the bias does. Repeated rows stay or go together. Empty table: empty result.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    return rows.where(score(F.col(names[docs.columns.index("text")]), model) < threshold).toDF(*docs.columns)
