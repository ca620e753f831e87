"""Near-duplicate documents by MinHash with tensored banding.

A document is a set of word shingles. Each of `groups` hash collections gives one key from GROUP
minhashes; a table's key is the pair of two collections' keys, so g * (g - 1) / 2 tables cost only
GROUP * g minhashes, roughly the square root of what as many independent bands cost. `groups` is the
least number at which two documents at the threshold share a table but for a chance of MISS.

From keys to groups of copies, without ever listing the pairs of a bucket:
- documents with one shingle set are one class; classes are counted, hashed and compared once;
- in every bucket each class is compared with the bucket's hub, the class of least hash, of which there
  are a few kinds, so large groups of copies grow together at once;
- buckets that then still hold classes of different components are compared with all their classes, or
  if that is much, with 32 hubs first, then 1,024 and so on: only pairs across components, each once.
No step gathers a bucket or a group of copies in one task: joins by table key or class deal the rows of
a key over salts, and open buckets are compared in blocks of BLOCK classes, a task for each two blocks.
Pairs that a bitmap filter can't rule out are confirmed on full sets, rebuilt from the texts. The
bitmap has a bit for each hash slot, set if an odd number of the set's shingles fall there; as each
shingle that only one of two sets has flips one bit, the bits that differ are a lower bound of their
difference, and no link is lost. Components are joined by contraction
to least labels. Every step is a join or an aggregation; loops end on counts, and the driver
gets no document, link or component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapforge.llm.common import SALTS, checkpointed, dealt_join, each_salt, give_back, parts, plain, release, salt, salts, starts

GROUP = 2
MISS = 1e-4
SEED = 20240229
#: Longs of a bitmap.
BITMAP = 8
#: Low bits of a key that say which table it is of.
TABLE_BITS = 12
#: Bitmaps are compared for all pairs of the open buckets at once if these are no more than so many, or so many for each row.
AT_ONCE, AT_ONCE_EACH = 200_000_000, 1000
#: Tables choose their hubs by one of so many orders of the classes, so a class meets few hubs, and yet not the same one everywhere.
TURNS = 4
#: Classes of a block of an open bucket.
BLOCK = 2048
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_M = np.uint64(0x9E3779B97F4A7C15)


def n_groups(percent: int) -> int:
    """Collections such that, at a similarity of percent / 100, under two agree with a chance of MISS at most."""
    p = (percent / 100) ** GROUP
    g = 2
    while (1 - p) ** g + g * p * (1 - p) ** (g - 1) > MISS:
        g += 1
    return g


class Words(dict):
    """64-bit hashes of words met before, up to 100,000 of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = Words()


def shingles(text: str, size: int) -> np.ndarray:
    """The distinct shingles of a text as ascending 64-bit hashes. With fewer words than `size`, all of them are one; without words, none."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    key = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for j in range(size):
        out = (out ^ key[j : j + n]) * _M
        out ^= out >> np.uint64(31)
    return np.unique(out)


def group_keys(sets: list[np.ndarray], groups: int) -> np.ndarray:
    """(documents, groups): a key of GROUP minhashes for each collection. No set may be empty."""
    rng = np.random.default_rng(SEED)
    flips, odds = (rng.integers(0, 1 << 64, (groups, GROUP), np.uint64) for _ in range(2))
    flat, at = np.concatenate(sets), starts(np.fromiter(map(len, sets), np.int64, len(sets)))
    out = np.zeros((len(sets), groups), np.uint64)
    for g in range(groups):
        for k in range(GROUP):
            least = np.minimum.reduceat((flat ^ flips[g, k]) * (odds[g, k] | np.uint64(1)), at)
            out[:, g] = (out[:, g] ^ least) * _M
            out[:, g] ^= out[:, g] >> np.uint64(29)
    return out.view(np.int64)


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """(documents, BITMAP): parities of how many shingles fall in each of 64 * BITMAP slots."""
    of = np.repeat(np.arange(len(sets)), np.fromiter(map(len, sets), np.int64, len(sets)))
    slots = (np.concatenate(sets) % np.uint64(64 * BITMAP)).astype(np.int64)
    odd = np.bincount(of * 64 * BITMAP + slots, minlength=len(sets) * 64 * BITMAP).astype(np.uint8) & 1
    return np.packbits(odd.reshape(len(sets), -1), axis=1).view(np.int64)


def may_link(n: Column | str, bits: list[str], other_n: Column | str, other_bits: list[str], percent: int) -> Column:
    """False only where 100 * common < percent * all for sure, by the sets' sizes and bitmaps."""
    n, other_n = (F.col(x) if isinstance(x, str) else x for x in (n, other_n))
    apart = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(bits, other_bits, strict=True)), F.lit(0))
    return (100 * F.least(n, other_n) >= percent * F.greatest(n, other_n)) & ((100 + percent) * apart <= (100 - percent) * (n + other_n))


def fingerprints(docs: DataFrame, size: int, groups: int) -> DataFrame:
    """doc_id, text_hash, salt (any), n_shingles, node (a digest of the set; null if it is empty), g0, g1, ... and the bitmap b0, b1, ..."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [*(f"g{i}" for i in range(groups)), *(f"b{i}" for i in range(BITMAP))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                text = [x or "" for x in plain(part, "text").to_pylist()]
                sets = [shingles(x, size) for x in text]
                some = np.fromiter((len(s) > 0 for s in sets), bool, len(sets))
                keys = np.zeros((len(sets), len(names)), np.int64)
                if some.any():
                    full = [s for s in sets if len(s)]
                    keys[some] = np.hstack([group_keys(full, groups), bitmaps(full)])
                node = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                text_hash = [xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 42) for x in text]  # as Spark's xxhash64
                yield pa.RecordBatch.from_arrays([plain(part, "doc_id"), pa.array(np.array(text_hash, np.uint64).view(np.int64)), pa.array(np.arange(len(sets), dtype=np.int32) % SALTS), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.binary()), *(pa.array(np.ascontiguousarray(x)) for x in keys.T)], names=["doc_id", "text_hash", "salt", "n_shingles", "node", *names])
            give_back()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text_hash bigint, salt int, n_shingles bigint, node binary, " + ", ".join(f"{x} bigint" for x in names))


def _first_table(groups: list[str], second: Column) -> Column:
    """Is a table that two classes (g0, ... and _g0, ...) share the first such one: so a pair is met once, not in every table. second: the later of the table's two collections.

    It is if only one collection before that is the same. A join asks this of every pair, so it has to be short: methods of over 8,000 bytes are never compiled.
    """
    return sum((F.when((F.col(g) == F.col(f"_{g}")) & (second > i), 1).otherwise(0) for i, g in enumerate(groups)), F.lit(0)) == 1


def _open_rows(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows of the buckets that hold classes of two components or more, with what `known` (_ln, l: the component) has of their classes, and in_main and n_rest.

    in_main: the class is of the bucket's largest component. n_rest: how many of its classes aren't. Two
    classes of the largest component need no comparison, so a side of n_rest classes is enough to meet all
    pairs across components: a large group of copies costs its bucket nothing but the stragglers.
    """
    held = rows.join(known.select("_ln", "l"), F.col("node") == F.col("_ln")).groupBy("key", "l").agg(F.count("*").alias("n_own"), salts(F.col("salt")).alias("s"))
    mixed = held.groupBy("key").agg(F.max(F.struct("n_own", "l")).alias("main"), F.sum("n_own").alias("n_all"), F.count("*").alias("n_labels"), F.bit_or("s").alias("s")).where("n_labels > 1")
    mixed = mixed.select(F.col("key").alias("_k"), F.col("main.l").alias("_main"), (F.col("n_all") - F.col("main.n_own")).alias("n_rest"), each_salt(F.col("s")).alias("_s"))
    met = rows.join(mixed, (F.col("key") == F.col("_k")) & (F.col("salt") == F.col("_s"))).join(known, F.col("node") == F.col("_ln"))
    return met.withColumn("in_main", F.col("l") == F.col("_main")).drop("_k", "_s", "_ln", "_main")


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sets, rebuilt from texts (node, packed), have 100 * common >= percent * all."""

    side = lambda x: texts.select(F.col("node").alias(x), F.col("packed").alias(f"{x}_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        met: dict[bytes, np.ndarray] = {}
        held = 0

        def of(node: bytes, packed: bytes) -> np.ndarray:
            nonlocal held
            if node not in met:
                if held > 4_000_000:  # shingles
                    met.clear()
                    held = 0
                met[node] = shingles(unpack(packed).decode("utf-8", "surrogatepass"), size)
                held += len(met[node])
            return met[node]

        for whole in batches:
            for batch in parts(whole):
                yes = []
                for a, a_text, b, b_text in zip(*(plain(batch, c).to_pylist() for c in ("a", "a_text", "b", "b_text")), strict=True):
                    x, y = of(a, a_text), of(b, b_text)
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    yes.append(100 * common >= percent * (len(x) + len(y) - common))
                yield batch.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))
        met.clear()
        give_back()

    met = dealt_join(dealt_join(pairs, side("b"), ["b"], ["a"]), side("a"), ["a"], ["b"])  # a hub has many pairs
    return met.mapInArrow(run, "a binary, b binary")


def merged(links: DataFrame, labels: DataFrame) -> DataFrame:
    """labels (node, label) with the components joined that links (a, b) connect. A label is a struct; a component's is its least.

    The vertices are labels, and links count once for each two of them. In a round every vertex goes
    to its least neighbour if that is less, and on to where that one goes; what is left are edges
    between the vertices that stayed, so a component of any size shrinks to its least vertex.
    """
    at = lambda x, r: labels.select(F.col("node").alias(x), F.col("label").alias(r))
    between = lambda x, y: (F.least(x, y).alias("u"), F.greatest(x, y).alias("v"))
    edges = links.join(at("a", "la"), "a").join(at("b", "lb"), "b").where("la <> lb").select(*between("la", "lb")).distinct()
    edges, roots = checkpointed(edges, forget=True), None
    while not edges.isEmpty():
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select("v", "u"))
        least = up = checkpointed(both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("p")), forget=True)
        for _ in range(2):
            up = up.join(up.select(F.col("x").alias("_x"), F.col("p").alias("_p")), F.col("p") == F.col("_x")).select("x", F.col("_p").alias("p"))
        up = checkpointed(up, forget=True)
        release(least)
        to = lambda x, p, up=up: up.select(F.col("x").alias(x), F.col("p").alias(p))
        if roots is None:
            roots = to("_v", "_r")
        else:
            roots = checkpointed(roots.join(to("_x", "_p"), F.col("_r") == F.col("_x"), "left").select("_v", F.coalesce("_p", "_r").alias("_r")), forget=True)
        last, edges = edges, checkpointed(edges.join(to("u", "pu"), "u").join(to("v", "pv"), "v").where("pu <> pv").select(*between("pu", "pv")).distinct(), forget=True)
        release(last)
    if roots is None:
        return labels
    return checkpointed(labels.join(roots, F.col("label") == F.col("_v"), "left").select("node", F.coalesce("_r", "label").alias("label")), forget=True)


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _labelled(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of docs, and their classes: node, rep (no_id, doc_id, text_hash) and label (no_id, doc_id, node), the component's least class; null where no table is shared."""
    groups, bits = n_groups(percent), [f"b{i}" for i in range(BITMAP)]
    prints = checkpointed(fingerprints(docs, size, groups))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    classes = prints.where("node IS NOT NULL").groupBy("node").agg(F.min(first).alias("rep"), salts(F.col("salt")).alias("salts"), F.first("n_shingles").alias("n"), *[F.first(c).alias(c) for c in [*(f"g{i}" for i in range(groups)), *bits]])
    classes = checkpointed(classes)
    tables = [(i, j) for i in range(groups) for j in range(i + 1, groups)]
    keys = F.explode(F.array(*[F.shiftleft(F.xxhash64(f"g{i}", f"g{j}"), TABLE_BITS).bitwiseOR(F.lit(t).cast("long")) for t, (i, j) in enumerate(tables)]))
    rows = classes.select("node", "n", F.xxhash64("node").alias("h"), salt("node").alias("salt"), keys.alias("key"))
    shared = rows.groupBy("key").agg(F.min("h").alias("x"), F.max("h").alias("y"), F.count("*").alias("n_classes"), salts(F.col("salt")).alias("s")).where("x <> y").select(F.col("key").alias("_key"), "n_classes", each_salt(F.col("s")).alias("_s"))
    members = checkpointed(rows.join(shared, (F.col("key") == F.col("_key")) & (F.col("salt") == F.col("_s"))).select("key", "salt", "node", "n", "n_classes"))
    own = F.struct(F.col("rep.no_id").alias("no_id"), F.col("rep.doc_id").alias("doc_id"), F.col("node").alias("node"))
    among = classes.join(members.select(F.col("node").alias("_n")).distinct(), F.col("node") == F.col("_n")).select("node", "rep", "n", own.alias("label"), *bits, *(f"g{i}" for i in range(groups)))
    among = checkpointed(among)

    @F.arrow_udf("binary")
    def packed(text: pa.Array) -> pa.Array:
        pack = zstandard.ZstdCompressor(level=1).compress
        out = [pa.array([pack((x.as_py() or "").encode("utf-8", "surrogatepass")) for x in part], pa.binary()) for part in parts(text)]  # one text at a time
        give_back()
        return pa.concat_arrays(out or [pa.array([], pa.binary())])

    source = docs.select(F.col("doc_id").alias("_id"), _text_hash().alias("_hash"), packed(F.col("text")).alias("packed"))
    texts = among.join(source, F.col("rep.doc_id").eqNullSafe(F.col("_id")) & (F.col("rep.text_hash") == F.col("_hash"))).groupBy("node").agg(F.first("packed").alias("packed"))
    texts = checkpointed(texts)

    labels, hubs, before, done, open_rows = among.select("node", "label"), 0, 1, None, None
    other, own_groups = [f"_{c}" for c in bits], [f"g{i}" for i in range(groups)]
    second = F.element_at(F.array(*[F.lit(j) for _, j in tables]), (F.col("key").bitwiseAND(F.lit((1 << TABLE_BITS) - 1).cast("long")) + 1).cast("int"))
    while True:
        if not hubs:
            turn = F.pmod(F.col("key").bitwiseAND(F.lit((1 << TABLE_BITS) - 1).cast("long")), F.lit(TURNS))
            hub = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", turn).alias("r"), "node")).alias("hub"), salts(F.col("salt")).alias("s"))
            hub = hub.select(F.col("key").alias("_hk"), F.col("hub.node").alias("_h"), each_salt(F.col("s")).alias("_s"))
            met = members.join(hub, (F.col("key") == F.col("_hk")) & (F.col("salt") == F.col("_s")) & (F.col("node") != F.col("_h")))
            met = met.select(F.least("node", "_h").alias("a"), F.greatest("node", "_h").alias("b")).distinct()
            of = lambda x, bs, n: among.select(F.col("node").alias(x), F.col("n").alias(n), *[F.col(c).alias(d) for c, d in zip(bits, bs, strict=True)])
            met = dealt_join(dealt_join(met, of("a", bits, "n"), ["a"], ["b"]), of("b", other, "_n"), ["b"], ["a"])
            pairs = met.where(may_link("n", bits, "_n", other, percent)).select("a", "b")
        else:
            if before >= 1 << 40:
                break
            known = labels.join(among.select(F.col("node").alias("_an"), *bits, *own_groups), F.col("node") == F.col("_an")).select(F.col("node").alias("_ln"), F.xxhash64(F.col("label.node")).alias("l"), *bits, *own_groups)
            rows = members.where(F.col("n_classes") > before)
            rows = open_rows = checkpointed(_open_rows(rows, known))
            n_rows, n_pairs = rows.agg(F.count("*"), F.sum(F.when(F.col("in_main"), 0).otherwise(F.col("n_classes")).cast("double"))).first()
            if not n_rows:
                break
            if n_pairs <= max(AT_ONCE, AT_ONCE_EACH * n_rows):
                hubs = 1 << 40
            chance = (F.pmod(F.xxhash64("key", "node"), F.lit(1 << 40)) + 1) / F.lit(float(1 << 40))
            rows = rows.withColumn("is_hub", ~F.col("in_main") & ((F.col("n_classes") <= hubs) | (chance <= F.lit(float(hubs)) / F.col("n_classes")))).withColumn("second", second)
            renamed = {c: f"_{c}" for c in (*bits, *own_groups)}
            n_blocks = F.ceil(F.col("n_classes") / BLOCK).cast("int")
            n_hub_blocks = F.ceil(F.least(F.col("n_rest"), F.lit(hubs).cast("long")) / BLOCK).cast("int")
            block = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
            all_of = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
            hub = rows.where("is_hub").select(F.col("key").alias("_hk"), F.col("node").alias("_h"), F.col("n").alias("_n"), F.col("l").alias("_l"), block(n_hub_blocks).alias("_hb"), all_of(n_blocks).alias("_b"), *[F.col(c).alias(d) for c, d in renamed.items()])
            once = (~F.col("is_hub") | (F.col("node") < F.col("_h"))) & _first_table(own_groups, F.col("second"))
            sides = rows.withColumn("b", block(n_blocks)).withColumn("hb", all_of(n_hub_blocks))
            met = sides.join(hub, (F.col("key") == F.col("_hk")) & (F.col("b") == F.col("_b")) & (F.col("hb") == F.col("_hb")) & (F.col("l") != F.col("_l")) & may_link("n", bits, "_n", other, percent) & once)
            pairs = met.select(F.least("node", "_h").alias("a"), F.greatest("node", "_h").alias("b")).distinct().join(done, ["a", "b"], "left_anti")
        pairs = checkpointed(pairs)
        found = checkpointed(confirmed(pairs, texts, size, percent))
        done = pairs if done is None else done.union(pairs)
        labels = merged(found, labels)
        release(found, open_rows)
        before, hubs = max(1, hubs), 32 * max(1, hubs)

    release(members, texts)
    reached = labels.select(F.col("node").alias("_ln"), "label")
    return prints, classes.join(reached, F.col("node") == F.col("_ln"), "left").select("node", "rep", "salts", "label")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs.

    Linked: 100 * common shingles >= percent * all shingles of both. component_id is the least doc_id
    that links reach, kept is doc_id = component_id. Null, empty and wordless texts have no shingles and
    link with nothing. Equal sets are linked, whatever their number. Null doc_ids come after others; a
    component of null ids only has a null id. Repeated rows stay, each with its component. Columns
    other than doc_id and text are left out. Very long texts give all their shingles. Empty table: empty
    result.
    """
    prints, classes = _labelled(docs, size, percent)
    of = classes.select(F.col("node").alias("_n"), F.when(F.col("label").isNull(), F.col("rep.doc_id")).otherwise(F.col("label.doc_id")).alias("_component"), each_salt(F.col("salts")).alias("_s"))
    out = prints.join(of, (F.col("node") == F.col("_n")) & (F.col("salt") == F.col("_s")), "left")  # a class's copies over its salts
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("_component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def representatives(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each component, columns as they came, and every row without shingles.

    A component's row is that of its least class (by doc_id, nulls last, then set digest) with the
    least (doc_id, text hash) there. Rows are told apart by id and text, so those that only share an id,
    or have none, stay; of rows with one id and one text one stays. Null and empty texts have no shingles.
    Very long texts are compared whole. Other columns may have any names. Empty table: empty result.
    """
    _, classes = _labelled(docs, size, percent)
    least = classes.where(F.col("label").isNull() | (F.col("label.node") == F.col("node")))
    key = lambda d, h: (F.coalesce(d.cast("string"), F.lit("")).alias("_id"), d.isNull().alias("_no_id"), h.alias("_hash"))
    kept = least.select(*key(F.col("rep.doc_id"), F.col("rep.text_hash")))
    names = [f"_c{i}" for i in range(len(docs.columns))]
    wordless = F.btrim(F.coalesce(F.col("text"), F.lit("")), F.lit(" \t\n\r\x0b\x0c")) == ""
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)], *key(F.col("doc_id"), _text_hash()), wordless.alias("_wordless"))
    one = F.row_number().over(Window.partitionBy("_id", "_no_id", "_hash").orderBy(F.lit(0)))  # dealt as the join dealt them: texts move once
    met = rows.where("NOT _wordless").join(kept, ["_id", "_no_id", "_hash"], "left_semi").withColumn("_row", one).where("_row = 1")
    return met.select(*names).union(rows.where("_wordless").select(*names)).toDF(*docs.columns)
