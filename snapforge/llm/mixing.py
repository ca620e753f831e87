"""Mixing sources to target weights by capped water-filling. DataFrame functions only.

Level: a budget of words is poured over the sources in proportion to their weights. A source takes
at most `max_epochs` times its own words; what it cannot take is poured over the others in
proportion to their weights, until every source is under its cap. With sources in order of
cap / weight, the level before source i is (budget - caps before i) / (weights from i on); it rises
while sources are clamped and falls afterwards, so the final level is its maximum. One window over
one row per source finds it.

Sampling: a source's target, in words, is so many whole passes over the source plus a rest. The rest
goes to documents in a seeded order until it is used up. A running sum over a whole source would put
a hot source in one task, so each source is dealt by hash over BUCKETS buckets: bucket sizes are
pre-aggregated, their running sum is over at most BUCKETS rows, and only the documents of the bucket in
which the rest ends are summed one by one. What comes of it is a row for each source: its passes, and
the last document that the rest reaches. A document is judged by its source's row alone, so texts are
never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapforge.llm.common import WORD, checkpointed, dealt_join

#: Buckets that each source is dealt over: a source of 10**10 documents has some 2.4 million in each.
BUCKETS = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(doc_id: Column, seed: int) -> Column:
    """32 bits from the id and the seed, the same in every engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string"))), 1, 8), 16, 10).cast("long")


def cyclic_weights(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """A weight for each source: by code point, null last, the given weights in turn. One row per source."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.select("source", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")).alias("weight"))


def water_fill(sizes: DataFrame, weights: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """(source, source_size, target). Takes (source, source_size) and (source, weight); no weight counts as 0.

    No words or no weight: target 0. A share beyond all caps: every target is its cap. One task sorts a
    row of some 100 bytes for each source, spilling if need be: three million sources take 11 seconds.
    """
    w = F.coalesce(F.col("weight"), F.lit(0.0))
    x = sizes.join(weights.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "source_size", w.alias("weight"), (F.lit(float(max_epochs)) * F.col("source_size")).alias("cap"))
    poured = (F.col("weight") > 0) & (F.col("cap") > 0)
    full = F.col("cap") / F.when(F.col("weight") > 0, F.col("weight"))
    before = Window.partitionBy("live").orderBy(full.asc_nulls_last(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    # the rest of the order, as the start of the opposite one: a frame that ends with the last row is summed anew for each row
    onward = Window.partitionBy("live").orderBy(full.desc_nulls_first(), F.col("source").desc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("live", poured)
    x = x.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy()))
    x = x.withColumn("level", F.when(F.col("live"), (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)))
    x = x.withColumn("level", F.max("level").over(Window.partitionBy("live")))
    return x.select("source", "source_size", F.when(F.col("live"), F.least("cap", F.col("level") * F.col("weight"))).otherwise(F.lit(0.0)).alias("target"))


#: Sources up to so many are shipped to all tasks as one table of some 100 bytes each; more are joined by shuffle.
SHIPPED_SOURCES = 50_000


def _dealt(docs: DataFrame, seed: int) -> DataFrame:
    """docs with _size, _key (its place in the seeded order) and _b (its bucket)."""
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = docs.withColumn("_size", n_words(F.col("text"))).withColumn("_u", seeded(id_text, seed))
    key = F.struct(F.col("_u").alias("u"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("_size").alias("size"))
    return rows.withColumn("_key", key).withColumn("_b", F.floor(F.col("_u") * BUCKETS / 2**32).cast("int")).drop("_u")


def plan_mix(docs: DataFrame, weights: DataFrame | tuple[float, ...], share: float, max_epochs: float, seed: int, whole_documents: bool) -> tuple[DataFrame, DataFrame]:
    """The documents' (doc_id, source, _size, _key, _b), kept, and a row for each source: what the mix takes of it."""
    dealt = checkpointed(_dealt(docs.select("doc_id", "text", "source"), seed).drop("text"))  # whole texts are read once
    buckets = checkpointed(dealt.groupBy("source", "_b").agg(F.sum("_size").alias("_bsize")))
    sizes = buckets.groupBy("source").agg(F.sum("_bsize").alias("source_size"))
    goal = water_fill(sizes, cyclic_weights(sizes, weights) if isinstance(weights, tuple) else weights, share, max_epochs)
    words = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("passes", passes).withColumn("rest", words - F.col("passes") * F.col("source_size"))
    goal = checkpointed(goal.withColumnRenamed("source", "_s"))
    rise = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = buckets.withColumn("_before", F.coalesce(F.sum("_bsize").over(rise), F.lit(0))).join(goal.select("_s", "rest"), F.col("source").eqNullSafe(F.col("_s")))
    ends = ends.where((F.col("_before") < F.col("rest")) & (F.col("rest") <= F.col("_before") + F.col("_bsize"))).select(F.col("_s").alias("_es"), F.col("_b").alias("end_bucket"), (F.col("rest") - F.col("_before")).alias("_left"))
    near = dealt.join(ends, F.col("source").eqNullSafe(F.col("_es")) & (F.col("_b") == F.col("end_bucket")) & (F.col("_size") > 0))
    near = near.groupBy("_es", "end_bucket", "_left", "_key").agg(F.sum("_size").alias("_ties"), F.count("*").alias("_n"))
    run = Window.partitionBy("_es").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("_left", F.col("_left") - F.coalesce(F.sum("_ties").over(run), F.lit(0)))
    last = near.where(F.col("_left") < F.col("_ties")).groupBy("_es").agg(F.min(F.struct("_key", "_left", "_n")).alias("e"))
    part = F.greatest(F.lit(0), F.floor(F.col("e._left") / F.col("e._n"))).cast("long")
    if whole_documents:
        part = F.when(2 * part >= F.col("e._key.size"), F.col("e._key.size")).otherwise(0).cast("long")
    last = last.select(F.col("_es").alias("_ls"), F.col("e._key").alias("end_key"), part.alias("end_part"))
    made = goal.join(ends.drop("_left"), F.col("_s").eqNullSafe(F.col("_es")), "left").drop("_es").join(last, F.col("_s").eqNullSafe(F.col("_ls")), "left").drop("_ls")
    return dealt, checkpointed(made)


def _named(source: Column) -> Column:
    """A source's name that is never null, so that a join meets the rows without a source too."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("null"))


def _taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows of _dealt() with source_size, target, taken and copies. A hot source's rows never meet in one task: they stay where they are, or are dealt over salts."""
    if plan.count() <= SHIPPED_SOURCES:
        met = rows.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("_s")))
    else:
        met = dealt_join(rows.withColumn("_sn", _named(F.col("source"))), plan.withColumn("_sn", _named(F.col("_s"))), ["_sn"], ["_key"])
    end, key = F.col("end_bucket"), F.col("end_key")
    here = F.when(key.isNull() | (F.col("_key") < key), F.col("_size")).when(F.col("_key") == key, F.col("end_part")).otherwise(0)
    part = F.when(end.isNull() | (F.col("_b") > end), 0).when(F.col("_b") < end, F.col("_size")).otherwise(here).cast("long")
    met = met.withColumn("_part", part)
    copies = F.when(F.col("_size") > 0, F.col("passes") + (F.col("_part") > 0).cast("long")).otherwise(0).cast("long")
    return met.withColumn("taken", (F.col("passes") * F.col("_size") + F.col("_part")).cast("long")).withColumn("copies", copies)


def mix(docs: DataFrame, weights: DataFrame | tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17, whole_documents: bool = False) -> DataFrame:
    """What the mix takes of each document: doc_id, source, size, source_size, target, taken, copies.

    weights: (source, weight) rows, or weights that go to the sources in turn. `taken` counts words,
    repeats included; it is at most ceil(max_epochs) times the size. The last document that a
    source's rest reaches is taken in part; with whole_documents it is taken or left, whichever is
    nearer. copies: passes over the document, a part of one included.

    Null text: size 0. Null source: a source of its own, after the others. Repeated rows: each counts;
    those that tie as the last share what is left evenly. Null doc_id: ordered after others. Empty
    table: empty result. Size 0: taken 0, no copies. Columns other than doc_id, text and source are
    left out, so their names can't clash.
    """
    dealt, plan = plan_mix(docs, weights, share, max_epochs, seed, whole_documents)
    return _taken(dealt, plan).select("doc_id", "source", F.col("_size").alias("size"), "source_size", "target", "taken", "copies")


def mixed(docs: DataFrame, weights: DataFrame | tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """The documents of the mix, columns as they came, whatever their names, each as often as the mix takes it (whole documents).

    A document without words (null, empty) is never taken. Null sources are one source, the last. Rows
    that repeat an id are documents of their own, null ids too; those that tie as the last are taken or
    left together. Long texts count whole. Empty table: empty result.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    own = [F.col(names[docs.columns.index(c)]).alias(c) for c in ("doc_id", "text", "source")]
    _, plan = plan_mix(docs, weights, share, max_epochs, seed, True)
    rows = _taken(_dealt(docs.toDF(*names).select("*", *own), seed), plan).where("copies > 0")
    return rows.select(*names, F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*names).toDF(*docs.columns)
