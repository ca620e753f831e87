"""Token counts from an exact length histogram.

Documents are aggregated by encoded length, once. How many tokens there are, how many documents exceed
a context limit, what truncation to it keeps, and any quantile are then sums over the histogram's
upper end, for every limit at once.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapforge.llm.common import checkpointed, texts
from snapforge.llm.tokens import VOCABULARY, encoder

#: Lengths are summed in blocks of so many, so that no task holds all distinct lengths.
BLOCK = 1024


def n_tokens(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """How many ids each whole text has; null and empty texts have none."""

    @F.arrow_udf("bigint")
    def count(column: pa.Array) -> pa.Array:
        ids = encoder(vocabulary).ids
        return pa.array([len(ids(x)) for x in texts(column)], pa.int64())

    return count(text)


def length_histogram(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(length, n_docs) over all documents. Null and empty texts have length 0, long ones their full length.

    Repeated rows and rows with null ids count each. Other columns are not read. Empty table: no rows.
    """
    return docs.select(n_tokens(F.col(text), vocabulary).alias("length")).groupBy("length").agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """A row for each length that occurs: n_docs, n_tokens, and over documents at least so long docs_from and tokens_from; truncated_total, the tokens left when every document is cut to that length; docs_upto.

    An empty histogram gives no rows.
    """
    histogram = checkpointed(histogram)  # texts are encoded once
    h = histogram.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"), F.floor(F.col("length") / BLOCK).alias("_block"))
    sums = [F.sum("n_docs").alias("_d"), F.sum("n_tokens").alias("_t")]
    above = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)  # one row for 1,024 lengths
    blocks = h.groupBy("_block").agg(*sums)
    total = Window.partitionBy()
    blocks = blocks.select(F.col("_block").alias("_b"), *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"_above{c}") for c in ("_d", "_t")], F.sum("_d").over(total).alias("_all_d"), F.sum("_t").over(total).alias("_all_t"))
    inside = Window.partitionBy("_block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    h = h.join(blocks, F.col("_block") == F.col("_b"))
    h = h.withColumn("docs_from", F.col("_above_d") + F.sum("n_docs").over(inside)).withColumn("tokens_from", F.col("_above_t") + F.sum("n_tokens").over(inside))
    return h.select(
        "length", "n_docs", "n_tokens", "docs_from", "tokens_from",
        (F.col("_all_t") - F.col("tokens_from") + F.col("length") * F.col("docs_from")).alias("truncated_total"),
        (F.col("_all_d") - F.col("docs_from") + F.col("n_docs")).alias("docs_upto"),
    )


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, total_tokens, truncated_total, docs_over) for any limits, lengths that occur or not. One aggregation."""
    each = F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])).alias("context_limit")
    rows = histogram.select("length", "n_docs", each)
    return rows.groupBy("context_limit").agg(
        F.sum(F.col("length") * F.col("n_docs")).alias("total_tokens"),
        F.sum(F.least("length", "context_limit") * F.col("n_docs")).alias("truncated_total"),
        F.sum(F.when(F.col("length") > F.col("context_limit"), F.col("n_docs")).otherwise(0)).alias("docs_over"),
    )


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """(length): the nearest-rank q-quantile of the lengths, from suffix_sums(): the least with docs_upto >= q * documents."""
    n = F.col("docs_upto") + F.col("docs_from") - F.col("n_docs")
    return sums.where(F.col("docs_upto") >= F.greatest(F.lit(1), F.ceil(F.lit(q) * n))).agg(F.min("length").alias("length"))
