"""The queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapforge.llm import sql


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from snapforge.llm.mixing import mix

    return mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from snapforge.llm.html_extract import extract

    return extract(_read(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from snapforge.llm.quality import judged

    return judged(_read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failures")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from snapforge.llm.media import media_digests

    return media_digests(_read(spark, sf_dir, "documents"))


def op8_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from snapforge.llm.packing import pack

    return pack(_read(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from snapforge.llm.token_counts import length_histogram, suffix_sums

    return suffix_sums(length_histogram(_read(spark, sf_dir, "documents")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from snapforge.llm.toxicity import scored

    return scored(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from snapforge.llm.neardup import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), size=3, percent=85)


#: The conversation that op6 adds, by its contract.
ADDED = ((-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"))
#: The rules that op7 judges by, by its contract.
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from snapforge.llm.chat import digests, formatted

    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(c).cast(turns.schema["conv_id"].dataType).alias("conv_id"), F.lit(t).cast(turns.schema["turn"].dataType).alias("turn"), F.lit(r).alias("role"), F.lit(x).alias("text")) for c, t, r, x in ADDED])))
    return digests(formatted(turns.unionByName(added)))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from snapforge.llm.url_filter import block_list, judged

    return judged(_read(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "verdict string, host string, path string"), block_list(spark))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_main_text": op2_main_text,
    "op3_quality_rules": op3_quality_rules,
    "op4_media_columns": op4_media_columns,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_chat_format": op6_chat_format,
    "op7_url_filter": op7_url_filter,
    "op8_pack_sequences": op8_pack_sequences,
    "op9_token_counts": op9_token_counts,
    "op10_toxicity": op10_toxicity,
}
SQL: dict[str, str] = {"op1_mix_sources": sql.MIX, "op3_quality_rules": sql.QUALITY, "op6_chat_format": sql.CHAT, "op7_url_filter": sql.URLS}
