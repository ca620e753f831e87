"""The training-corpus pipeline: from documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept; each result
is written as Parquet and read again. All but the last return the columns of documents, and any columns
beside them, whatever their names. Every stage gives an empty result for an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from snapforge.llm.common import delete, shared_folder
from snapforge.llm.mixing import mixed
from snapforge.llm.neardup import representatives
from snapforge.llm.packing import pack
from snapforge.llm.quality import kept_documents
from snapforge.llm.toxicity import accepted_documents, train


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5. The model is trained on labelled rows of docs outside fold 0.

    Null and empty texts score as the model's bias does; long texts count whole. Repeated rows stay or go
    together; rows with null ids are scored, but teach nothing.
    """
    return accepted_documents(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose failure bits pass the base rules and the current policy.

    Null and empty texts fail; long texts are measured whole. Repeated rows stay or go together; ids play no part.
    """
    return kept_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by five-word shingles at a similarity of 0.8 or more, and all rows without words.

    Of rows that repeat both id and text one stays; rows that only share an id, or have none, are
    documents of their own. The row of a group is the one of least (id, text hash) of its least class, so
    ties are settled by content. Long texts are compared whole.
    """
    return representatives(docs, size=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: weights 3, 1, 2 in turn, 150 % of all words, two passes at most.

    Null sources are one source, the last; null and empty texts are never taken. Repeated rows and null
    ids count each; rows that tie as a source's last are taken or left together.
    """
    return mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2,048 tokens with their ids and their places in sequences; a document that the mix repeats is packed as often.

    A null or empty text is its end id alone. Rows that repeat an id are documents of their own. Longer
    texts are cut. Columns other than doc_id and text are left out.
    """
    return pack(docs, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("near-duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Scores of a trained model, MinHash candidates and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over the documents of sf_dir, each result written to the shared folder and read again."""
    folder, last = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{folder}/{name.replace(' ', '-')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            delete(spark, last)
        last = path
    return docs
