"""A pipeline from documents to packed training sequences.

Stages: language identification (rejected documents go), toxicity (rejected documents go), exact
deduplication (the smallest id of equal texts stays), near-deduplication by SimHash (one document of each
group stays), best-fit packing.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirespark.llm import exact_dedup, language_id, packing, simhash_dedup, toxicity
from quirespark.llm.common import id_remainder, materialize

#: SQL can't express language identification, toxicity, fingerprints or packing.
ORACLE_SQL = None


def _training_rows(docs: DataFrame) -> DataFrame:
    """The three quarters of the documents that classifiers may learn from."""
    return docs.where(id_remainder("doc_id", 4) != 2)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language.  Null texts, and texts without a letter, go; repeated rows stay or go
    together; without any labelled row nothing is known of languages, and all texts with a letter stay; an
    empty table gives no rows; all columns pass through, whatever their names."""
    return language_id.accepted(docs, language_id.fit(_training_rows(docs)))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.3.  Null and empty texts are scored, too; labels of no document, and
    documents without a label, are no matter; repeated rows stay or go together; an empty table gives no
    rows."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.harmless(docs, toxicity.fit(_training_rows(docs), labels))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, null counting as empty, the row of the smallest id; repeated
    rows of one id and text stay or go together; an empty table gives no rows."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest id of each group that fingerprints link; texts without words are one group.  Of
    several texts of that id the one of the smallest hash stays; repeated rows stay or go together."""
    return simhash_dedup.deduplicate(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places; null and empty texts are one piece of the end id; ties go by
    id; an empty table gives no rows."""
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared folder for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
