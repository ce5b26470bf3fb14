"""A corpus pipeline of five stages: toxicity, near duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are
written as Parquet and read again as the next stage's documents. All but the last
keep the documents' columns, in their order and whatever their names, and treat
null or empty texts as clean: they are scored like texts without terms, are
duplicates of each other, hold no passage and no value, and pack as one end token.
An empty table passes through all stages as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from legwork.functions.storage import stored
from legwork.llm import decontaminate, neardup, packing, pii, toxicity
from legwork.llm.common import table
from legwork.llm.queries import PII_KEY, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score less than 0.7; rows with equal texts share their fate, null ids are scored like others."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"), threshold=0.7)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class at a similarity of 0.8 over shingles of five words: the one of least doc_id (null ids come after all others), one row of repeated ones."""
    return neardup.distinct(docs, words=5, similarity=0.8)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 10 words or more that test items hold; one that is such passages for at least 0.8 of its words goes."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal values; equal values get equal ones in all documents."""
    return pii.pseudonymise_documents(docs, PII_KEY)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 2048 tokens; repeated rows are packed each."""
    return packing.pack(docs, tokenizer_path(), capacity=2048, end_id=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("pii", hide_personal_data),
    ("packing", pack),
]

#: Scores, signatures and token ids have no SQL form; the tests hold run() against the stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
