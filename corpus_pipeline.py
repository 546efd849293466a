"""The corpus pipeline: documents to packed training sequences, one operator a stage.

Each stage takes all that the one before it kept. Decisions take effect: toxic documents and documents that fail the
quality rules go, one document of each near-duplicate group stays (five-word shingles, similarity 0.8), passages that an
earlier document holds are cut, and what is left is packed. SQL can't express the trees, sketches and packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldsift.llm import minhash, packing, quality, suffix_dedup, toxicity
from fieldsift.llm.common import as_table, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the toxicity score doesn't reject, as they are: every row is scored, whatever its doc_id; null texts as empty ones."""
    scored = toxicity.score_documents(docs, read(spark, sf_dir, "labels"), keep_row=True)
    return scored.where("predicted = 0").select("row.*")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that pass the base rules and their group's cutoffs, as they are; texts of fewer than 50 words, empty and null ones too, go."""
    return quality.keep_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of its smallest doc_id, and all rows without words or doc_id, as they are.

    Each text is judged by itself, also where a doc_id has several: a row goes only for one that stays. Null texts are empty.
    """
    return minhash.distinct_rows(docs, words=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the byte runs that a document with a smaller doc_id also holds; n_chars is counted anew."""
    return suffix_dedup.cut_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows' tokens in sequences of 1024; an empty text is its end id alone."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_quality),
    ("minhash_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of documents; an empty table passes through every stage and gives none."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = as_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
