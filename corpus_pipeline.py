"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and returns what the next one reads.

A stage's result is written as Parquet and read again before the next begins, so a stage works on exactly what its predecessor
kept, and a failure costs one stage. All stages but the last return the columns of documents, and any others that docs has.

Defined cases, which each stage's operator states in full: documents with a null or empty text, or one without a letter, go in the
first stage; null doc_ids, langs, sources and n_chars stay as they are; rows that repeat doc_id and text become one in the second stage;
an empty table, of documents or benchmark items, passes all stages; texts are treated whole at any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontamination, language, neardup, packing, secrets
from millrace.llm.common import forget, keep, table
from millrace.llm.queries import tokenizer_json


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those whose n-grams are mostly of no language that was learned (cover below 0.4).

    Filters are learned from the documents themselves that have a lang; where none has, only documents without a letter go.
    """
    return language.reject_unknown(docs, language.learn(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate group (shingles of five words, similarity of 0.8 or more).

    Null doc_ids come after all others; texts without words are linked with nothing and stay.
    """
    return neardup.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out of the texts; a document that is nothing else goes.

    Items of fewer than ten words are one window; null or empty items are none; n_chars follows the text where it was cut.
    """
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in place of each secret; all documents stay, and n_chars follows the text.

    The chains learn from strings of the documents themselves; of a table too small for samples of both labels the fixed patterns alone are found.
    """
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 tokens: doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    return packing.pack(docs, tokenizer_json())


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: The stages learn models and link documents, which SQL can't express; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = []
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
        kept.append(docs)
        if len(kept) > 1:
            forget(kept[-2])  # the next stage reads this one alone, so at most two copies of the texts are kept
    return STAGES[-1][1](spark, docs, sf_dir)
