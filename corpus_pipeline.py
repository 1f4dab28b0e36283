"""A corpus pipeline over ``documents``: quality rules, near-duplicates, repeated passages, packing."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redpen.llm import packing, quality, simhash, substrings
from redpen.llm.common import remove_at_exit, shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the floors and the robust estimates keep, all columns. A null or empty
    text has no words and goes; a text of any length is judged whole; repeated rows share
    their verdict; nulls in language and source form groups; an empty table stays empty."""
    return quality.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8): that
    of the least id, null ids last; of repeated rows one. Texts without words all stay."""
    return simhash.representatives(docs, width=5, similarity=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 35 or more words that stand elsewhere too, and
    with ``n_chars`` counted anew. A text may become empty; a null one does."""
    return substrings.cleaned(docs, window=35).withColumn("n_chars", F.char_length("text").cast("bigint"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens, with their ids. A null or
    empty text has the end id alone; repeated rows are documents of their own."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("packing", packed),
]

#: Robust estimates, fingerprints and merges have no SQL; the operators and the stages' effects are tested.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        remove_at_exit(spark, path)
        docs = spark.read.parquet(path)
    return docs
