"""A corpus from raw documents to packed sequences; each stage's output is written as Parquet and read by the next.

Every stage takes nulls in any column, empty and very long texts, rows that repeat, empty tables (an empty result) and
columns besides those of documents, whatever their names: the stages' own columns take names that are free.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm._base import stored, table
from tessella.llm.exact_dedup import keep_first
from tessella.llm.mixing import mixed
from tessella.llm.ngram_join import keep_one
from tessella.llm.packing import packed_digests
from tessella.llm.quality import fold, keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels outside the held-out fold.

    Null text counts as empty and is scored as any text; a null id has no label. Equal texts are scored alike, so rows
    that repeat stay or go together. Without trusted positives among docs every score is 0.5, and all stay.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"), fold() != 0)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays.

    Null text equals the empty one. Null ids come last; of rows that repeat id and text, one stays.
    """
    return keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that share 80 % of their 5-word shingles one stays: the smallest doc_id, null last, ties by a hash of the text.

    Texts without words are like none and stay. Rows that repeat id and text stay together.
    """
    return keep_one(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks.

    A null source is a source of its own. Texts without words count nothing and go or stay with their id's hash; rows
    that repeat an id are taken alike.
    """
    return mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4,096 tokens; a document's pieces carry its id, null too. Null and empty texts are one end token."""
    return packed_digests(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mix", mix), ("pack", pack)]

#: The classifier and the tokenizer are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
