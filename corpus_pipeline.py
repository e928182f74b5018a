"""A text corpus from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept,
and calls one operator. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyhouse.llm import bpe, decontam, line_dedup, near_dedup, quality, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; frequent lines of a host leave the others.

    Null and empty texts have no words and go; a null host is a host; a long
    text is one block; repeated rows have one fate; no rows give none.
    """
    return quality.filter_documents(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more leave every document.

    A null or empty text is one empty line, which stays; repeated rows are
    documents each; a long text is one block; no rows give none.
    """
    return line_dedup.drop_lines(docs, line_dedup.build_index(docs, limit=10))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the one with the smallest id.

    All texts without words are one class; a null id is the last choice; of
    repeated rows one stays; no rows give none.
    """
    return near_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none and stay; repeated rows have one fate;
    without items nothing goes; no rows give none.
    """
    return decontam.drop_copies(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left.

    Null and empty texts have no tokens; every row gives one, repeated rows
    too; no rows give none.
    """
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("bpe", tokenize),
]

#: Alignment, sketches and merges have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
