"""The training-text pipeline: documents go through five stages of ``graphvec.llm``.

Each stage works on all rows that its predecessor kept; its result is written as Parquet below
``spark.checkpoint.dir`` and read again. All stages but the last return the columns of documents.

Every stage bounds the bytes of the batches that its Python functions get: executors keep what
earlier stages touched, so a stage's memory adds to theirs.

Nulls in any column, empty and very long texts, repeated rows, an empty table and extra columns
are handled as the stages' modules say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from graphvec.llm import jaccard, packing, quality, substring, toxicity
from graphvec.session import bounded_batches, write_table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, learned from the table of labels, does not reject."""
    bounded_batches(spark)
    return toxicity.filter_toxic(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and are no outliers in their language and source."""
    bounded_batches(spark)
    return quality.filter_quality(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of linked documents."""
    bounded_batches(spark)
    return jaccard.keep_first(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that occur earlier in the corpus."""
    bounded_batches(spark)
    return substring.remove_repeats(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a sequence: a piece of one document whose length is a power of two."""
    bounded_batches(spark)
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_copies", drop_near_copies),
    ("repeats", drop_repeats),
    ("packing", pack_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs


#: Models and tokens are beyond SQL; tests/llm holds the result against a plain version.
ORACLE_SQL = None
