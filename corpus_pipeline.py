"""From raw documents to token ids: stages that each read what the one before has kept.

Each stage takes (spark, docs, sf_dir) and works on all its input; the first four return the columns of documents,
the last one row of digests per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mostrador.llm import exact_dedup, mixing, near_dedup, quality
from mostrador.llm.common import stored, table
from mostrador.llm.queries import token_digests

#: Per cent of their shingles that texts share from which on the near-dedup stage keeps one of them.
NEAR = 80


def reject_unlike_trusted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the limit of their language under the n-gram model of the trusted ones."""
    return quality.kept_rows(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id."""
    return exact_dedup.without_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, from NEAR per cent of common shingles on, the one with the smallest doc_id."""
    return near_dedup.one_of_each(docs, NEAR)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of a stated part of the tokens that follows the target shares of sources, languages and lengths."""
    return mixing.sampled_rows(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's token ids, and of the text read back from them."""
    return token_digests(docs)


STAGES = [
    ("quality classifier", reject_unlike_trusted),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", tokenize),
]

#: SQL has neither the quality model nor the tokenizer; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
