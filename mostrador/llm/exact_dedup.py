"""Exact duplicates by content-defined chunk recipes. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mostrador.llm.common import plain_text, stored

#: A chunk ends with the first sentence or line end after CHUNK_LEAST characters, at CHUNK_MOST at the latest.
CHUNK_LEAST, CHUNK_MOST = 256, 4096


def chunks(text: Column) -> Column:
    """The text cut into content-defined chunks, in order; joined they give the text again. An empty text has none."""
    rule = rf"(?s).{{{CHUNK_LEAST},{CHUNK_MOST}}}?(?:[.!?\n]+\s*|\z)|.{{1,{CHUNK_MOST}}}"
    return F.regexp_extract_all(text, F.lit(rule), F.lit(0))


def ambiguous_chunks(docs: DataFrame, column: str = "text") -> DataFrame:
    """Chunk identifiers (id) that stand for more than one chunk text.

    Every chunk text of the corpus is compared with the others of its identifier. Equal chunks meet before the
    shuffle, so a passage in a third of all rows costs one row for each map task.
    """
    pieces = docs.select(F.explode(chunks(plain_text(column))).alias("chunk"))
    texts = pieces.groupBy(F.xxhash64("chunk").alias("id")).agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
    return texts.where("low <> high").select("id")


def duplicate_groups(docs: DataFrame, column: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical (NULL counts as empty). A recipe is the ordered list of a text's chunk
    identifiers; as these are verified, equal recipes are equal texts, and only recipes travel. A recipe with an
    ambiguous identifier is told apart by its text's digest as well. The row with the largest doc_id stays, NULL
    being smallest. Rows that repeat both doc_id and text are one document: they give one row and count singly in
    group_size. Rows with one doc_id and different texts are different documents. No rows give no rows; other
    columns are not looked at.
    """
    recipes = stored(docs.select(
        "doc_id", F.transform(chunks(plain_text(column)), lambda c: F.xxhash64(c)).alias("recipe"),
        F.sha2(plain_text(column), 256).alias("text_sha256")).groupBy("doc_id", "recipe", "text_sha256").agg(
        F.count(F.lit(1)).alias("rows")))
    ambiguous = stored(ambiguous_chunks(docs, column))
    unsure = (recipes.select("recipe", F.explode("recipe").alias("id")).join(ambiguous, "id", "left_semi")
              .select("recipe").distinct().withColumn("unsure", F.lit(True)))
    keyed = recipes.join(unsure, "recipe", "left").withColumn(
        "proof", F.when(F.col("unsure"), F.col("text_sha256")).otherwise(F.lit("")))
    groups = keyed.groupBy("recipe", "proof").agg(F.max("doc_id").alias("keep_id"), F.sum("rows").alias("group_size"))
    return keyed.join(groups, ["recipe", "proof"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows with equal doc_id and text any one."""
    kept = duplicate_groups(docs).where("kept").select("doc_id", "text_sha256")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("of"), F.sha2(plain_text("text"), 256).alias("sha"))
    same = F.col("sha").eqNullSafe(F.col("text_sha256")) & F.col("of").eqNullSafe(F.col("doc_id"))
    return rows.join(kept, same, "left_semi").dropDuplicates(["of", "sha"]).select("row.*")
