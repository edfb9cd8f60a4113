"""Importance resampling towards a target: word runs hashed to buckets, gains of buckets, perturbed scores drawn."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from tokenizers import Regex, pre_tokenizers

from mostrador.llm.common import plain_text, stored

#: Numbers of consecutive words that make a feature, and buckets of features.
RUNS, BUCKETS = (1,), 10_000
#: Words a document must have to be drawn, and per cent of such documents that are.
LEAST_WORDS, DRAWN = 20, 10
SEED = "2024:"
#: What stands between words, once A-Z are in lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters given to the pre-tokenizer at once, and single words that a worker remembers.
PIECE, REMEMBERED = 1 << 20, 500_000


def pieces(text: str) -> Iterator[str]:
    """The text in parts of about PIECE characters that end where a word ends."""
    start = 0
    while len(text) - start > PIECE:
        end = start + PIECE
        while end < len(text) and (text[end] >= "\x80" or text[end].isalnum()):
            end += 1
        yield text[start:end]
        start = end
    yield text[start:]


class BucketOf(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = crc32(word.encode()) % self.buckets
        return found


class Features:
    """The buckets of a text's features, one for each, by an untrained pre-tokenizer that splits between words."""

    def __init__(self, runs: tuple[int, ...], buckets: int):
        self.split = pre_tokenizers.Split(Regex(BETWEEN), behavior="removed")
        self.runs, self.buckets, self.of_word = runs, buckets, BucketOf()
        self.of_word.buckets = buckets

    def __call__(self, text: str) -> tuple[int, np.ndarray]:
        """How many words the text has, and its buckets."""
        words, found, before = 0, [], []
        for piece in pieces(text.encode().lower().decode()):  # bytes: only A-Z change
            got = self.split.pre_tokenize_str(piece)
            words += len(got)
            if self.runs == (1,):
                found.append(np.fromiter(map(self.of_word.__getitem__, (w for w, _ in got)), np.int64, len(got)))
                continue
            # windows over the offsets; the last words of a piece also begin runs that end in the next one
            own = before + [piece[start:end] for _, (start, end) in got]
            for n in self.runs:
                first = max(0, len(before) - n + 1)
                found.append(np.array([crc32(" ".join(own[i:i + n]).encode()) % self.buckets
                                       for i in range(first, len(own) - n + 1)], np.int64))
            before = own[len(own) - max(self.runs) + 1:] if max(self.runs) > 1 else []
        return words, np.concatenate(found) if found else np.empty(0, np.int64)


def bucket_lists(runs: tuple[int, ...], buckets: int):
    """Texts to n_words, n_features and their buckets with counts."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(runs, buckets)
        for batch in batches:
            words, sizes, held, counts = [], [], [], []
            for text in batch.column(1).to_pylist():
                n, found = features(text)
                own, often = np.unique(found, return_counts=True)
                words.append(n)
                sizes.append(len(found))
                held.append(own.astype(np.int32))
                counts.append(often)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(held, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
                names=["doc_id", "n_words", "n_features", "buckets", "counts"])
    return made


def histogram(buckets: int):
    """All bucket lists of a task to one row for each bucket that occurs."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(total, batch.column("buckets").flatten().to_numpy(), batch.column("counts").flatten().to_numpy())
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])
    return made


def weighed(gains: np.ndarray):
    """Bucket lists to weights, the sums of their gains."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, counts = batch.column("buckets"), batch.column("counts")
            ends = np.cumsum(held.value_lengths().to_numpy())
            so_far = np.append(0, np.cumsum(gains[held.flatten().to_numpy()] * counts.flatten().to_numpy()))
            weight = so_far[ends] - so_far[np.append(0, ends[:-1])] if len(ends) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_words", "n_features")),
                                              pa.array(weight, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])
    return made


def lists_of(rows: DataFrame, key: str, text: str, runs: tuple[int, ...], buckets: int) -> DataFrame:
    kind = rows.schema[key].dataType.simpleString()
    return stored(rows.select(F.col(key).alias("doc_id"), plain_text(text).alias("text")).mapInArrow(
        bucket_lists(runs, buckets), f"doc_id {kind}, n_words bigint, n_features bigint, buckets array<int>, counts array<bigint>"))


def gains_of(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """What a feature of each bucket adds to a weight: a thousand times the log of how much likelier it is in the target."""
    counted = lambda lists, name: lists.select("buckets", "counts").mapInArrow(
        histogram(buckets), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias(name))
    both = counted(corpus, "s").join(counted(target, "t"), "bucket", "full")
    s, t = np.zeros(buckets), np.zeros(buckets)
    for row in both.collect():  # a row for each bucket at most
        s[row.bucket], t[row.bucket] = row.s or 0, row.t or 0
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def perturbation(doc_id: Column, seed: str) -> Column:
    """A whole number by which a score is moved: a thousand times a Gumbel variable that the digest of doc_id sets."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, n: int) -> DataFrame:
    """All rows with their rank by score, the smaller doc_id first among equals; NULL beyond ``n``.

    Rows are sorted by ranges of score and doc_id; the rows of the ranges before are counted, not moved.
    """
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), "n_features", "weight"]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = stored(rows.orderBy(*order).select("*", F.spark_partition_id().alias("range"), place.alias("place")))
    counted = placed.groupBy("range").agg(F.count("*").alias("n"))
    before = counted.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    rank = F.col("before") + F.col("place") + 1
    return placed.join(before, "range").withColumn("rank", F.when(rank <= n, rank)).drop("range", "place", "before")


def resample(docs: DataFrame, target: DataFrame, runs: tuple[int, ...] = RUNS, buckets: int = BUCKETS,
             least_words: int = LEAST_WORDS, part: int = DRAWN, seed: str = SEED) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_features, weight, score, rank.

    Features are all runs of so many consecutive words of a text as ``runs`` has, joined by one space and counted as
    often as they occur; words are runs of a-z, 0-9 and all beyond ASCII, A-Z in lower case. A weight is the sum of the
    gains of a text's features, a score the weight moved by :func:`perturbation`. Of the documents with at least
    ``least_words`` words ``part`` per cent, rounded down, are drawn: those with the highest scores, which have a rank.

    A NULL or empty text has no feature and the weight 0; a NULL doc_id is moved like an empty one and comes first among
    equal scores; rows that repeat a doc_id are documents of their own. Other columns are not looked at. ``target`` has
    a column text; without any text there all gains follow from the corpus alone.
    """
    corpus = lists_of(docs, "doc_id", "text", runs, buckets)
    gains = gains_of(corpus, lists_of(target.select("text").withColumn("doc_id", F.lit(0)), "doc_id", "text", runs, buckets), buckets)
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = stored(corpus.mapInArrow(weighed(gains), f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")
                    .withColumn("score", F.col("weight") + perturbation(F.col("doc_id"), seed)))
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * part // 100
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked(able, drawn).select(*out).unionByName(scored.where(F.col("n_words") < least_words).withColumn(
        "rank", F.lit(None).cast("long")).select(*out))
