"""Toxic documents and their offending sentences, learned from labels of whole documents.

A document is a bag of sentences. Each sentence has a probability of its own, and the document is toxic if any sentence
is: the noisy-or of all. The weights of words are fitted to document labels through that formula.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mostrador.llm.common import plain_text, stored

#: Labelled documents that are fitted to at most, and the documents a form must be in to get a weight. It needs a
#: G-squared of 25, which one unrelated form in a million reaches.
FITTED, LEAST_DOCUMENTS, LEAST_G2 = 16_000, 4, 25.0
#: Lengths of the word beginnings that count as forms, as stems do in inflected languages; words that a worker remembers.
STEMS, REMEMBERED = range(4, 9), 500_000
STEPS, RATE, RIDGE = 600, 0.1, 0.002
TOXIC_FROM, OFFENDING_FROM = 0.7, 0.5
WORD, SENTENCE = re.compile(r"[^\W\d_]+"), re.compile(r"[^.!?\n]+")


def held_out(doc_id: Column) -> Column:
    """Whether a document's label must not be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def forms(word: str) -> list[str]:
    """A word in lower case, marked as whole, and its beginnings."""
    return [f"={word}", *(word[:n] for n in STEMS if n < len(word))]


class Known(dict):
    """The numbers of each word's known forms, empty for most words."""

    def __init__(self, numbers: dict[str, int]):
        super().__init__()
        self.numbers = numbers

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = tuple(self.numbers[f] for f in forms(word) if f in self.numbers)
        return found


def sentences(text: str, known: Known) -> tuple[int, list[tuple[int, int, list[int]]]]:
    """How many sentences hold no known form, and start, end and known forms of each other one."""
    if len(text) < 1 << 20 and not any(map(known.__getitem__, WORD.findall(text.lower()))):
        return len(SENTENCE.findall(text)), []
    plain, found = 0, []
    for match in SENTENCE.finditer(text):
        ids = sorted({i for w in WORD.findall(match[0].lower()) for i in known[w]})
        if ids:
            found.append((match.start(), match.end(), ids))
        else:
            plain += 1
    return plain, found


@dataclass(frozen=True)
class Weights:
    """A fitted model: the forms, their weights and the common offset."""

    numbers: dict[str, int]
    of_form: np.ndarray
    offset: float

    def score(self, text: str, known: Known) -> tuple[float, list[dict]]:
        """The document's probability, and its offending sentences (start, end, score), counted in code points."""
        plain, found = sentences(text, known)
        # log(1 - p) of a sentence is minus softplus of its sum of weights
        clean = -plain * float(np.logaddexp(0, self.offset))
        offending = []
        for start, end, ids in found:
            z = self.offset + float(self.of_form[ids].sum())
            clean -= float(np.logaddexp(0, z))
            p = 1 / (1 + np.exp(-z))
            if p >= OFFENDING_FROM:
                offending.append({"start": start, "end": end, "score": float(p)})
        return -float(np.expm1(clean)), offending


def fit(labels: np.ndarray, plain: np.ndarray, bag: np.ndarray, times: np.ndarray, row: np.ndarray, form: np.ndarray,
        forms_: int) -> tuple[np.ndarray, float]:
    """Weights and offset that fit the document labels best, by gradient steps (Adam) with a small ridge.

    ``plain`` counts each document's sentences without known forms, ``bag`` has the document of each other sentence
    and ``times`` how often it has that sentence; ``row`` and ``form`` list the known forms of those sentences.
    """
    w, offset = np.zeros(forms_ + 1), np.log(0.5 / max(1.0, (plain.sum() + times.sum()) / max(1, len(labels))))
    w[-1] = offset
    first, second = np.zeros_like(w), np.zeros_like(w)
    n = max(1, len(labels))
    for step in range(1, STEPS + 1):
        z = w[-1] + np.bincount(row, w[form], len(bag))
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-w[-1]))
        clean = -np.bincount(bag, times * np.logaddexp(0, z), n) - plain * np.logaddexp(0, w[-1])
        # d loss / d z of a sentence is its p, times this factor of its document
        factor = np.where(labels > 0, 1 - 1 / np.maximum(-np.expm1(clean), 1e-12), 1.0)
        by_sentence = factor[bag] * p * times if len(bag) else np.empty(0)
        slope = np.append(np.bincount(form, by_sentence[row], forms_), by_sentence.sum() + (factor * plain).sum() * p0) / n
        slope[:-1] += RIDGE * w[:-1] / np.sqrt(n)
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope ** 2
        w -= RATE * first / (1 - 0.9 ** step) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-9)
        np.maximum(w[:-1], 0, out=w[:-1])  # forms speak for toxicity or not at all
    return w[:-1], float(w[-1])


def document_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(f, toxic) for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                 for f in {f for w in set(WORD.findall(text.lower())) for f in forms(w)}]
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.string()),
                                          pa.array([t for _, t in found], pa.int32())], names=["form", "toxic"])


def bags(numbers: dict[str, int]):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(numbers)
        for batch in batches:
            found = [sentences(t, known) for t in batch.column(0).to_pylist()]
            alike = [Counter(tuple(sorted(ids)) for _, _, ids in s) for _, s in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([n for n, _ in found], pa.int64()),
                 pa.array([[list(ids) for ids in c] for c in alike], pa.list_(pa.list_(pa.int32()))),
                 pa.array([list(c.values()) for c in alike], pa.list_(pa.int64()))],
                names=["toxic", "plain", "rows", "times"])
    return made


def train(docs: DataFrame, labels: DataFrame, fitted: int = FITTED) -> Weights:
    """A model of at most ``fitted`` labelled documents, drawn by a hash of doc_id, none of them held out.

    All forms that tell the labels apart get a weight. Only these forms come to the driver, and of each drawn document
    the distinct sets of known forms that its sentences have, with their counts; sentences without known forms are one
    number. Of rows that share a doc_id the one with the smallest text is fitted. Repeated labels of a document count
    as toxic when one does; NULL labels are no labels.
    """
    drawn = (labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fitted))
    sample = stored(docs.select("doc_id", plain_text("text").alias("text")).join(F.broadcast(drawn), "doc_id")
                    .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"))
    total = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = float(total.get(1, 0)), float(total.get(0, 0))
    counted = sample.mapInArrow(document_forms, "form string, toxic int").groupBy("form").agg(
        F.sum("toxic").cast("double").alias("a"), F.count("*").cast("double").alias("n")).where(F.col("n") >= LEAST_DOCUMENTS)
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    a, n, all_ = F.col("a"), F.col("n"), F.lit(max(1.0, bad + good))
    b, c, d = n - a, F.lit(bad) - a, F.lit(good) - (n - a)
    g2 = 2 * (part(a, n * bad / all_) + part(b, n * good / all_) + part(c, (all_ - n) * bad / all_) + part(d, (all_ - n) * good / all_))
    chosen = counted.withColumn("g2", g2).where(F.col("g2") >= LEAST_G2).where(F.col("a") * all_ > F.col("n") * bad).orderBy(F.col("g2").desc(), "form")
    numbers = {r.form: i for i, r in enumerate(chosen.select("form").collect())}
    rows = sample.mapInArrow(bags(numbers), "toxic int, plain bigint, rows array<array<int>>, times array<bigint>").collect()
    bag = np.array([i for i, r in enumerate(rows) for _ in r.rows], np.int64)
    times = np.array([n for r in rows for n in r.times], np.float64)
    lists = [ids for r in rows for ids in r.rows]
    row = np.array([i for i, ids in enumerate(lists) for _ in ids], np.int64)
    form = np.array([f for ids in lists for f in ids], np.int64)
    of_form, offset = fit(np.array([r.toxic for r in rows]), np.array([r.plain for r in rows], np.float64), bag, times, row,
                          form, len(numbers))
    return Weights(numbers, of_form, offset)


def scored(weights: Weights, name: str):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        known = Known(weights.numbers)
        for batch in batches:
            found = [weights.score(t, known) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p for p, _ in found], pa.float64()),
                                              pa.array([s for _, s in found], kind)], names=[name, "score", "offending"])
    return made


def score(docs: DataFrame, weights: Weights) -> DataFrame:
    """One row for each row of ``docs``: doc_id, score, offending (array of start, end, score of sentences).

    A sentence is a run without full stop, exclamation or question mark or line end. A NULL or empty text has no
    sentence and the score 0. Equal texts have equal scores; other columns are not looked at.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", plain_text("text").alias("text")).mapInArrow(
        scored(weights, "doc_id"), f"doc_id {kind}, score double, offending array<struct<start: bigint, end: bigint, score: double>>")
