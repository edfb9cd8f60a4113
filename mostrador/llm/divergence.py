"""Quality rules: counts of words, lines and symbols, and how far a text's histograms lie from those of its language.

A text's characters are counted by class and its words by the commonest words of its language. Both histograms are
compared with those of the trusted documents of the language by the Jensen-Shannon distance (base 2, so 0 to 1). Short
texts scatter, so limits allow for length, and below a length nothing is compared.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from mostrador.llm.common import by_ids, plain_text, stored

#: Words a document must have, and per cent of its words that may be repeated ones.
LEAST_WORDS, REPEATED_MOST, WIDTH = 10, 20, 5
#: Words from which on histograms are compared; words a language's trusted documents must have together.
COMPARED_FROM, TRUSTED_WORDS = 50, 1_000
#: Commonest words of a language that have a bar of their own, all others share one.
COMMON = 50
#: How far the histograms of a long text may lie from its language's: of common words beyond what drawing its words by
#: chance gives, of character classes beyond what a foreign passage (a name, an address, a key) of few words gives.
WORDS_BEYOND, CLASSES_BEYOND, PASSAGE = 0.12, 0.06, 4.0
#: The classes of characters.
LOWER, UPPER, LETTER, NUMBER, SPACE, POINT, PUNCTUATION, SYMBOL, OTHER = CLASSES = range(9)
POINTS, SYMBOLS, SPACES = frozenset(".,;:'\"()-"), frozenset("#*$%&|<>"), frozenset(" \t\n\x0b\f\r")
#: Words worked on at once, and words of one language that a task counts before it sends them on.
AT_ONCE, HELD = 200_000, 200_000


def class_of(char: str) -> int:
    kind = unicodedata.category(char)
    if char in SPACES or kind[0] == "Z":
        return SPACE
    if char in POINTS:
        return POINT
    if kind in ("Ll", "Lu", "Lt"):
        return LOWER if kind == "Ll" else UPPER
    return {"L": LETTER, "M": LETTER, "N": NUMBER, "P": PUNCTUATION, "S": SYMBOL}.get(kind[0], OTHER)


@lru_cache(1)
def class_table() -> np.ndarray:
    """The class of each code point, with 16 added for white space between words and 32 for the symbols counted."""
    return np.array([class_of(c) + 16 * (c in SPACES) + 32 * (c in SYMBOLS) for c in map(chr, range(0x110000))], np.uint8)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """The Jensen-Shannon distances of the rows of both, which are counts; 0 where a row is empty."""
    p, q = (x / np.maximum(x.sum(axis=1, keepdims=True), 1) for x in (counts, reference))
    middle = np.maximum((p + q) / 2, 1e-300)
    part = lambda x: (x * np.log2(np.maximum(x, 1e-300) / middle)).sum(axis=1)
    found = np.sqrt(np.maximum(0, (part(p) + part(q)) / 2))
    return np.where((counts.sum(axis=1) > 0) & (reference.sum(axis=1) > 0), found, 0.0)


def repeated(ids: np.ndarray, of: np.ndarray, docs: int) -> np.ndarray:
    """For each document how many of its words lie in a window of WIDTH words that it has twice or more.

    ``ids`` numbers the words, ``of`` has their document. Windows are numbered pair by pair, so equal numbers are equal
    windows.
    """
    number = lambda key: np.unique(key, return_inverse=True)[1]
    starts = len(ids) - WIDTH + 1
    if starts < 1:
        return np.zeros(docs, np.int64)
    most = int(ids.max()) + 1
    runs = number(of * most + ids)
    for i in range(1, WIDTH):
        runs = number(runs[:-1].astype(np.int64) * most + ids[i:])
    whole = of[:starts] == of[WIDTH - 1:]
    often = np.bincount(runs[whole], minlength=int(runs.max()) + 1)
    hit = np.zeros(len(ids) + 1, np.int64)
    twice = np.flatnonzero(whole & (often[runs] > 1))
    np.add.at(hit, twice, 1)
    np.add.at(hit, twice + WIDTH, -1)
    return np.bincount(of[np.cumsum(hit)[:-1] > 0], minlength=docs)


class Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def base_counts(texts: list[str], table: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """The counted columns of all texts, their class histograms, the distinct words, and each word's number and text."""
    n, numbers = len(texts), Numbers()
    words, classes, letters, symbols, lines = [], np.zeros((n, len(CLASSES)), np.int64), [], [], []
    for i, text in enumerate(texts):
        own = text.encode().split()  # bytes: only ASCII white space divides
        words.append(np.fromiter(map(numbers.__getitem__, own), np.int64, len(own)))
        found = np.bincount(table[code_points(text)], minlength=64)
        classes[i] = found.reshape(4, 16).sum(axis=0)[:len(CLASSES)]
        letters.append(len(text) - int(found[16:32].sum() + found[48:64].sum()))
        symbols.append(int(found[32:].sum()))
        held = [line for line in text.split("\n") if line.strip(" \t\x0b\f\r")]
        lines.append(len(held) - len(set(held)))
    sizes = np.array([len(w) for w in words], np.int64)
    ids, of = np.concatenate(words) if words else np.empty(0, np.int64), np.repeat(np.arange(n), sizes)
    counted = {"n_words": sizes, "word_chars": np.array(letters, np.int64), "n_symbols": np.array(symbols, np.int64),
               "n_dup_lines": np.array(lines, np.int64), "n_repeat_words": repeated(ids, of, n)}
    return counted, classes, list(numbers), ids, of


def in_parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts (from, to) of about AT_ONCE words, by their length."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text) // 6 + 1
        if held >= AT_ONCE:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def lower(word: bytes) -> str:
    return word.decode().lower()


def language_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their language to counts of words, of classes (word NULL) and of all words (class NULL, word NULL)."""
    table, held = class_table(), {}

    def sent() -> pa.RecordBatch:
        rows = [(*key, n) for key, n in held.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(
            (pa.string(), pa.string(), pa.int32(), pa.int64()))], names=["language", "word", "class", "n"])
    for batch in batches:
        texts, languages = batch.column("text").to_pylist(), batch.column("language").to_pylist()
        for start, end in in_parts(texts):
            _, classes, distinct, ids, of = base_counts(texts[start:end], table)
            groups, named = languages[start:end], sorted(set(languages[start:end]))
            group = np.array([named.index(x) for x in groups])
            for g, language in enumerate(named):
                for kind, n in enumerate(classes[group == g].sum(axis=0).tolist()):
                    held[language, None, kind] = held.get((language, None, kind), 0) + n
                own = np.bincount(ids[group[of] == g], minlength=len(distinct))
                held[language, None, None] = held.get((language, None, None), 0) + int(own.sum())
                for i in np.flatnonzero(own):
                    key = language, lower(distinct[i]), None
                    held[key] = held.get(key, 0) + int(own[i])
            if len(held) > HELD:
                yield sent()
    yield sent()


def references(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each language with enough trusted text: language, classes (counts), common (words), often (counts), n_words.

    Trusted are the documents that ``labels`` calls good and never bad. All their texts are counted.
    """
    good = stored(labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.min("quality").alias("quality")).where("quality = 1").select("doc_id"))
    texts = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("language"), plain_text("text").alias("text"))
    counted = stored(by_ids(texts, good, "left_semi").select("language", "text").mapInArrow(
        language_counts, "language string, word string, class int, n bigint").groupBy("language", "word", "class").agg(F.sum("n").alias("n")))
    place = F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), "word"))
    common = (counted.where("word is not null").withColumn("place", place).where(F.col("place") <= COMMON).groupBy("language")
              .agg(F.sort_array(F.collect_list(F.struct("place", "word", "n"))).alias("own")))
    classes = counted.where("class is not null").groupBy("language").agg(
        F.sort_array(F.collect_list(F.struct("class", "n"))).alias("bars"))
    total = counted.where("class is null and word is null").select("language", F.col("n").alias("n_words"))
    return total.where(F.col("n_words") >= TRUSTED_WORDS).join(common, "language").join(classes, "language").select(
        "language", "n_words", F.col("own.word").alias("common"), F.col("own.n").alias("often"), F.col("bars.n").alias("classes"))


def judged(name: str):
    """Texts beside their language's reference to the columns of :func:`quality_rules`."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = class_table(), {}
        for batch in batches:
            texts, languages = batch.column("text").to_pylist(), batch.column("language").to_pylist()
            for i, language in enumerate(languages):
                if language not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[language] = tuple(batch.column(c)[i].as_py() for c in ("common", "often", "classes", "all_words"))
            for start, end in in_parts(texts):
                counted, classes, distinct, ids, of = base_counts(texts[start:end], table)
                n, size = counted["n_words"], end - start
                by_word, of_word = np.zeros((size, COMMON + 1)), np.zeros((size, COMMON + 1))
                of_class, compared = np.zeros((size, len(CLASSES))), np.zeros(size, bool)
                own = np.array([*map(lower, distinct)], object)
                for language in set(languages[start:end]):
                    common, often, bars, all_words = known[language]
                    if common is None:
                        continue
                    rows = np.array([x == language for x in languages[start:end]])
                    places = dict(zip(common, range(COMMON)))
                    bar = np.fromiter((places.get(w, COMMON) for w in own), np.int64, len(own))
                    here = rows[of]
                    by_word += np.bincount(of[here] * (COMMON + 1) + bar[ids[here]], minlength=by_word.size).reshape(by_word.shape)
                    of_word[rows, :len(often)] = often
                    of_word[rows, COMMON] = all_words - sum(often)
                    of_class[rows] = bars
                    compared |= rows
                compared &= n >= COMPARED_FROM
                far_words, far_classes = distance(by_word, of_word), distance(classes, of_class)
                length = np.maximum(n, 1)
                # what a sample of so many words gives by chance: (bars - 1) / (8 n ln 2) is its mean divergence in bits
                words_most = WORDS_BEYOND + np.sqrt(COMMON / (8 * np.log(2) * length))
                classes_most = CLASSES_BEYOND + np.sqrt(PASSAGE / length)
                failed = (n < LEAST_WORDS) | (100 * counted["n_repeat_words"] > REPEATED_MOST * n)
                unlike = compared & ((far_words > words_most) | (far_classes > classes_most))
                shown = [pa.array(np.where(compared, x, np.nan), from_pandas=True) for x in (far_words, far_classes)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(name).slice(start, size), *map(pa.array, counted.values()), pa.array(failed),
                     pa.array(~failed & ~unlike), *shown],
                    names=[name, *counted, "base_failed", "kept", "word_distance", "class_distance"])
    return made


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, word_distance, class_distance.

    Words stand between ASCII white space. ``n_dup_lines`` counts lines with a word that are equal to an earlier one,
    ``n_repeat_words`` the words in windows of WIDTH words that the text has twice or more. The base rules refuse texts
    with fewer than LEAST_WORDS words or more than REPEATED_MOST per cent repeated ones. Of the others, those of at least
    COMPARED_FROM words whose language has a reference stay if both distances are within the limits for their length.

    A NULL or empty text has no words and fails the base rules. A NULL lang is a language of its own; a language with too
    few trusted words has no reference, and its texts no distances. Rows that repeat a doc_id are judged one by one, and
    copies are judged alike. Other columns are not looked at.
    """
    field = docs.schema["doc_id"].dataType
    rows = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("language"), plain_text("text").alias("text"))
    # a row for each language, with a bounded list: Spark sends it along where it is small
    beside = rows.join(stored(references(docs, labels)).withColumnRenamed("n_words", "all_words"), "language", "left")
    counts = ", ".join(f"{c} bigint" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    return beside.mapInArrow(judged("doc_id"),
                             f"doc_id {field.simpleString()}, {counts}, base_failed boolean, kept boolean, "
                             "word_distance double, class_distance double")

