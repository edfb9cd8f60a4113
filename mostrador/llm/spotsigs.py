"""SpotSigs fingerprints: chains of content words that follow common words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from mostrador.llm.common import components, plain_text, stored, text_partitions
from mostrador.llm.near_dedup import links

#: The most common words of English, German, French and Spanish, which serve as anchors.
ANCHORS = frozenset((
    "the of and a to in is was for on that by with from or an be this it are at "
    "der die das und ein eine zu mit von den ist im des auf nicht für "
    "le la les un une et de du en que est dans pour sur "
    "el los las y del al por con para su se lo").split())
#: Content words of a chain, and signatures below which every word of a text serves as an anchor.
CHAIN, FEW = 3, 4
#: Per cent of the union that two sets of signatures must share to be near duplicates.
SHARE = 80
REMEMBERED = 500_000
WORD = re.compile(r"\w+")
STEP = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """A hash of each word, odd for anchors."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) >> 1 << 1
        self[word] = found = found | (word in ANCHORS)
        return found


def chains(anchors: np.ndarray, content: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Signatures of the anchors (places) that CHAIN content words follow."""
    following = np.searchsorted(content, anchors, "right")
    anchors, following = anchors[following + CHAIN <= len(content)], following[following + CHAIN <= len(content)]
    run = hashes[anchors]
    for i in range(CHAIN):
        run = run * STEP + hashes[content[following + i]]
    return (run ^ (run >> np.uint64(29))) * STEP >> np.uint64(32)


def signatures(text: str, words: Words) -> frozenset[int]:
    """The set of a text's signatures as 32-bit hashes.

    A text with fewer than FEW of them also has those in which any word is an anchor, and one too short for a chain has
    one signature of all its words; only a text without words has none.
    """
    found = WORD.findall(text.lower())
    if not found:
        return frozenset()
    hashes = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    common = (hashes & np.uint64(1)).astype(bool)
    out = chains(np.flatnonzero(common), np.flatnonzero(~common), hashes)
    if len(out) < FEW:
        places = np.arange(len(found))
        out = np.append(out, chains(places, places, hashes))
    if not len(out):
        run = np.uint64(len(found))
        for h in hashes:
            run = np.uint64((int(run) * int(STEP) + int(h)) & 0xFFFFFFFFFFFFFFFF)
        out = np.array([run >> np.uint64(32)])
    return frozenset(out.tolist())


def written(found: frozenset[int]) -> str:
    """A fingerprint as text: the sorted signatures, eight hexadecimal digits each."""
    return np.array(sorted(found), ">u4").tobytes().hex()


def read(fingerprint: str) -> frozenset[int]:
    return frozenset(np.frombuffer(bytes.fromhex(fingerprint), ">u4").tolist())


def likeness(a: frozenset[int], b: frozenset[int], least: float = 0.0) -> float:
    """The Jaccard similarity, or 0 where it is below ``least``; sets whose lengths already say so are not compared.

    Two empty sets are alike, an empty and another one are not.
    """
    if len(a) > len(b):
        a, b = b, a
    if not b:
        return 1.0
    if not a or len(a) < least * len(b):
        return 0.0
    common = len(a & b)
    found = common / (len(a) + len(b) - common)
    return found if found >= least else 0.0


def edited(text: str, following: str) -> str:
    """``text`` with its second half replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def deal(bounds: np.ndarray):
    """Rows to their range of doc; the first document of a range goes to the range before as well, as a guest."""
    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = len(bounds) - 1
        for batch in batches:
            doc = batch.column("doc").to_numpy()
            own = np.maximum(np.searchsorted(bounds, doc, "right") - 1, 0)
            guests = np.flatnonzero(doc == bounds[own])
            rows = pa.array(np.append(np.arange(len(doc)), guests))
            to = np.append(own, np.where(own[guests] > 0, own[guests] - 1, last))
            guest = np.append(np.zeros(len(doc), bool), np.ones(len(guests), bool))
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(guest), *(c.take(rows) for c in batch.columns)],
                                             names=["part", "guest", *batch.schema.names])
    return dealt


def beside_next(kind: pa.DataType):
    """Sorted rows to fingerprints: each document waits for the one after it."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, waiting, part = Words(), None, None
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for batch in batches:
            rows = []
            for to, guest, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "guest", "doc_id", "text"))):
                if to != part:
                    waiting, part, closed = None, to, False
                if closed:
                    continue
                found = signatures(text, words)
                if waiting:
                    own_id, own_text, own = waiting
                    new = edited(own_text, text)
                    new_found = signatures(new, words)
                    rows.append((own_id, len(own_text), sha256(new.encode()).hexdigest(), written(own), written(new_found),
                                 likeness(own, new_found), likeness(own, found)))
                waiting, closed = (doc_id, text, found), guest
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=names)
    return made


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next.

    The next document is the one with the next doc_id, after the last the first; the edited text is :func:`edited`. A
    NULL text is empty, a NULL doc_id comes first; rows that share a doc_id are ordered by text. A single document is
    its own next. Texts are dealt out once, by ranges of doc_id; only the first document of a range travels twice.
    Other columns are not looked at.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    field = docs.schema["doc_id"].dataType
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"),
                       plain_text("text").alias("text"))
    parts = text_partitions(docs)
    cuts = rows.agg(F.percentile_approx("doc", [i / parts for i in range(parts)], F.lit(max(10_000, 100 * parts))).alias("cuts"),
                    F.min("doc").alias("first")).first()
    bounds = np.unique(np.array([cuts.first, *cuts.cuts] if cuts.cuts else [0], np.int64))
    name = field.simpleString()
    return (rows.mapInArrow(deal(bounds), f"part bigint, guest boolean, doc_id {name}, doc bigint, text string")
            .repartition("part").sortWithinPartitions("part", "guest", "doc", "text")
            .mapInArrow(beside_next(to_arrow_type(field)), f"doc_id {name}, n_chars bigint, edited_sha256 string, fingerprint string, "
                        "edited_fingerprint string, near_edited double, near_next double"))


def signature_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for batch in batches:
        found = [sorted(signatures(t, words)) for t in batch.column(1).to_pylist()]
        digests = [blake2b(np.array(f, "<u4").tobytes(), digest_size=16).digest() if f else None for f in found]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(map(len, found), pa.int64()),
                                          pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "digest", "size", "members"])


def postings(sets: DataFrame, share: int) -> DataFrame:
    """Rows (node, central, token): each set under its rarest signatures, in its partition by length and the next.

    Lengths of sets that share ``share`` per cent differ by a factor of 100 / share at most, the ratio of one partition
    to the next, so such sets meet. They share one of the signatures posted, those that come first by frequency.
    """
    held = sets.select("node", F.explode("members").alias("signature"))
    common = held.groupBy("signature").agg(F.count("*").alias("n")).where("n > 1")
    ranked = held.join(common, "signature").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "signature"))).alias("values"))
    first = F.col("size") - F.ceil(F.col("size") * share / 100) + 1
    kept = F.greatest(first - (F.col("size") - F.size("values")), F.lit(0)).cast("int")
    length = F.floor(F.log("size") / F.log(F.lit(100 / share)))
    posted = ranked.join(sets.select("node", "size"), "node").select(
        "node", (F.col("size") - F.size("values")).alias("central"), length.alias("length"),
        F.explode(F.slice("values", F.lit(1), kept)).alias("value"))
    return posted.select("node", "central", F.explode(F.array("length", F.col("length") + 1)).alias("part"), "value.signature").select(
        "node", "central", F.xxhash64("part", "signature").alias("token"))


def near_groups(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_signatures, component_id (the smallest doc_id that hangs together).

    Texts with one and the same set are one node. Sets are compared through :func:`postings`, pruned by what they can
    still share, and linked from ``share`` per cent on. A text without signatures is linked with nothing; a NULL doc_id
    counts in no minimum; other columns are not looked at.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stored(docs.select("doc_id", plain_text("text").alias("text")).mapInArrow(
        signature_sets, f"doc_id {kind}, digest binary, size bigint, members array<bigint>"))
    sets = stored(rows.where("digest is not null").groupBy("digest").agg(
        F.any_value("size").alias("size"), F.any_value("members").alias("members")).withColumn("node", F.monotonically_increasing_id()))
    found = stored(links(stored(postings(sets, share)), None, sets.select("node", "size", "members"), share))
    labels = components(found)
    of_digest = sets.select("digest", "node").join(labels, "node", "left").select(
        "digest", F.coalesce("component", "node").alias("component"))
    grouped = rows.select("doc_id", "size", "digest").join(of_digest, "digest", "left")
    first = grouped.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return grouped.join(first, "component", "left").select(
        "doc_id", F.col("size").alias("n_signatures"), F.coalesce("component_id", "doc_id").alias("component_id"))
