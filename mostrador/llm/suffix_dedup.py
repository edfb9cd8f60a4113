"""Removal of byte strings that occur before, found exactly.

Every string of LENGTH bytes is dealt out by one of its K-grams, that of the smallest hash; equal strings choose
the same one. Neighbouring strings with one choice are one segment. Equal segments are settled by their digests, 128
bits of BLAKE2b. Only segments that share the K-gram and differ elsewhere need their bytes compared: they are brought
together in shards, each sorted by a two-stage suffix array, and neighbours with a common prefix of LENGTH bytes are
equal strings. A K-gram with too many segments for a shard is parted by the bytes around it first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from mostrador.llm.common import plain_text, stored

LENGTH, K = 100, 24
#: K-grams of a string; the choice among them changes about every 40 bytes.
CHOICES = LENGTH - K + 1
#: Bytes looked at together in a task, bytes of segments in a shard, and segments of one K-gram that are sorted in one
#: shard; more are parted by further bytes.
AT_ONCE, SHARD_BYTES, SORTED_MOST = 4 << 20, 2 << 20, 20_000
PLACE_BITS = np.uint64(24)
HALVED = ["gram", "doc", "place", "n", "body", "at", "low", "high"]


def mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (32, 0xD6E8FEB86659FD93)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the K = 16 + 8 bytes at each place."""
    base, run, width, eight = np.uint64(0x9E3779B97F4A7C15), data.astype(np.uint64) + np.uint64(1), 1, None
    with np.errstate(over="ignore"):
        while width < 16:
            run = run[:-width] * base + run[width:]
            base, width = base * base, 2 * width
            if width == 8:
                eight = run
        return mixed(run[:len(data) - K + 1] * base + eight[16:16 + len(data) - K + 1])


def choices(hashes: np.ndarray) -> np.ndarray:
    """For the string at each place the place of its K-gram with the smallest hash, the leftmost of equal ones."""
    places = np.arange(len(hashes), dtype=np.uint64)
    least, width = (hashes >> PLACE_BITS << PLACE_BITS) | places, 1
    while width * 2 <= CHOICES:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:len(least) - (CHOICES - width)], least[CHOICES - width:])
    return (least & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)


def pieces(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Bunches of (text number, start, bytes); a very long text comes in parts that overlap by LENGTH - 1 bytes."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for start in range(0, max(1, len(text) - LENGTH + 1), AT_ONCE):
            part = text[start:start + AT_ONCE + LENGTH - 1] if len(text) > AT_ONCE else text
            if len(part) >= LENGTH:
                held.append((i, start, part))
                size += len(part)
            if size >= AT_ONCE:
                yield held
                held, size = [], 0
    if held:
        yield held


def cut(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Segments of all texts: text number, start, number of strings, K-gram hash, two halves of a digest of the bytes."""
    found = []
    for bunch in pieces(texts):
        body = b"".join(p for _, _, p in bunch)
        hashes = gram_hashes(np.frombuffer(body, np.uint8))
        chosen = choices(hashes)
        lengths = np.array([len(p) for _, _, p in bunch])
        offsets = np.cumsum(lengths) - lengths
        inside = np.zeros(len(body) + 1, np.int64)
        inside[offsets] += 1
        inside[offsets + lengths - LENGTH + 1] -= 1
        at = np.flatnonzero(np.cumsum(inside)[:len(chosen)])  # where strings start that lie within one text
        owner = np.searchsorted(offsets, at, "right") - 1
        new = np.append(True, (chosen[at[1:]] != chosen[at[:-1]]) | (owner[1:] != owner[:-1]))
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(at)))
        begin, owner = at[first], owner[first]
        digests = np.frombuffer(b"".join([blake2b(body[b:e], digest_size=16).digest() for b, e in zip(
            begin.tolist(), (begin + many + LENGTH - 1).tolist())]), np.int64)
        numbers, starts = (np.array([p[j] for p in bunch], np.int64) for j in (0, 1))
        found.append((numbers[owner], begin - offsets[owner] + starts[owner], many,
                      hashes[chosen[begin]].view(np.int64), digests[::2], digests[1::2]))
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(6))
    return tuple(np.concatenate(c) for c in zip(*found))


def runs(doc: np.ndarray, place: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings (doc, place, how many in a row) with those that follow one another joined."""
    order = np.lexsort((place, doc))
    doc, place, n = doc[order], place[order], n[order]
    if not len(doc):
        return doc, place, n
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + n[:-1])))
    return doc[first], place[first], np.add.reduceat(n, first)


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (gram, digest, more, doc, place, n, known): segments, and strings known to occur before (known).

    Of equal segments of a batch only the first goes on, so a passage in a third of all texts costs one row a batch.
    """
    for batch in batches:
        number, start, n, gram, digest, more = cut([t.encode() for t in batch.column(2).to_pylist()])
        doc = batch.column(0).to_numpy()[number] if len(number) else number
        place = (batch.column(1).to_numpy().astype(np.int64)[number] << 32 if len(number) else number) + start
        order = np.lexsort((place, doc, more, digest, gram))
        gram, digest, more, doc, place, n = (x[order] for x in (gram, digest, more, doc, place, n))
        first = np.append(True, (gram[1:] != gram[:-1]) | (digest[1:] != digest[:-1]) | (more[1:] != more[:-1]))[:len(gram)]
        leader = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
        later = (doc != doc[leader]) | (place != place[leader])
        old = runs(doc[later], place[later], n[later])
        known = np.repeat([False, True], [int(first.sum()), len(old[0])])
        columns = [np.concatenate([gram[first], old[1]]), np.concatenate([digest[first], old[0]]),
                   np.concatenate([more[first], old[1]]), np.concatenate([doc[first], old[0]]), np.concatenate([place[first], old[1]]),
                   np.concatenate([n[first], old[2]]).astype(np.int32), known]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns],
                                         names=["gram", "digest", "more", "doc", "place", "n", "known"])


def two_stage(data: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The suffixes of ``data`` in the order of their first LENGTH bytes; ``word`` has the eight bytes at each place.

    Suffixes smaller than their successor are sorted directly. A scan of the buckets of first bytes, from the smallest
    on, puts the others in place: each sorted suffix tells that the one that starts a byte before comes next in its
    bucket.
    """
    n = len(data)
    step = np.sign(np.diff(data.astype(np.int16), append=-1))
    decided = np.where(step != 0, np.arange(n), n)
    following = np.minimum.accumulate(decided[::-1])[::-1]
    small = step[following] > 0
    order = np.flatnonzero(small)
    rank = np.unique(word, return_inverse=True)[1].astype(np.uint64)
    bits = max(1, int(rank.max()).bit_length())
    # Groups of equal beginnings are split by as many further words as fit, with the group, into one number.
    group, depth, which = np.zeros(len(order), np.int64), 0, np.arange(len(order))
    while depth < LENGTH and len(which):
        place, keys = order[which], group[which].astype(np.uint64)
        words = max(1, (64 - len(order).bit_length()) // bits)
        for _ in range(words):
            if depth < LENGTH:
                keys = keys << np.uint64(bits) | rank[place + depth]
                depth += 8
        sorted_ = np.argsort(keys)
        order[which] = place[sorted_]
        keys = keys[sorted_]
        first = np.append(True, keys[1:] != keys[:-1])
        group[which] = which[np.maximum.accumulate(np.where(first, np.arange(len(which)), 0))]
        tied = ~first
        tied[:-1] |= ~first[1:]
        which = which[tied]
    ends = np.searchsorted(data[order], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n:
        waiting[data[n - 1]].append(np.array([n - 1]))
    out = []
    for byte in range(256):
        here, fresh = [], np.concatenate(waiting[byte]) if waiting[byte] else np.empty(0, np.int64)
        while len(fresh):  # runs of one byte lead to places in the same bucket
            here.append(fresh)
            before = fresh[fresh > 0] - 1
            fresh = before[(data[before] == byte) & ~small[before]]
        here.append(order[ends[byte]:ends[byte + 1]])
        bucket = np.concatenate(here)
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(data[before] > byte) & ~small[before]]
        if len(before):
            by_byte = before[np.argsort(data[before], kind="stable")]
            cuts = np.flatnonzero(np.diff(data[by_byte])) + 1
            for part in np.split(by_byte, cuts):
                waiting[data[part[0]]].append(part)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def repeated_strings(bodies: list[bytes], doc: np.ndarray, place: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Strings (doc, place, how many in a row) of these segments that occur before in another or the same one.

    A segment that is given twice does not come before itself.
    """
    data = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8)
    padded = np.append(data, np.zeros(LENGTH + 20, np.uint8)).astype(np.uint64)
    word = padded[:-7] << np.uint64(56)
    for i in range(1, 8):
        word = word | padded[i:len(padded) - 7 + i] << np.uint64(56 - 8 * i)
    lengths = np.array([len(b) + 1 for b in bodies])
    offsets = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(bodies), dtype=np.int32), lengths)
    inside = np.arange(len(data)) - offsets[owner]
    ordered = two_stage(data, word)
    ordered = ordered[(inside < n[owner])[ordered]]
    owner, inside = owner[ordered], inside[ordered]
    same = np.ones(max(0, len(ordered) - 1), bool)
    for depth in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        same[same] = word[ordered[:-1][same] + depth] == word[ordered[1:][same] + depth]
    group = np.cumsum(np.append(0, ~same))[:len(ordered)]
    doc, place = doc[owner], place[owner] + inside
    order = np.lexsort((place, doc, group))
    group, doc, place = group[order], doc[order], place[order]
    first = np.append(True, group[1:] != group[:-1])[:len(group)]
    leader = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    later = (doc != doc[leader]) | (place != place[leader])
    return runs(doc[later], place[later], np.ones(int(later.sum()), np.int64))


def sort_shard(key: tuple, rows: pa.Table) -> pa.Table:
    doc, place, n = (rows.column(c).to_numpy().astype(np.int64) for c in ("doc", "place", "n"))
    found = repeated_strings(rows.column("body").to_pylist(), doc, place, n)
    return pa.Table.from_arrays([pa.array(found[0]), pa.array(found[1]), pa.array(found[2].astype(np.int32))],
                                names=["doc", "place", "n"])


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of wanted segments: rows (gram, doc, place, n, body)."""
    for batch in batches:
        for i in range(batch.num_rows):
            text, wanted = batch.column("text")[i].as_py().encode(), batch.column("wanted")[i].as_py()
            starts = [w["place"] & 0xFFFFFFFF for w in wanted]
            yield pa.RecordBatch.from_arrays([
                pa.array([w["gram"] for w in wanted], pa.int64()),
                pa.array([batch.column("doc")[i].as_py()] * len(wanted), pa.int64()),
                pa.array([w["place"] for w in wanted], pa.int64()), pa.array([w["n"] for w in wanted], pa.int32()),
                pa.array([text[s:s + w["n"] + LENGTH - 1] for s, w in zip(starts, wanted)], pa.binary())],
                names=["gram", "doc", "place", "n", "body"])


def without_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, n_bytes, removed, kept): the joined spans that go and the bytes that stay."""
    for batch in batches:
        sizes, removed, kept = [], [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            raw, end, out, gone = text.encode(), 0, [], []
            for begin, stop in sorted(((s["place"] & 0xFFFFFFFF, (s["place"] & 0xFFFFFFFF) + s["n"] + LENGTH - 1)
                                       for s in spans or ())):
                if gone and begin <= gone[-1][1]:
                    gone[-1] = (gone[-1][0], max(gone[-1][1], stop))
                else:
                    gone.append((begin, stop))
            for begin, stop in gone:
                out.append(raw[end:begin])
                end = stop
            out.append(raw[end:])
            sizes.append(len(raw))
            removed.append([{"start": b, "end": e} for b, e in gone])
            kept.append(b"".join(out))
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(span)), pa.array(kept, pa.binary())],
            names=["doc_id", "n_bytes", "removed", "kept"])


def told_apart(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, doc, tag, text). The tag is 0, but for rows that share a doc_id: these get a digest of the text."""
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"),
                       plain_text("text").alias("text"))
    shared = rows.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc", F.lit(True).alias("shared"))
    if shared.isEmpty():
        return rows.withColumn("tag", F.lit(0).cast("int"))
    digest = F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    return rows.join(shared, "doc", "left").select("doc_id", "doc", "text", F.when(
        F.col("shared"), digest).otherwise(F.lit(0)).cast("int").alias("tag"))


def by_document(rows: DataFrame, name: str, *fields: str) -> DataFrame:
    tag = F.shiftright("place", 32).cast("int")
    return rows.groupBy("doc", tag.alias("tag")).agg(F.collect_list(F.struct(*fields)).alias(name))


def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments (HALVED) whose strings start ``low`` to ``high`` - 1 bytes before the K-gram, each in two: the strings
    that start farther before it and those that start nearer.

    Fewer such starts have more bytes in common, around the K-gram and including it; the new ``gram`` is a hash of
    these. Equal strings start equally far before their K-gram and so stay together. ``at`` is the place of the K-gram
    in the segment, if known.
    """
    for batch in batches:
        out = []
        for gram, doc, place, n, body, at, low, high in zip(*(c.to_pylist() for c in batch.columns)):
            at = int(choices(gram_hashes(np.frombuffer(body, np.uint8)))[0]) if at is None else at
            for near, far in ((low, (low + high) // 2), ((low + high) // 2, high)):
                begin, end = max(0, at - far + 1), min(n, at - near + 1)
                if begin < end:
                    key = xxhash.xxh3_64_intdigest(body[at - near:at - far + LENGTH + 1], near * LENGTH + far)
                    out.append((key - (1 << 63), doc, place + begin, end - begin, body[begin:end + LENGTH - 1], at - begin, near, far))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * len(kinds), kinds)], names=HALVED)


def crowded(segments_: DataFrame) -> DataFrame:
    return stored(segments_.groupBy("gram").agg(F.count("*").alias("segments")).where(f"segments > {SORTED_MOST}").select("gram"))


def parted(bodies: DataFrame, many: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``bodies`` so that no gram has more than SORTED_MOST segments, and the strings (doc, place, n) found on the way.

    The segments of the grams ``many`` are halved until they are few enough under what their strings have in common;
    of equal halves, compared byte by byte, the first one goes on. Halves of one string that have the same bytes in
    common are equal, so this ends.
    """
    few, settled = bodies.join(many, "gram", "left_anti"), []
    rest = bodies.join(many, "gram", "left_semi").select("*", F.lit(None).cast("int").alias("at"), F.lit(0).alias("low"), F.lit(CHOICES).alias("high"))
    while not many.isEmpty():
        half = stored(rest.mapInArrow(halves, "gram bigint, doc bigint, place bigint, n int, body binary, at int, low int, high int"))
        first = half.groupBy("gram", "body").agg(F.min(F.struct("doc", "place")).alias("first"))
        half = stored(half.join(first, ["gram", "body"]).withColumn("old", F.struct("doc", "place") != F.col("first")).select(*HALVED, "old"))
        settled.append(half.where("old").select("doc", "place", "n"))
        open_ = half.where("not old").drop("old")
        many = crowded(open_)
        few = few.union(open_.join(many, "gram", "left_anti").select(*few.columns))
        rest = open_.join(many, "gram", "left_semi").select(*HALVED)
    return few, reduce(DataFrame.union, settled) if settled else None


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, removed (array of start, end), kept (the bytes that stay).

    A byte goes when a string of LENGTH bytes that covers it also starts earlier: in a document with a smaller doc_id
    or farther ahead in the same one, in the input as it is. Strings do not cross documents. A NULL text is empty; a
    NULL doc_id is smaller than all others. Rows that share a doc_id are documents of their own in the order of a
    digest of their texts; rows equal in both are one document, which is given back as often. Other columns are not
    looked at. Spans and bytes of one document must fit in one row.
    """
    rows = told_apart(docs)
    found = rows.select("doc", "tag", "text").mapInArrow(
        segments, "gram bigint, digest bigint, more bigint, doc bigint, place bigint, n int, known boolean").repartition("gram")
    same = Window.partitionBy("gram", "known", "digest", "more").orderBy("doc", "place")
    any_ = Window.partitionBy("gram", "known")
    first = F.first(F.struct("doc", "place")).over(same)
    mixed_ = (F.min("digest").over(any_) != F.max("digest").over(any_)) | (F.min("more").over(any_) != F.max("more").over(any_))
    flagged = found.withColumns({"old": F.col("known") | (first != F.struct("doc", "place"))}).withColumn("mixed", mixed_)
    flagged = stored(flagged.where("old or mixed").select("gram", "doc", "place", "n", "old"))
    settled, open_ = flagged.where("old").select("doc", "place", "n"), flagged.where("not old").drop("old")
    size = open_.agg(F.sum(F.col("n") + LENGTH).alias("bytes")).first().bytes or 0
    shards = int(size // SHARD_BYTES) + 1
    many = crowded(open_)
    bodies = rows.join(by_document(open_, "wanted", "gram", "place", "n"), ["doc", "tag"]).select("doc", "text", "wanted").mapInArrow(
        cut_out, "gram bigint, doc bigint, place bigint, n int, body binary")
    few, found_before = (bodies, None) if many.isEmpty() else parted(stored(bodies), many)
    repeats = few.groupBy(F.pmod("gram", F.lit(shards)).alias("shard")).applyInArrow(
        sort_shard, "doc bigint, place bigint, n int")
    spans = settled.union(repeats) if found_before is None else settled.union(repeats).union(found_before)
    whole = rows.join(by_document(spans, "spans", "place", "n"), ["doc", "tag"], "left")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return whole.select("doc_id", "text", "spans").mapInArrow(
        without_spans, f"doc_id {kind}, n_bytes bigint, removed array<struct<start: bigint, end: bigint>>, kept binary")
