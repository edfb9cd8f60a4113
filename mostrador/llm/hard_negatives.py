"""Hard negatives by exact integer inner products, several candidates to one wide integer.

Components are whole numbers. Biased so that none is negative, the components of several candidates lie side by side in
separate fields of one integer; one multiplication by an anchor's component serves them all, and the sums of the
products are read off the fields. The fields are as wide as the largest sum asks for, so nothing is rounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from mostrador.llm.common import stored

#: What a component is multiplied by before it is rounded down.
SCALE = 256
#: Positives of an anchor, and negatives of each positive; per cents of the positive's score between which these lie.
POSITIVES, NEGATIVES, LEAST, MOST = 5, 10, 30, 90
#: Rows held by a task as candidates, and anchors compared with them at once.
CANDIDATES, ANCHORS = 4096, 128
#: Bits of a machine word, and of the integers used where two fields do not fit into one.
WORD, WIDE = 64, 1024


def inner_products(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """The exact inner products of all ``anchors`` and ``candidates`` (rows of int64), which must fit into 64 bits."""
    n = len(candidates)
    low_a, low_c = anchors.min(axis=0), candidates.min(axis=0)
    a, c = anchors - low_a, candidates - low_c
    largest = sum(int(x) * int(y) for x, y in zip(a.max(axis=0), c.max(axis=0)))
    width = max(1, largest.bit_length())
    kind, bits = (np.uint64, WORD) if 2 * width <= WORD else (object, WIDE)
    fields = max(1, min(bits // width, n))
    rows = -(-n // fields)
    side_by_side = np.zeros((fields, rows, c.shape[1]), np.int64)
    side_by_side.reshape(fields * rows, -1)[:n] = c
    packed = np.zeros((rows, c.shape[1]), kind)
    for i in range(fields):
        packed |= side_by_side[i].astype(kind) << kind(i * width) if kind is np.uint64 else side_by_side[i].astype(object) << i * width
    sums = a.astype(kind) @ packed.T
    mask = (1 << width) - 1
    read = [sums >> (np.uint64(i * width) if kind is np.uint64 else i * width) for i in range(fields)]
    read = [(x & np.uint64(mask)).astype(np.int64) if kind is np.uint64 else
            (x & (mask & (1 << WORD) - 1)).astype(np.uint64).view(np.int64) for x in read]
    # a.c = a'.c' + a.low_c + low_a.c - low_a.low_c, where what overflows 64 bits on the way cancels
    return (np.concatenate(read, axis=1)[:, :n] + (anchors @ low_c)[:, None] + (candidates @ low_a)[None, :] - low_a @ low_c)


def best(score: np.ndarray, places: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` of ``places`` with the highest scores, the earlier place first among equals."""
    if len(places) > most:
        found = score[places]
        places = places[found >= np.partition(found, len(found) - most)[len(found) - most]]
    return places[np.argsort(-score[places], kind="stable")[:most]]


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors in the batch the places of its rows and their vectors."""
    vectors = batch.column("vector")
    lengths = vectors.value_lengths().to_numpy()
    for d in np.unique(lengths):
        places = np.flatnonzero(lengths == d)
        flat = vectors.take(pa.array(places)).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        yield places, flat.reshape(len(places), d)


class Candidates:
    """One part of the rows in the order of vec_id; of rows that repeat a vec_id the first."""

    def __init__(self, batches: list[pa.RecordBatch]):
        self.by_length = {}
        if not batches:
            return
        held = pa.Table.from_batches(batches).combine_chunks().to_batches()
        ids, labels = (held[0].column(c).to_numpy() for c in ("vec_id", "label"))
        first = np.append(True, ids[1:] != ids[:-1])
        for places, vectors in matrices(held[0]):
            own = first[places]
            if own.any():
                self.by_length[vectors.shape[1]] = ids[places[own]], labels[places[own]], vectors[own]


def beside(found: Callable, kinds: pa.Schema):
    """Rows sorted by part, candidates first, to what ``found`` makes of each part's candidates and each of its anchors.

    Candidates of one part are held, anchors stream past them.
    """
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, candidates = None, [], None
        for batch in batches:
            of, anchor = batch.column("part").to_numpy(), batch.column("anchor").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((of[1:] != of[:-1]) | (anchor[1:] != anchor[:-1])) + 1
            for start, end in zip(np.append(0, cuts), np.append(cuts, len(of))):
                if start == end:
                    continue
                run = batch.slice(start, end - start)
                if of[start] != part:
                    part, rows, candidates = of[start], [], None
                if not anchor[start]:
                    rows.append(run)
                    continue
                candidates, rows = candidates or Candidates(rows), []
                for i in range(0, run.num_rows, ANCHORS):
                    asked, out = run.slice(i, ANCHORS), []
                    ids, labels = (asked.column(c).to_numpy() for c in ("vec_id", "label"))
                    for places, vectors in matrices(asked):
                        if vectors.shape[1] in candidates.by_length:
                            others, kinds_of, against = candidates.by_length[vectors.shape[1]]
                            score = inner_products(vectors, against)
                            for row, place in zip(score, places):
                                out += found(ids[place], labels[place], asked.column("wanted")[int(place)], others, kinds_of, row)
                    yield pa.RecordBatch.from_pylist(out, kinds)
    return made


def like_it(most: int):
    """Of an anchor: the best others of its label."""
    def found(vec_id, label, _, others, labels, score) -> list[dict]:
        chosen = best(score, np.flatnonzero((labels == label) & (others != vec_id)), most)
        return [{"anchor_id": vec_id, "positive_id": others[i], "positive_score": score[i]} for i in chosen]
    return found


def unlike_it(most: int, least: int, at_most: int):
    """Of an anchor and each of its positives: the best of other labels within bounds that the positive's score sets."""
    def found(vec_id, label, wanted, others, labels, score) -> list[dict]:
        out, unlike = [], np.flatnonzero(labels != label)
        held = score[unlike]
        for positive in wanted.as_py():
            reach = positive["positive_score"]
            low, high = -(-least * reach // 100), at_most * reach // 100
            chosen = best(score, unlike[(held >= low) & (held <= high)], most)
            out += [{"anchor_id": vec_id, "positive_id": positive["positive_id"], "positive_score": reach,
                     "negative_id": others[i], "negative_score": score[i]} for i in chosen]
        return out
    return found


def whole_components(rows: DataFrame, label: str | Column = "label") -> DataFrame:
    """vec_id, label and vector (whole numbers) of the rows that take part, see :func:`hard_negatives`."""
    x = F.transform("embedding", lambda v: F.floor(F.lit(float(SCALE)) * v.cast("double")))
    fits = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < 2.0 ** 31 / SCALE)
    square = F.aggregate("vector", F.lit(0.0), lambda total, v: total + v.cast("double") * v.cast("double"))
    label = F.col(label) if isinstance(label, str) else label
    return rows.where(F.col("vec_id").isNotNull() & F.forall("embedding", fits)).select(
        F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("vector")).where(
        F.col("label").isNotNull() & (square < 2.0 ** 62))


def hard_negatives(rows: DataFrame, label: str | Column = "label", every: int = 100, positives: int = POSITIVES,
                   negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST) -> DataFrame:
    """For each anchor and positive its negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Vectors are scaled by SCALE and rounded down; a score is an inner product with the anchor, higher ones come first,
    the smaller vec_id among equals. Anchors are the rows whose vec_id is divisible by ``every``. An anchor's positives
    are its best others of the same label; a positive's negatives are the anchor's best rows of other labels with scores
    between ``least`` and ``most`` per cent of the positive's; fewer where there are no more.

    Every anchor is compared with every row, a block of rows and a block of anchors at a time. Rows are dealt out by a
    hash of vec_id in parts of about CANDIDATES, whatever their labels; anchors are sent to each part. Of the results a
    part sends on no more than can stay.

    Rows without vec_id, label or vector, with a NULL or non-finite component, or with a vector so long (a squared length
    of 2^62 after scaling) that scores need not fit into a long take no part. Of rows that repeat a vec_id the one with
    the smallest label and vector counts. Vectors of different lengths have no score; empty ones have 0. Other columns
    are not looked at.
    """
    held = stored(whole_components(rows, label))
    parts = held.count() // CANDIDATES + 1
    nothing = "array<struct<positive_id: bigint, positive_score: bigint>>"
    dealt = held.select(F.pmod(F.xxhash64("vec_id"), F.lit(parts)).alias("part"), F.lit(False).alias("anchor"), "*",
                        F.lit(None).cast(nothing).alias("wanted"))
    anchors = stored(held.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(
        F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.*"))

    def compared(asked: DataFrame, found: Callable, schema: str) -> DataFrame:
        copies = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"),
                              F.lit(True).alias("anchor"), "vec_id", "label", "vector", "wanted")
        kinds = pa.schema([(c.split()[0], pa.int64()) for c in schema.split(", ")])
        return (dealt.unionByName(copies).repartition(parts, "part")
                .sortWithinPartitions("part", "anchor", "vec_id", "label", "vector").mapInArrow(beside(found, kinds), schema))

    def first(found: DataFrame, by: list[str], score: str, other: str, n: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), other))
        return found.withColumn("rank", place).where(F.col("rank") <= n)

    like = compared(anchors.withColumn("wanted", F.lit(None).cast(nothing)), like_it(positives),
                    "anchor_id bigint, positive_id bigint, positive_score bigint")
    chosen = first(like, ["anchor_id"], "positive_score", "positive_id", positives)
    wanted = chosen.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.collect_list(F.struct("positive_id", "positive_score")).alias("wanted"))
    unlike = compared(stored(anchors.join(wanted, "vec_id")), unlike_it(negatives, least, most),
                      "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    return first(unlike, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
