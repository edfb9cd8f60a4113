"""Text quality by an interpolated modified Kneser-Ney n-gram model of trusted text.

Symbols are UTF-16 code units, n-grams have up to four of them, packed into one 64-bit number with the oldest symbol
highest. Counts lie in Spark tables, sharded by n-gram; a block of documents asks them only for its own distinct
n-grams, so neither the model nor a document's n-grams ever travel whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from mostrador.llm.common import by_ids, in_shares, plain_text, stored, text_partitions, unless_few

ORDER = 4
#: Text bytes of a block, and UTF-16 units looked at together in a task.
BLOCK_BYTES, UNITS_AT_ONCE = 8 << 20, 4 << 20
#: One trusted document in CALIBRATING, so every second one, is kept from the counts; these give the limits, see
#: :func:`limits`: on small tables a few documents would leave the reach to chance. Languages
#: with fewer of them than LEAST_MIDDLE and LEAST_REACH take the middle and the reach of all languages together.
CALIBRATING, HIGH, FAR, LEAST_MIDDLE, LEAST_REACH, ACCURACY = 2, 0.9, 0.99, 5, 50, 10_000


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-16 units of all texts, each led by three line ends and closed by one, and where each text starts."""
    stream = [np.frombuffer(f"\n\n\n{t}\n".encode("utf-16-le", "surrogatepass"), "<u2") for t in texts]
    lengths = np.array([len(s) for s in stream], np.int64)
    return np.concatenate(stream), np.cumsum(lengths) - lengths


def grams(units: np.ndarray) -> np.ndarray:
    """The packed four symbols that end at each place but the first three."""
    wide = units.astype(np.uint64)
    return wide[:-3] << np.uint64(48) | wide[1:-2] << np.uint64(32) | wide[2:-1] << np.uint64(16) | wide[3:]


def bunches(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that together have about UNITS_AT_ONCE symbols."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= UNITS_AT_ONCE:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def text_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that end within each text or at its closing line end, one after the other, and where each starts."""
    units, starts = symbols(texts)
    keep = np.ones(len(units) - 3, bool)  # the n-gram at place i ends at i + 3
    for back in (1, 2, 3):
        keep[starts[1:] - back] = False
    own = np.diff(np.append(starts, len(units))) - 3
    return grams(units)[keep], np.cumsum(own) - own


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column(0).to_pylist()]
        for a, b in bunches(texts):
            found, counts = np.unique(text_grams(texts[a:b])[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts)], names=["gram", "n"])


def gram_counts(texts: DataFrame) -> DataFrame:
    """Counts (gram, n) of all n-grams of the full order in a column ``text``."""
    return (texts.select(plain_text("text").alias("text")).mapInArrow(count_grams, "gram bigint, n bigint")
            .groupBy("gram").agg(F.sum("n").alias("n")))


def discounts(spread: dict[int, int]) -> list[float]:
    """What is taken from counts of one, two, and three or more, from the numbers of n-grams with counts 1 to 4.

    Where one of these numbers is 0 or gives a value out of range, as on tiny corpora, half the count is taken.
    """
    n = [spread.get(i, 0) for i in range(1, 5)]
    out = []
    for i in (1, 2, 3):
        d = i - (i + 1) * n[0] / (n[0] + 2 * n[1]) * n[i] / n[i - 1] if all(n) else -1.0
        out.append(d if 0 < d < i else i / 2)
    return out


class Model:
    """Count tables of one trusted corpus: for each order (gram, n) and its contexts (context, total, left over)."""

    def __init__(self, counts: DataFrame):
        self.counts, self.contexts, self.takes = {}, {}, {}
        table = stored(counts)
        for order in range(ORDER, 0, -1):
            self.counts[order] = table
            spread = {r.n: r.grams for r in table.where("n <= 4").groupBy("n").agg(F.count("*").alias("grams")).collect()}
            self.takes[order] = d = discounts(spread)
            context = F.shiftrightunsigned("gram", 16)
            ones, twos, more = (F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2), F.count_if(F.col("n") >= 3))
            self.contexts[order] = stored(table.groupBy(context.alias("context")).agg(
                F.sum("n").alias("total"), ((ones * d[0] + twos * d[1] + more * d[2]) / F.sum("n")).alias("over")))
            if order > 1:  # lower orders count the different symbols seen before
                shorter = F.col("gram").bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1))
                table = stored(table.groupBy(shorter.alias("gram")).agg(F.count("*").alias("n")))
        self.symbols = self.counts[1].count() + 1  # and one for all that was never seen

    def bits(self, wanted: DataFrame) -> DataFrame:
        """Rows (gram, bits): minus the binary logarithm of the last symbol's probability after the others."""
        out = wanted.select("gram").distinct().withColumn("p", F.lit(1.0 / self.symbols))
        for order in range(1, ORDER + 1):
            d = self.takes[order]
            part = F.col("gram").bitwiseAND(F.lit((1 << 16 * order) - 1)) if order < 4 else F.col("gram")
            counts = unless_few(self.counts[order]).select(F.col("gram").alias("part"), "n")
            out = out.withColumn("part", part).join(counts, "part", "left")
            out = out.withColumn("context", F.shiftrightunsigned("part", 16)).join(unless_few(self.contexts[order]), "context", "left")
            left = F.col("n") - F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
            p = F.coalesce(left / F.col("total"), F.lit(0.0)) + F.coalesce("over", F.lit(1.0)) * F.col("p")
            out = out.select("gram", p.alias("p"))
        return out.select("gram", (-F.log2("p")).alias("bits"))


def pack(kind: pa.DataType):
    """Documents of one batch and block as one compressed row: what is shuffled is about a third of the text."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            order = np.argsort(blocks, kind="stable")
            cuts = np.flatnonzero(np.diff(blocks[order])) + 1
            for rows in np.split(order, cuts):
                if not len(rows):
                    continue
                texts = batch.column(3).take(pa.array(rows)).to_pylist()
                for a, b in bunches(texts):
                    part = pa.array(rows[a:b])
                    raw = [t.encode() for t in texts[a:b]]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([int(blocks[rows[0]])], pa.int32()),
                        pa.array([batch.column(1).take(part).to_pylist()], pa.list_(kind)),
                        pa.array([batch.column(2).take(part).to_pylist()], pa.list_(pa.string())),
                        pa.array([[len(r) for r in raw]], pa.list_(pa.int32())),
                        pa.array([squeeze.compress(b"".join(raw))], pa.binary())],
                        names=["block", "ids", "langs", "sizes", "body"])
    return packed


def unpack(sizes: list[int], body: bytes) -> list[str]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(body, max_output_size=max(1, sum(sizes))), 0, []
    for size in sizes:
        out.append(raw[at:at + size].decode())
        at += size
    return out


def wanted_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams of each block, distinct but for those of very large blocks, which are told in parts."""
    held: dict[int, list[np.ndarray]] = {}

    def told(block: int) -> pa.RecordBatch:
        found = np.unique(np.concatenate(held.pop(block)))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(found), block, np.int32)),
                                           pa.array(found.view(np.int64))], names=["block", "gram"])
    for batch in batches:
        for block, sizes, body in zip(*(batch.column(c).to_pylist() for c in ("block", "sizes", "body"))):
            texts = unpack(sizes, body)
            for a, b in bunches(texts):
                held.setdefault(block, []).append(np.unique(text_grams(texts[a:b])[0]))
            if sum(map(len, held[block])) > UNITS_AT_ONCE:
                yield told(block)
    for block in list(held):
        yield told(block)


class Bits:
    """A table of n-grams as a hash table of one slot each; the few that share a slot are searched for."""

    def __init__(self, found: np.ndarray, bits: np.ndarray):
        order = np.argsort(found)
        self.found, self.bits = found[order], bits[order]
        self.shift = np.uint64(64 - max(10, (4 * len(found)).bit_length()))
        self.slot_of = np.zeros(1 << int(64 - self.shift), np.int32)
        self.slot_of[self.slots(self.found)] = np.arange(len(found), dtype=np.int32)

    def slots(self, found: np.ndarray) -> np.ndarray:
        return (found * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def __getitem__(self, found: np.ndarray) -> np.ndarray:
        place = self.slot_of[self.slots(found)]
        other = np.flatnonzero(self.found[place] != found)
        place[other] = np.searchsorted(self.found, found[other])
        return self.bits[place]


def score_block(kind: pa.DataType):
    def score(packs: pa.Table, answers: pa.Table) -> pa.Table:
        bits = Bits(answers.column("gram").to_numpy().view(np.uint64), answers.column("bits").to_numpy())
        ids, langs, lengths, sums = [], [], [], []
        for row in range(packs.num_rows):
            at = {c: packs.column(c)[row].as_py() for c in ("ids", "langs", "sizes", "body")}
            ids += at["ids"]
            langs += at["langs"]
            texts = unpack(at["sizes"], at["body"])
            for a, b in bunches(texts):
                found, starts = text_grams(texts[a:b])
                sums.append(np.add.reduceat(bits[found], starts))
                lengths.append(np.diff(np.append(starts, len(found))))
        columns = [pa.array(ids, kind), pa.array(langs, pa.string()), pa.array(np.concatenate(lengths)),
                   pa.array(np.concatenate(sums) / np.concatenate(lengths))]
        return pa.Table.from_arrays(columns, names=["doc_id", "lang", "n_symbols", "bits"])
    return score


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, lang, n_symbols, bits), one for each row of ``docs``; bits is the mean per symbol."""
    from pyspark.sql.pandas.types import to_arrow_type

    blocks = text_partitions(docs, bytes_each=BLOCK_BYTES)
    kind, name = to_arrow_type(docs.schema["doc_id"].dataType), docs.schema["doc_id"].dataType.simpleString()
    text = plain_text("text")
    block = F.pmod(F.xxhash64("doc_id", F.length(text)), F.lit(blocks)).cast("int")
    packs = (docs.select(block.alias("block"), "doc_id", F.col("lang").cast("string"), text.alias("text"))
             .mapInArrow(pack(kind), f"block int, ids array<{name}>, langs array<string>, sizes array<int>, body binary")
             .repartition("block"))
    wanted = packs.mapInArrow(wanted_grams, "block int, gram bigint")  # of all columns: so both uses share one shuffle
    answers = in_shares(wanted).join(model.bits(wanted), "gram").select("block", "gram", "bits")
    return packs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        score_block(kind), f"doc_id {name}, lang string, n_symbols bigint, bits double")


def limits(scored: DataFrame, held: DataFrame) -> DataFrame:
    """One row (lang, middle, high, reach) for each language of ``scored``, the NULL language among them.

    ``held`` has the doc_ids of trusted documents that the model has not seen. ``middle`` and ``high`` are the median
    and the HIGH quantile of their bits. A mean over n symbols scatters with one over the root of n, so a document's
    distance from the middle is taken times that root; ``reach`` is the FAR quantile of these distances and once more
    its own distance from their median.
    """
    quantile = lambda c, q: F.percentile_approx(c, F.lit(q), F.lit(ACCURACY))
    reach = (2 * quantile("distance", FAR) - quantile("distance", 0.5)).alias("reach")
    known = stored(by_ids(scored, held, "left_semi"))
    middle, high = quantile("bits", 0.5).alias("middle"), quantile("bits", HIGH).alias("high")
    every = known.agg(middle, high).first()
    enough = F.col("n") >= LEAST_MIDDLE
    of_lang = known.groupBy(F.col("lang").alias("of")).agg(middle, high, F.count("*").alias("n")).select("of", "n", *[
        F.when(enough, F.col(c)).otherwise(F.lit(every[c]).cast("double")).alias(c) for c in ("middle", "high")])
    # Every language of ``known`` is in the other; a left join so that ``known`` itself is never broadcast.
    apart = stored(known.join(of_lang, F.col("lang").eqNullSafe(F.col("of")), "left").select(
        "lang", ((F.col("bits") - F.col("middle")) * F.sqrt("n_symbols")).alias("distance")))
    far = apart.agg(reach).first().reach
    reaches = apart.groupBy("lang").agg(reach, F.count("*").alias("m")).where(F.col("m") >= LEAST_REACH)
    langs = scored.select(F.col("lang").alias("_lang")).distinct()
    return (langs.join(of_lang, F.col("_lang").eqNullSafe(F.col("of")), "left")
            .join(reaches, F.col("_lang").eqNullSafe(F.col("lang")), "left").select(
                "_lang", F.coalesce("middle", F.lit(every.middle).cast("double")).alias("middle"),
                F.coalesce("high", F.lit(every.high).cast("double")).alias("high"),
                F.coalesce("reach", F.lit(far).cast("double")).alias("reach")))


def held_back(doc_id: Column) -> Column:
    """Whether a trusted document calibrates limits."""
    return F.pmod(F.xxhash64(doc_id), F.lit(CALIBRATING)) == 0


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, lang, n_symbols, bits, perplexity, bits_limit, kept.

    The model is trained on the texts that ``labels`` marks with quality 1, on all but those that calibrate the limits.
    Perplexity is 2 to the power of bits. Documents with bits above their limit are rejected: the greater of their language's high quantile and
    its middle plus its reach over the root of their number of symbols, as :func:`limits` has them. A NULL text is
    empty; the empty text has one symbol, its end. A NULL language is one of its own. Without a trusted text the limit
    is NULL and all stay. Repeated rows are scored each; repeated labels count once; other columns are not looked at.
    """
    trusted = stored(labels.where("quality = 1").select("doc_id").distinct())
    held = held_back(F.col("doc_id"))
    model = Model(gram_counts(by_ids(docs, trusted.where(~held), "left_semi")))
    scored = stored(scores(docs, model))
    limit = limits(scored, trusted.where(held))
    judged = scored.join(limit, F.col("lang").eqNullSafe(F.col("_lang")), "left").withColumn(
        "bits_limit", F.greatest("high", F.col("middle") + F.col("reach") / F.sqrt("n_symbols")))
    return judged.select(
        "doc_id", "lang", "n_symbols", "bits", F.pow(F.lit(2.0), F.col("bits")).alias("perplexity"), "bits_limit",
        F.coalesce(F.col("bits") <= F.col("bits_limit"), F.lit(True)).alias("kept"))


def kept_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document stays, with all their columns.

    Rows that share a doc_id stay or go together: they go when one of them is rejected. A NULL doc_id stays.
    """
    gone = stored(judge(docs, labels).where("not kept").select("doc_id").distinct())
    return by_ids(docs, gone, "left_anti").select(*[f"`{c}`" for c in docs.columns])
