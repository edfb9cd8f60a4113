"""Near duplicates by MinHash signatures, an inverted index of their coordinates, and full shingle sets."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from mostrador.llm.common import by_ids, components, in_shares, plain_text, stored, unless_few

#: Words of a shingle, and per cent of the union that two sets must share where the caller does not say.
WORDS, SHARE = 5, 85
#: Signature coordinates, and the probability that sets which share just enough agree in too few of them (:func:`least_agreeing`).
COORDINATES, LOST = 48, 1e-8
#: Nodes of a posting list up to which all its pairs are compared at once; longer lists go round by round.
SHORT = 8
#: Words that a worker remembers, and shingles hashed together.
REMEMBERED, AT_ONCE = 500_000, 8192
STEP, MASK = np.uint64(0x9E3779B97F4A7C15), (1 << 64) - 1
#: Atoms of the sets that are compared with another such block at once, and rows that parting may make for each of its first round.
BLOCK, PARTED = 1 << 16, 2
#: What :func:`branches` gives.
PATHS = ["node", "component", "size", "path", "place", "held", "rest", "skipped", "ended"]


def least_agreeing(share: int) -> int:
    """How many coordinates must agree before sets are compared: as many as leave sets that share ``share`` per cent
    below that number with a probability under LOST. 24 for 85 per cent, 21 for 80."""
    below, part = 0.0, share / 100
    for n in range(COORDINATES):
        below += comb(COORDINATES, n) * part ** n * (1 - part) ** (COORDINATES - n)
        if below >= LOST:
            return max(1, n)
    return COORDINATES


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, hashes: WordHashes, width: int = WORDS) -> np.ndarray:
    """The sorted set of a text's shingles as 64-bit hashes. A text of fewer words is one shingle, one of none has none."""
    words = text.encode().lower().split()  # bytes: only A-Z change, and only ASCII white space divides
    if not words:
        return np.empty(0, np.uint64)
    known = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    runs = np.full(len(words) - width + 1, width, np.uint64)
    for j in range(width):
        runs = runs * STEP + known[j:len(known) - width + 1 + j]
    return np.unique(mixed(runs))


def factors() -> tuple[np.ndarray, np.ndarray]:
    numbers = mixed(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * STEP)
    return numbers[:COORDINATES, None] | np.uint64(1), numbers[COORDINATES:, None]


def signature(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each coordinate the smallest 32-bit hash among the shingles."""
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(found), AT_ONCE):
        part = (found[i:i + AT_ONCE] * a + b) >> np.uint64(32)
        np.minimum(least, part.min(axis=1), out=least)
    return least.astype(np.uint32).view(np.int32)


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, (a, b) = WordHashes(), factors()
    for batch in batches:
        sizes, digests, signatures = [], [], []
        for text in batch.column(1).to_pylist():
            found = shingles(text, hashes)
            sizes.append(len(found))
            digests.append(blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
            signatures.append(signature(found, a, b) if len(found) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
             pa.array(signatures, pa.list_(pa.int32()))], names=["doc_id", "n_shingles", "digest", "signature"])


def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        step = 512
        for i in range(0, batch.num_rows, step):
            found = [shingles(t, hashes) for t in batch.column(0).slice(i, step).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in found], pa.binary()),
                 pa.array([len(s) for s in found], pa.int64()),
                 pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], names=["digest", "size", "members"])


def agreeing(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a == b).cast("int")), F.lit(0), lambda n, same: n + same)


def postings(classes: DataFrame, share: int = SHARE) -> DataFrame:
    """Rows (token, node, central): each signature under its rarest coordinate values.

    Two signatures that agree in :func:`least_agreeing` places share one of the values that come first by frequency,
    of which all but that many less one are posted. Values that one signature alone has come first of all and are not posted, as nobody meets there;
    ``central`` is their number.
    """
    tokens = classes.select("node", F.posexplode("signature").alias("place", "value")).select(
        "node", (F.shiftleft(F.col("place").cast("long"), 32).bitwiseOR(
            F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))).alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    ranked = in_shares(tokens).join(shared, "token").groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("n", "token"))).alias("values"))
    kept = F.greatest(F.size("values") - (least_agreeing(share) - 1), F.lit(0))
    return ranked.select("node", (COORDINATES - F.size("values")).alias("central"), F.explode(
        F.slice("values", F.lit(1), kept)).alias("value")).select("node", "central", F.col("value.token").alias("token"))


def confirmed(pairs: DataFrame, signatures: DataFrame | None, sets: DataFrame, share: int = SHARE) -> DataFrame:
    """The pairs (a, b and more columns) that agree in enough coordinates and share enough of their full sets.

    Without signatures all are compared by their sets.
    """
    side = lambda df, name, value: in_shares(df.select(F.col("node").alias(name), F.col(value).alias(f"of_{name}")))
    close = pairs if signatures is None else (
        pairs.join(side(signatures, "a", "signature"), "a").join(side(signatures, "b", "signature"), "b")
        .where(agreeing(F.col("of_a"), F.col("of_b")) >= least_agreeing(share)).select(*pairs.columns))
    both = close.join(side(sets, "a", "members"), "a").join(side(sets, "b", "members"), "b")
    common = F.size(F.array_intersect("of_a", "of_b"))
    return both.where(100 * common >= share * (F.size("of_a") + F.size("of_b") - common)).select(*pairs.columns)


def reaches(side: str, size: str, share: int) -> Column:
    """Whether a common set of at most ``shared`` shingles can be ``share`` per cent of the union with a set of ``size``."""
    return F.expr(f"{share} * {size} <= {100 + share} * {side}shared - {share} * {side}size")


def able(state: DataFrame, sets: DataFrame, share: int = SHARE) -> DataFrame:
    """The rows of ``state`` (node, component, tokens) that can still be linked to another component, with size and shared.

    ``shared`` counts a node's shingles that a node of another component has too: no common set with one is larger. With
    that, ``share`` per cent are out of reach of every other set above a certain size; tokens under which no set is small
    enough, or all nodes have come together, are taken from a node, and nodes without tokens from the state.
    """
    def open_(rows: DataFrame, **more: Column) -> DataFrame:
        return rows.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), *[
            c.alias(name) for name, c in more.items()]).where("low <> high").drop("low", "high")
    posted = state.select("node", "component", F.explode("tokens").alias("token"))
    left = stored(posted.join(open_(posted), "token", "left_semi").groupBy("node", "component").agg(
        F.collect_list("token").alias("tokens")))
    here = sets.join(left.select("node", "component"), "node")
    common = (here.select("node", "component", F.explode("members").alias("shingle")).groupBy("shingle")
              .agg(F.min("component").alias("low"), F.max("component").alias("high"))
              .where("low <> high").select("shingle"))
    shared = (here.select("node", F.explode("members").alias("shingle")).join(common, "shingle", "left_semi")
              .groupBy("node").agg(F.count("*").alias("shared")))
    known = in_shares(left).join(sets.select("node", "size").join(shared, "node"), "node").where(reaches("", "0", share))
    posted = stored(known.select("node", "component", "size", "shared", F.explode("tokens").alias("token")))
    least = open_(posted, least=F.min("size"))
    return stored(in_shares(posted).join(least, "token").where(reaches("", "least", share)).groupBy("node", "component", "size", "shared").agg(
        F.collect_list("token").alias("tokens")))


def together(state: DataFrame, new: DataFrame) -> DataFrame:
    """``state`` with the nodes that a link joins to a list's central node labelled like that one.

    Equal labels mean that nodes hang together; that they have different ones means nothing yet.
    """
    to = new.groupBy("a").agg(F.min("to").alias("to"))
    beyond = to.select(F.col("a").alias("to"), F.col("to").alias("beyond"))
    labels = to.join(beyond, "to", "left").select(F.col("a").alias("node"), F.coalesce("beyond", "to").alias("label"))
    return state.join(labels, "node", "left").withColumn("component", F.coalesce("label", "component")).drop("label")


def stars(state: DataFrame, far: Column) -> DataFrame:
    """Pairs (a, b, to) of each node and the most central one, the least ``far``, of each of its lists."""
    posted = state.select("node", "component", far.alias("far"), F.explode("tokens").alias("token"))
    hubs = posted.groupBy("token").agg(F.min(F.struct("far", "node", "component")).alias("hub"))
    return in_shares(posted).join(hubs, "token").where("component <> hub.component").select(
        F.col("node").alias("a"), F.col("hub.node").alias("b"), F.col("hub.component").alias("to")).distinct()


def reached(path: dict, beyond: list[int], needed: int) -> range:
    """The places of the atoms that may come next in a path: before them a node leaves out no more than it may."""
    return range(path["place"] + 1, bisect_right(beyond, path["held"] - needed, key=lambda weight: -weight))


def branches(share: int, counted: bool):
    """Rows (node, component, size, ids, weights, paths) to their paths' continuations and ends, see PATHS.

    ``ids`` and ``weights`` are a node's atoms in their common order. A path is a list of atoms; whoever shares all of
    it, and none between, shares one more further on, or it ends. A node leaves out (``skipped``) only as many shingles
    as a set of at least ``least`` that it can be linked to may lack. With ``counted`` only the number of the
    continuations is given.
    """
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, n = [], 0
            for row in batch.to_pylist():
                size, ids = row["size"], row["ids"]
                beyond = [*np.cumsum(row["weights"][::-1])[::-1].tolist(), 0]
                head = row["node"], row["component"], size
                for path in row["paths"]:
                    needed = max(-(-share * size // 100), -(-share * (size + path["least"]) // (100 + share)))
                    places = reached(path, beyond[:-1], needed)
                    n += len(places)
                    if counted:
                        continue
                    if path["held"] >= needed:
                        out.append((*head, xxhash.xxh3_64_intdigest(b"end", path["path"] & MASK), len(ids), path["held"], 0, [], True))
                    for place in places:
                        next_ = xxhash.xxh3_64_intdigest((ids[place] & MASK).to_bytes(8), path["path"] & MASK)
                        out.append((*head, next_, place, path["held"] + row["weights"][place], beyond[place + 1],
                                    path["skipped"] + ids[path["place"] + 1:place], False))
            if counted:
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])
                continue
            columns = [[x if x < 1 << 63 else x - (1 << 64) for x in c] if i == 3 else c for i, c in enumerate(zip(*out))]
            kinds = [*[pa.int64()] * 7, pa.list_(pa.int64()), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns or [[]] * len(kinds), kinds)], names=PATHS)
    return made


def between(share: int):
    """Rows (x, y), two blocks of rows (node, component, size, ids, weights), to links (a, b) between components.

    All sets are compared; of the links of two blocks those are given that join components not yet joined by the others.
    """
    def sides(block: pa.StructArray) -> tuple:
        ids = block.field("ids")
        return (*[block.field(c).to_numpy() for c in ("node", "component", "size")], ids.value_lengths().to_numpy(),
                ids.flatten().to_numpy(), block.field("weights").flatten().to_numpy())

    def joined(x: pa.StructArray, y: pa.StructArray) -> Iterator[tuple[int, int]]:
        nodes, labels, sizes, lengths, ids, weights = sides(x)
        others, their_labels, their_sizes, their_lengths, their_ids, _ = sides(y)
        known, places = np.unique(their_ids, return_inverse=True)
        owners, ends, to = np.repeat(np.arange(len(others)), their_lengths), np.cumsum(lengths), {}

        def root(label: int) -> int:
            while label in to:
                label = to[label]
            return label
        for i, end in enumerate(ends):
            own = slice(end - lengths[i], end)
            found = np.searchsorted(known, ids[own])
            there = np.flatnonzero(known[np.minimum(found, len(known) - 1)] == ids[own])
            held = np.zeros(len(known))
            held[found[there]] = weights[own][there]
            common = np.bincount(owners, held[places], len(others))
            alike = ((100 + share) * common >= share * (sizes[i] + their_sizes)) & (their_labels != labels[i])
            for j in np.flatnonzero(alike):
                a, b = root(int(labels[i])), root(int(their_labels[j]))
                if a != b:
                    to[a] = b
                    yield int(nodes[i]), int(others[j])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [link for x, y in zip(batch.column("x"), batch.column("y")) for link in joined(x.values, y.values)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], []))], names=["a", "b"])
    return made


def links_in_blocks(nodes: DataFrame, lists: DataFrame, share: int) -> DataFrame:
    """Links (a, b) between components among the nodes that hang together by ``lists`` (rows with a list's node and
    its smallest), enough to join all that are linked.

    Nodes lie in blocks of about BLOCK atoms; a large component has blocks of its own, which are not compared with each
    other. Two blocks at a time meet in a task, so no pair of nodes becomes a row.
    """
    family = components(lists.select(F.col("node").alias("a"), F.col("smallest.node").alias("b")))
    left = in_shares(nodes).join(family.select("node", F.col("component").alias("family")), "node")
    held = left.groupBy("family", "component").agg(F.sum(F.size("ids")).alias("held")).withColumn("own", F.col("held") >= BLOCK)
    dealt = held.select("family", "component", "held", "own", F.when(F.col("own"), F.col("component")).otherwise(0).alias("of"))
    many = dealt.groupBy("family", "own", "of").agg(F.ceil(F.sum("held") / BLOCK).alias("blocks"))
    place = dealt.join(many, ["family", "own", "of"]).select("family", "component", "own", "of", "blocks")
    blocks = stored(left.join(place, ["family", "component"]).withColumn("block", F.struct(
        "family", "own", "of", F.pmod(F.xxhash64(F.when(F.col("own"), F.col("node")).otherwise(F.col("component"))), "blocks").alias("no")))
        .groupBy("block").agg(F.collect_list(F.struct("node", "component", "size", "ids", "weights")).alias("rows")))
    keys = blocks.select("block", F.col("block.family").alias("family"))
    meet = F.expr("x.family = y.family and x.block <= y.block and not (x.block.own and y.block.own and x.block.of = y.block.of)")
    pairs = keys.alias("x").join(keys.alias("y"), meet).select(F.col("x.block").alias("of_x"), F.col("y.block").alias("of_y"))
    side = lambda c: blocks.select(F.col("block").alias(f"of_{c}"), F.col("rows").alias(c))
    return pairs.join(side("x"), "of_x").join(side("y"), "of_y").select("x", "y").mapInArrow(between(share), "a bigint, b bigint")


def pairs_by_shingles(state: DataFrame, sets: DataFrame, share: int = SHARE) -> DataFrame:
    """Pairs (a, b) of nodes of different components among which all that can be linked are, or hang together by others.

    Shingles that the same nodes have are one atom with a weight. Sets that can be linked share enough of their atoms, so
    the first common one, by rarity, comes early in both. Nodes meet under it; where many do, they part again by the second
    common one, and so on. Short lists are compared pair by pair. Where a path ends, what its nodes share is known,
    so each is compared with the smallest set alone. Parting stops where it does not halve the number of pairs, or where
    it would make more than PARTED rows for each row of the first round; what is left then is compared block by block.
    """
    here = sets.join(state.select("node", "component"), "node")
    held = here.select("node", "component", F.explode("members").alias("shingle"))
    atoms = held.groupBy("shingle").agg(
        F.count("*").alias("n"), F.expr("bit_xor(xxhash64(node))").alias("x"), F.expr("bit_xor(xxhash64(node, 1))").alias("y"),
        F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("shingle", F.struct("n", "x", "y").alias("atom"))
    weighed = held.join(atoms, "shingle").groupBy("node", "atom").agg(F.count("*").alias("weight"))
    sorted_ = weighed.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("atom", "weight"))).alias("atoms"))
    nodes = stored(sorted_.join(here.select("node", "component", "size"), "node").select(
        "node", "component", "size", F.transform("atoms", lambda a: F.xxhash64(a["atom"])).alias("ids"), F.col("atoms.weight").alias("weights")))
    start = F.array(F.struct(F.lit(0).cast("long").alias("path"), F.lit(-1).cast("long").alias("place"), F.lit(0).cast("long").alias("held"),
                             F.lit(1).cast("long").alias("least"), F.array().cast("array<bigint>").alias("skipped")))
    paths, found, before, most, spare = nodes.withColumn("paths", start), [], None, None, None
    schema = ", ".join(f"{c} bigint" for c in PATHS[:-2]) + ", skipped array<bigint>, ended boolean"
    # Under a path whose atoms are not the first common ones a pair is not made again; what is left must still suffice.
    meet = F.expr("x.path = y.path and x.component < y.component and not arrays_overlap(x.skipped, y.skipped) and "
                  f"{100 + share} * (x.held + least(x.rest, y.rest)) >= {share} * (x.size + y.size)")
    pair = lambda rows: in_shares(rows.alias("x")).join(rows.alias("y"), meet).select(
        F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    while True:
        asked = paths.select("node", "component", "size", "ids", "weights", "paths")
        if before is not None:
            asked = stored(asked)
            spare -= asked.mapInArrow(branches(share, True), "n bigint").agg(F.sum("n").alias("n")).first().n or 0
            if spare < 0:
                found.append(links_in_blocks(nodes, before, share))
                break
        parted = stored(asked.mapInArrow(branches(share, False), schema))
        spare = PARTED * parted.count() if spare is None else spare
        lists = parted.groupBy("path", "ended").agg(
            F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"),
            F.min(F.struct("size", "node", "component")).alias("smallest")).where("low <> high")
        met = stored(in_shares(parted).join(lists, ["path", "ended"]))
        long = met.where(f"not ended and n > {SHORT}")
        # rows of a list times the others in it, halved
        now = long.agg(F.sum((F.col("n") - 1) / 2).alias("n")).first().n or 0
        if before is not None and 2 * now > most:
            found.append(links_in_blocks(nodes, before, share))
            break
        alike = f"{100 + share} * held >= {share} * (size + smallest.size)"
        found.append(met.where(f"ended and component <> smallest.component and {alike}").select(
            F.col("node").alias("a"), F.col("smallest.node").alias("b")))
        found.append(pair(met.where(f"not ended and n <= {SHORT}")))
        if not now:
            break
        before, most = long, now
        paths = in_shares(nodes).join(before.groupBy("node").agg(F.collect_list(F.struct(
            "path", "place", "held", F.col("smallest.size").alias("least"), "skipped")).alias("paths")), "node")
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(posts: DataFrame, signatures: DataFrame | None, sets: DataFrame, share: int = SHARE) -> DataFrame:
    """Confirmed links (a, b), enough to join all that belong together.

    Pairs of short posting lists are all compared. In longer ones, every node is compared with the list's most central
    node, the one with the fewest values or shingles of its own, and those that come together need not be compared with
    each other; nor need those that cannot be linked any more (:func:`able`). So a large group of near copies costs a
    few pairs for each member. Once a round finds little, what is left is compared by :func:`pairs_by_shingles`: no link
    is lost. Between rounds a node is one row, whatever number of lists it is in.
    """
    many = posts.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    lists = stored(in_shares(posts).join(many, "token"))
    short = lists.where(f"n <= {SHORT}")
    state = stored(lists.where(f"n > {SHORT}").groupBy("node").agg(
        F.any_value("central").alias("central"), F.collect_set("token").alias("tokens")).withColumn("component", F.col("node")))
    pairs = in_shares(short.alias("x")).join(short.alias("y"), F.expr("x.token = y.token and x.node < y.node")).select(
        F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.lit(None).cast("long").alias("to"))
    found = stored(confirmed(pairs.distinct().union(stars(state, F.col("central"))), signatures, sets, share))
    new, posted = found.where("to is not null"), None
    found = found.select("a", "b")
    while True:
        state = able(together(state, new), sets, share)
        left = state.agg(F.sum(F.size("tokens")).alias("n")).first().n
        if not left:
            return found
        if new.isEmpty() or posted is not None and 2 * left > posted:
            last = confirmed(pairs_by_shingles(state, sets, share), None, sets, share)
            return found.union(stored(last))
        posted = left
        new = stored(confirmed(stars(state, -F.col("shared") / F.col("size")), signatures, sets, share))
        found = found.union(new.select("a", "b"))


def near_groups(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    Texts are compared as sets of shingles: A-Z in lower case, words between ASCII white space, WORDS words each; a
    shorter text is one shingle, an empty or NULL one has none and is linked with nothing. Texts with one and the same
    set are one node, so copies never form pairs. Sets are linked when they share ``share`` per cent of their union;
    component_id is the smallest doc_id among all that hang together, and its row is kept. Rows that repeat a doc_id
    are told apart by their sets. A text whose doc_id is NULL is linked with its copies alone and counts in no minimum.
    Other columns are not looked at.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", plain_text("text").alias("text"))
    sketches = stored(texts.mapInArrow(sketch, f"doc_id {kind}, n_shingles bigint, digest binary, signature array<int>"))
    classes = stored(sketches.where("digest is not null").groupBy("digest").agg(
        F.min("doc_id").alias("doc_id"), F.any_value("signature").alias("signature"))
        .withColumn("node", F.monotonically_increasing_id()))
    posts = stored(postings(classes, share))
    wanted = stored(classes.join(posts.select("node").distinct(), "node", "left_semi"))
    sets = stored(by_ids(texts, wanted.select("doc_id"), "left_semi").select("text")
                  .mapInArrow(whole_sets, "digest binary, size bigint, members array<bigint>")
                  .join(wanted.select("digest", "node"), "digest").dropDuplicates(["node"]).select("node", "size", "members"))
    found = stored(links(posts, wanted.select("node", "signature"), sets, share))
    labels = components(found)
    of_digest = classes.select("digest", "node").join(unless_few(labels), "node", "left").select(
        "digest", F.coalesce("component", "node").alias("component"))
    grouped = sketches.select("doc_id", "n_shingles", "digest").join(of_digest, "digest", "left")
    first = grouped.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return grouped.join(first, "component", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: those whose doc_id is kept. A NULL doc_id stays."""
    gone = stored(near_groups(docs, share).groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where("not kept").select("doc_id"))
    return by_ids(docs, gone, "left_anti").select(*[f"`{c}`" for c in docs.columns])
