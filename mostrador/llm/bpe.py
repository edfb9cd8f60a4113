"""Byte-level BPE: texts to token ids and back, with the merges of a public tokenizer file.

Merging follows the rule "take the leftmost pair of the lowest rank until none is left". A segment tree over the ranks
of adjacent pairs holds that pair in its root; a merge changes three leaves and the nodes above them. The trees of
many words stand side by side in arrays, so one step merges in all words at once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: How byte-level tokenizers cut text before merging; fixed by the file format's pre-tokenizer.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words that a worker remembers between documents, and characters that it cuts and merges at a time.
REMEMBERED, AT_ONCE = 300_000, 1 << 20
NONE = np.int64(1) << 62


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: printable bytes for themselves, others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bpe:
    """One tokenizer file, and the words met so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *added.values()]) + 1
        self.of_byte = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.of_byte[byte] = vocab[letter]
        pairs = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pairs)
        self.pairs, self.ranks = np.append(pairs[order], NONE), np.append(order, 0)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        spelled = [b""] * self.size
        for token, number in vocab.items():
            spelled[number] = bytes(letters[c] for c in token)
        for token, number in added.items():
            spelled[number] = token.encode()
        lengths = np.array([len(s) for s in spelled], np.int64)
        self.spelling, self.length = np.frombuffer(b"".join(spelled), np.uint8), lengths
        self.start = np.cumsum(lengths) - lengths
        self.added = {t: np.array([n], "<u4").tobytes() for t, n in added.items()}
        whole = sorted(map(regex.escape, added), key=len, reverse=True)
        self.cut_added = regex.compile(f"({'|'.join(whole)})") if whole else None
        self.cut_words = regex.compile(WORDS)
        self.cut_long = regex.compile(r"(?<=\S) (?=\S)")
        self.known: dict[str, bytes] = {}

    def keys(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
        """Tree leaves for adjacent pairs: rank first, then place; NONE for pairs that do not merge."""
        pair = left * self.size + right
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[at] == pair, self.ranks[at] * width + place, NONE)

    def merge(self, words: list[bytes], width: int) -> list[bytes]:
        """Ids of words of at most ``width`` bytes, a power of two, each as little-endian 32-bit numbers."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        places = np.arange(width)
        alive = places < lengths[:, None]
        ids = np.zeros((n, width), np.int64)
        ids[alive] = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        tree = np.full((n, 2 * width), NONE, np.int64)
        paired = np.zeros_like(alive)
        paired[:, :-1] = alive[:, 1:]
        right = np.zeros_like(ids)
        right[:, :-1] = ids[:, 1:]
        tree[:, width:][paired] = self.keys(ids[paired], right[paired], np.nonzero(paired)[1], width)
        level = width
        while level > 1:
            level //= 2
            np.minimum(tree[:, 2 * level:4 * level:2], tree[:, 2 * level + 1:4 * level:2], out=tree[:, level:2 * level])
        # Flat views: item p of word w is at w * width + p, node x of its tree at w * 2 * width + x.
        following = np.tile(np.append(places[1:], width), (n, 1))
        previous = np.tile(places - 1, (n, 1))
        following, previous, ids, alive, tree = (x.reshape(-1) for x in (following, previous, ids, alive, tree))
        at = np.flatnonzero(tree[1::2 * width] < NONE)
        while len(at):
            root, base, length = tree[at * 2 * width + 1], at * width, lengths[at]
            here = root % width
            gone = following[base + here]
            after = following[base + gone]
            ids[base + here] = self.merged[root // width]
            alive[base + gone] = False
            following[base + here] = after
            inner = after < length
            previous[(base + after)[inner]] = here[inner]
            before = previous[base + here]
            led = before >= 0
            leaves = np.full((3, len(at)), NONE, np.int64)  # of the vanished, the merged and the preceding place
            leaves[1][inner] = self.keys(ids[(base + here)[inner]], ids[(base + after)[inner]], here[inner], width)
            leaves[2][led] = self.keys(ids[(base + before)[led]], ids[(base + here)[led]], before[led], width)
            nodes = np.stack([gone, here, np.where(led, before, here)]) + width
            leaves[2][~led] = leaves[1][~led]
            trees = at * 2 * width
            tree[trees + nodes] = leaves
            while nodes[0, 0] > 1:
                nodes >>= 1
                tree[trees + nodes] = np.minimum(tree[trees + 2 * nodes], tree[trees + 2 * nodes + 1])
            at = at[tree[at * 2 * width + 1] < NONE]
        packed = ids[alive].astype("<u4").tobytes()
        ends = (np.cumsum(alive.reshape(n, width).sum(1)) * 4).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]

    def learn(self, words: set[str]) -> None:
        """Merge words that are not remembered yet, those of like length together."""
        by_width: dict[int, list[str]] = {}
        for word in words:
            if word not in self.known:
                size = len(word.encode())
                by_width.setdefault(max(2, 1 << (size - 1).bit_length()), []).append(word)
        for width, group in by_width.items():
            step = max(1, (1 << 19) // width)
            for i in range(0, len(group), step):
                part = group[i:i + step]
                self.known.update(zip(part, self.merge([w.encode() for w in part], width)))

    def sections(self, text: str) -> Iterator[str]:
        """A very long text cut between two words, where the tokenizer cuts anyhow."""
        start = 0
        while len(text) - start > 2 * AT_ONCE:
            found = self.cut_long.search(text, start + AT_ONCE)
            if not found:
                break
            yield text[start:found.start()]
            start = found.start()
        yield text[start:]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        out = []
        held, size = [], 0
        for k, text in enumerate(texts):
            parts = self.cut_added.split(text) if self.cut_added else [text]
            for part in parts:
                for section in ([part] if part in self.added else self.sections(part)):
                    held.append((k, section))
                    size += len(section)
                    if size >= AT_ONCE:
                        out += self.joined(held)
                        held, size = [], 0
        out += self.joined(held)
        ids = [b""] * len(texts)
        pieces: dict[int, list[bytes]] = {}
        for k, piece in out:
            pieces.setdefault(k, []).append(piece)
        for k, several in pieces.items():
            ids[k] = b"".join(several)
        return ids

    def joined(self, held: list[tuple[int, str]]) -> list[tuple[int, bytes]]:
        cut = [(k, [s] if s in self.added else self.cut_words.findall(s)) for k, s in held]
        words = set().union(*(w for _, w in cut)) if cut else set()
        if len(self.known) + len(words) > REMEMBERED:
            self.known = dict(self.added)
        self.known.update(self.added)
        self.learn(words)
        return [(k, b"".join(map(self.known.__getitem__, w))) for k, w in cut]

    def decode(self, ids: bytes) -> str:
        """The text of ids; ids outside the vocabulary stand for nothing, bytes that are no UTF-8 become U+FFFD."""
        numbers = np.frombuffer(ids, "<u4")
        numbers = numbers[numbers < self.size].astype(np.int64)
        lengths = self.length[numbers]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        places = np.repeat(self.start[numbers] - (ends - lengths), lengths) + np.arange(total)
        return self.spelling[places].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Bpe:
    return Bpe(path)


def round_trip(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bpe = tokenizer(path)
    for batch in batches:
        step = 256  # rows, so that what is in hand stays small
        for i in range(0, batch.num_rows, step):
            part = batch.slice(i, step)
            ids = bpe.encode([t or "" for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())],
                names=["doc_id", "ids", "decoded"])


def only_decoded(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bpe = tokenizer(path)
    for batch in batches:
        texts = pa.array([bpe.decode(i or b"") for i in batch.column(1).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["doc_id", "decoded"])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, ids, decoded), one for each row of ``docs``, in one pass without a shuffle.

    ``path`` names a byte-level BPE file. ``ids`` packs little-endian unsigned 32-bit numbers; ``decoded`` is the text
    read back from them. Special tokens found in a text count as such, as the file says. A NULL text is empty and has
    no ids; equal rows give equal rows, doc_id may be NULL or repeat, other columns are not looked at.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(partial(round_trip, path),
                                                    f"doc_id {kind}, ids binary, decoded string")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, decoded) from rows (doc_id, ids) as :func:`encode` packs them; NULL ids are an empty text."""
    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids").mapInArrow(partial(only_decoded, path), f"doc_id {kind}, decoded string")
