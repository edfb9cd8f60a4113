"""Importance resampling, hard negatives and quality rules: plain versions, odd rows, empty tables."""

import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from mostrador.llm import divergence, hard_negatives, registry, target_resampling
from test_cases import CLASHES, PROSE, SCHEMA

QUERIES = registry.queries()


@pytest.fixture
def table(spark):
    def build(*rows):
        df = spark.createDataFrame([(*r, None, None, None)[:5] for r in rows], SCHEMA)
        return df.withColumns({c: F.lit("x") for c in (*CLASHES, "word", "language", "vector", "bucket", "buckets", "place")})
    return build


@pytest.fixture
def vectors(spark):
    def build(*rows):
        df = spark.createDataFrame([r for r in rows], "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT")
        return df.withColumns({c: F.lit("x") for c in (*CLASHES, "vector", "anchor", "wanted")})
    return build


# -- op11


def plain_resampling(texts, target, runs=(1,), least=20, part=10, buckets=10000):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
        return len(words), [zlib.crc32(" ".join(words[i:i + n]).encode()) % buckets for n in runs for i in range(len(words) - n + 1)]
    own = [(d, *features(t)) for d, t in texts]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for d, n, f in own:
        h = int(sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    drawn = {id(r): i + 1 for i, r in enumerate(able[:len(able) * part // 100])}
    return sorted(((*r[:4], drawn.get(id(r))) for r in out), key=repr)


def got_resampling(df):
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_resampling_query(spark):
    texts = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert got_resampling(QUERIES["op11_resampling"](spark, DATA)) == plain_resampling(texts, target)


@pytest.mark.parametrize("runs", [(1,), (1, 2), (3,)])
def test_resampling_of_odd_rows(table, runs):
    rows = [(1, None), (2, ""), (3, " \n-"), (4, PROSE), (4, PROSE), (5, PROSE + " X"), (None, PROSE), (None, None),
            (6, "ÉTÉ Straße漢 a1B2\0c"), (7, PROSE * 3000), (8, "a" * 70000), (9, "É-" * 40)]
    docs = table(*rows)
    target = ["the quick brown fox", None, "été"]
    got = got_resampling(target_resampling.resample(docs, table(*((0, t) for t in target)), runs, part=50))
    assert got == plain_resampling(rows, target, runs, part=50)


def test_resampling_of_nothing(table):
    assert target_resampling.resample(table(), table((1, PROSE))).count() == 0
    rows = [(1, PROSE * 2), (2, PROSE * 2), (3, "x")]
    assert got_resampling(target_resampling.resample(table(*rows), table(), part=50)) == plain_resampling(rows, [], part=50)


def test_words_are_not_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(target_resampling, "PIECE", 7)
    text = "abc defghijklmno é漢 p qrs t-u v " * 5
    for runs in ((1,), (2, 3)):
        words, found = target_resampling.Features(runs, 1000)(text)
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        assert words == len(own)
        assert Counter(found.tolist()) == Counter(
            zlib.crc32(" ".join(own[i:i + n]).encode()) % 1000 for n in runs for i in range(len(own) - n + 1))


# -- op12


def test_inner_products_are_exact():
    rng = np.random.default_rng(1)
    for bound, d in ((2, 1), (200, 64), (2 ** 20, 64), (2 ** 28, 16), (2 ** 30, 3), (1, 0), (0, 5)):
        a, c = (rng.integers(-bound, bound + 1, (n, d)) for n in (7, 83))
        want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in c] for p in a]
        assert hard_negatives.inner_products(a, c).tolist() == want
    one = np.array([[5, -7]])
    assert hard_negatives.inner_products(one, one).tolist() == [[74]]


def plain_negatives(rows, every=100):
    held = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, [math.floor(256 * float(np.float32(x))) for x in v])
        held[i] = min(held.get(i, row), row)
    out = []
    for i, (label, v) in held.items():
        if i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j, other) for j, (other, w) in held.items() if j != i and len(w) == len(v)]
        for p, j, _ in sorted(s for s in scored if s[2] == label)[:5]:
            fit = sorted(s for s in scored if s[2] != label and 30 * -p <= 100 * -s[0] <= 90 * -p)[:10]
            out += [(i, j, rank, k, -p, -n) for rank, (n, k, _) in enumerate(fit, 1)]
    return sorted(out)


def test_negatives_of_odd_rows(vectors, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).round(2).tolist(), i % 3) for i in range(-200, 500)]
    rows += [(600, [0.1] * 8, None), (700, None, 1), (800, [0.1] * 7 + [None], 1), (900, [0.1] * 7 + [float("nan")], 1),
             (1000, [float("inf")] * 8, 1), (None, [0.1] * 8, 1), (1100, [], 1), (1101, [], 1), (1102, [], 2),
             (1200, [1.0, 2.0], 0), (1201, [1.0, 2.0], 0), (1202, [0.5, 1.0], 1), (100, [9.0] * 8, 2), (7, [0.5] * 8, 0)]
    rows += [(i, [0.25] * 8, i % 2) for i in range(2000, 2300)]  # ties
    monkeypatch.setattr(hard_negatives, "CANDIDATES", 150)
    got = hard_negatives.hard_negatives(vectors(*rows))
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows)
    assert dict(got.dtypes)["rank"] == "int"


def test_negatives_of_nothing_and_of_large_components(vectors):
    assert hard_negatives.hard_negatives(vectors()).count() == 0
    assert hard_negatives.hard_negatives(vectors((1, [1.0], 1), (2, [1.0], 2))).count() == 0  # no anchor
    large = [(0, [2.0 ** 20, 1.0], 1), (1, [2.0 ** 20, 3.0], 1), (2, [2.0 ** 19, 7.0], 2), (3, [2.0 ** 50, 1.0], 2)]
    got = [tuple(r) for r in hard_negatives.hard_negatives(vectors(*large)).collect()]
    assert got == plain_negatives(large[:3]) != []  # the last is longer than scores allow


def test_anchors_stream_past_candidates():
    """A part's anchors may come in any number of batches, and a part without candidates gives nothing."""
    kinds = pa.schema([(c, pa.int64()) for c in ("anchor_id", "positive_id", "positive_score")])
    row = lambda part, anchor, i: {"part": part, "anchor": anchor, "vec_id": i, "label": 1, "vector": [i], "wanted": None}
    rows = [row(0, False, i) for i in (1, 2, 3)] + [row(0, True, i) for i in (2, 3, 4)] + [row(1, True, 5)] + [row(2, False, 6)]
    sent = pa.schema([("part", pa.int64()), ("anchor", pa.bool_()), ("vec_id", pa.int64()), ("label", pa.int64()),
                      ("vector", pa.list_(pa.int64())), ("wanted", pa.list_(pa.int64()))])
    want = [(2, 3, 6), (2, 1, 2), (3, 2, 6), (3, 1, 3), (4, 3, 12), (4, 2, 8)]
    for size in (1, 2, 8):
        batches = [pa.RecordBatch.from_pylist(rows[i:i + size], sent) for i in range(0, len(rows), size)]
        found = [tuple(r.values()) for b in hard_negatives.beside(hard_negatives.like_it(2), kinds)(iter(batches)) for r in b.to_pylist()]
        assert found == want


# -- op13


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    hit = {i + j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), failed)


def plain_distance(counts, reference):
    p, q = ([x / sum(v) for x in v] for v in (counts, reference))
    half = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b) if x)
    return math.sqrt(max(0, (half(p, q) + half(q, p)) / 2))


def plain_rules(docs, good):
    """The whole of :func:`divergence.quality_rules` over (doc_id, text, lang), with the documents called good."""
    of_class = lambda t: [sum(divergence.class_of(c) == k for c in t) for k in divergence.CLASSES]
    split = lambda t: [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    words, classes = {}, {}
    for d, t, lang in docs:
        if d in good:
            words.setdefault(lang or "", Counter()).update(split(t or ""))
            classes.setdefault(lang or "", []).append(of_class(t or ""))
    out = []
    for d, t, lang in docs:
        counts, own = plain_counts(t), words.get(lang or "", Counter())
        kept, far = not counts[-1], (None, None)
        if counts[0] >= 50 and sum(own.values()) >= 1000:
            common = sorted(own, key=lambda w: (-own[w], w))[:50]
            bars = lambda c: [*(c[w] for w in common), sum(c.values()) - sum(c[w] for w in common)]
            far = (plain_distance(bars(Counter(split(t))), bars(own)),
                   plain_distance(of_class(t), [sum(x) for x in zip(*classes[lang or ""])]))
            kept &= far[0] <= 0.12 + math.sqrt(50 / (8 * math.log(2) * counts[0])) and far[1] <= 0.06 + math.sqrt(4 / counts[0])
        out.append((d, *counts, kept, *(x and round(x, 6) for x in far)))
    return sorted(out, key=repr)


def got_rules(df):
    assert df.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                          "word_distance", "class_distance"]
    return sorted(((*r[:8], *(x and round(x, 6) for x in r[8:])) for r in df.collect()), key=repr)


def test_rules_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = spark.read.parquet(f"{DATA}/labels.parquet").collect()
    got = got_rules(QUERIES["op13_quality_rules"](spark, DATA))
    assert got == plain_rules(docs, {r.doc_id for r in labels if r.quality == 1})
    kept = {r[0]: r[7] for r in got}
    assert np.mean([kept[r.doc_id] for r in labels if r.quality == 1]) > 0.95
    assert np.mean([kept[r.doc_id] for r in labels if r.quality == 0]) < 0.3


def test_rules_of_odd_rows(spark, table):
    rng = np.random.default_rng(3)
    prose = lambda n: " ".join(rng.choice(PROSE.split(), n)) + "."
    rows = [(i, prose(120), "en") for i in range(20)]
    rows += [(30, None, "en"), (31, "", None), (32, " \n\n", "en"), (33, "a b\na b\n\na b \n\x0b\n", "en"), (34, prose(60).upper(), "en"),
             (35, " ".join(f"{w}$$$" for w in prose(300).split()), "en"), (36, prose(80), None), (36, prose(80), None), (None, prose(80), "en"),
             (37, "x y z w v " * 4000, "en"), (38, "é漢🦆 #*$%&|<> ٣ ǅ _—", "fr"), (39, "k" * 200_000, "en"), (40, prose(3000), "en"),
             (41, "one two three four five six seven eight nine ten", "en"), (42, "\x1c\x85\xa0 a\x1cb\r\nc", "en")]
    docs = table(*((d, t, lang) for d, t, lang in rows))
    labels = spark.createDataFrame([(i, 1) for i in range(20)] + [(40, 1), (40, 0), (0, 1), (34, None), (None, 1)], "doc_id BIGINT, quality INT")
    got = got_rules(divergence.quality_rules(docs, labels))
    assert got == plain_rules(rows, set(range(20)))
    kept = {r[0]: r[7] for r in got}
    assert kept[3] and kept[41] and not (kept[30] or kept[31] or kept[34] or kept[35] or kept[37])


def test_rules_of_nothing(spark, table):
    labels = spark.createDataFrame([], "doc_id BIGINT, quality INT")
    assert divergence.quality_rules(table(), labels).count() == 0
    (row,) = divergence.quality_rules(table((1, PROSE * 3, "en")), labels).collect()
    assert row.base_failed and row.word_distance is None


def test_counts_do_not_depend_on_how_texts_are_batched(monkeypatch):
    texts = ["a b c d e f a b c d e", "a b c d e", "", "f a b c d e f a b c d e", "\n", "z"] * 3
    want = [plain_counts(t)[:5] for t in texts]
    for size in (1, 5, 10 ** 6):
        monkeypatch.setattr(divergence, "AT_ONCE", size)
        got = []
        for start, end in divergence.in_parts(texts):
            counted, *_ = divergence.base_counts(texts[start:end], divergence.class_table())
            got += list(zip(*(c.tolist() for c in counted.values())))
        assert got == want
