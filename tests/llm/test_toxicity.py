"""Form choice, fit and scores of the toxicity model against plain versions, one document and sentence at a time."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from mostrador.llm import toxicity

TEXTS = [
    "You are a wretch. Go away! Fine day", "Wretched fool. Wretched fool. Wretched fool", "A fine day.\nA fool said so", "", "...",
    "Fool, wretch", "Kind words. Kind words. Kind words", "The fool\nthe fool\nthe WRETCH of Ünal"]


def plain_forms(text):
    return {f for w in re.findall(r"[^\W\d_]+", text.lower()) for f in {"=" + w} | {w[:n] for n in range(4, 9) if n < len(w)}}


def plain_sentences(text, numbers):
    return [sorted(numbers[f] for f in plain_forms(s) if f in numbers) for s in re.split(r"[.!?\n]+", text) if s]


def plain_score(text, numbers, weights, offset):
    clean = 1.0
    for ids in plain_sentences(text, numbers):
        clean *= 1 - 1 / (1 + math.exp(-offset - sum(weights[i] for i in ids)))
    return 1 - clean


def plain_fit(bags, labels, n_forms, steps):
    n = len(labels)
    w = [0.0] * n_forms + [math.log(0.5 / max(1.0, sum(map(len, bags)) / n))]
    first, second = [0.0] * len(w), [0.0] * len(w)
    for step in range(1, steps + 1):
        slope = [0.0] * len(w)
        for bag, label in zip(bags, labels):
            chances = [1 / (1 + math.exp(-w[-1] - sum(w[i] for i in ids))) for ids in bag]
            toxic = 1 - math.prod(1 - p for p in chances)
            for ids, p in zip(bag, chances):
                step_of = p * (1 - 1 / max(toxic, 1e-12) if label else 1.0) / n
                for i in [*ids, n_forms]:
                    slope[i] += step_of
        for i in range(len(w)):
            g = slope[i] + (toxicity.RIDGE * w[i] / math.sqrt(n) if i < n_forms else 0)
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            w[i] -= toxicity.RATE * first[i] / (1 - 0.9 ** step) / (math.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-9)
            if i < n_forms:
                w[i] = max(w[i], 0.0)
    return w[:-1], w[-1]


def test_score_is_the_noisy_or_of_all_sentences():
    numbers = {"=fool": 0, "wret": 1, "=wretch": 2, "=ünal": 3}
    weights = toxicity.Weights(numbers, np.array([2.0, 1.5, 0.5, 3.0]), -4.0)
    for text in TEXTS:
        got, offending = weights.score(text, toxicity.Known(numbers))
        assert got == pytest.approx(plain_score(text, numbers, weights.of_form, weights.offset), abs=1e-12)
        for span in offending:
            own = plain_score(text[span["start"]:span["end"]], numbers, weights.of_form, weights.offset)
            assert span["score"] == pytest.approx(own) and own >= toxicity.OFFENDING_FROM


def test_training_equals_the_plain_version(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 40)
    bad = [f"One fine day. You are a wretch{'ed' if i % 2 else ''} fool. Bye {i}. You are a wretched fool." for i in range(40)]
    good = [f"One fine day. You are a dear friend. Bye {i}. A fool fell." for i in range(40)]
    texts = dict(enumerate(bad + good))
    rows = [(i, t) for i, t in texts.items()] + [(3, "zzz is the greater text of this doc_id")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    labels = spark.createDataFrame([(i, int(i < 40), 9) for i in texts], "doc_id BIGINT, toxic INT, text INT")
    model = toxicity.train(docs, labels)

    learned = {i: t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 3 != 1}
    known = {i: int(i < 40) for i in learned}
    n, n_bad = len(known), sum(known.values())
    seen = Counter(f for t in learned.values() for f in plain_forms(t))
    toxic = Counter(f for i, t in learned.items() if known[i] for f in plain_forms(t))

    def g2(f):
        cells = [(toxic[f], seen[f] * n_bad), (seen[f] - toxic[f], seen[f] * (n - n_bad)),
                 (n_bad - toxic[f], (n - seen[f]) * n_bad), (n - n_bad - seen[f] + toxic[f], (n - seen[f]) * (n - n_bad))]
        return 2 * sum(o * math.log(o * n / e) for o, e in cells if o)
    chosen = {f for f in seen if seen[f] >= 4 and g2(f) >= 25 and toxic[f] * n > seen[f] * n_bad}
    assert set(model.numbers) == chosen and chosen
    bags = [plain_sentences(t, model.numbers) for t in learned.values()]
    weights, offset = plain_fit(bags, list(known.values()), len(chosen), 40)
    assert model.of_form == pytest.approx(weights, abs=1e-6) and model.offset == pytest.approx(offset, abs=1e-6)
