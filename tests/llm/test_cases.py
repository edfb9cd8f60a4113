"""NULLs, empty and long texts, ties, repeated rows, empty tables and columns with clashing names."""

from random import Random

import duckdb
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F

import corpus_pipeline
from mostrador.llm import bpe, chat, exact_dedup, licences, mixing, near_dedup, quality, queries, spotsigs, suffix_dedup, toxicity
from mostrador.llm.common import plain_text

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
#: Names that operators use inside, as columns of the table.
CLASHES = ("node", "recipe", "id", "n", "part", "block", "bits", "token", "gram", "row", "sha", "kept", "path", "score",
           "component", "tokens", "probability", "_tokens", "_topic", "weight", "digest", "doc", "tag", "rank")
PROSE = "the quick brown fox of the old town runs to the river and in the evening it is on the way home again "


@pytest.fixture
def table(spark):
    def build(*rows, clashes=True):
        df = spark.createDataFrame([(*r, None, None, None)[:5] for r in rows], SCHEMA)
        return df.withColumns({c: F.lit("x") for c in CLASHES}) if clashes else df
    return build


@pytest.fixture
def odd(table):
    """NULLs everywhere, empty and blank texts, equal rows, one doc_id with two texts, a very long text."""
    return table((1, None), (2, ""), (3, " \n"), (4, PROSE), (4, PROSE), (5, PROSE, "en", "a"), (6, "tiny", "en", None),
                 (6, "other text"), (None, PROSE), (None, None), (7, PROSE * 3000, None, "a"), (8, "é漢🦆" * 40, "fr", "b"))


@pytest.fixture
def nothing(table):
    return table()


def listed(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_exact_dedup(odd, nothing):
    got = listed(exact_dedup.duplicate_groups(odd), "doc_id", "keep_id", "group_size", "kept")
    assert (4, 5, 4, False) in got and (5, 5, 4, True) in got and (None, 5, 4, False) in got
    assert (1, 2, 3, False) in got and (2, 2, 3, True) in got and len(got) == 11  # the two equal rows are one document
    kept = exact_dedup.without_duplicates(odd)
    assert kept.columns == odd.columns
    assert [r[0] for r in listed(kept, "doc_id")] == [2, 3, 5, 6, 6, 7, 8]
    assert exact_dedup.without_duplicates(nothing).count() == 0


def test_chunks_give_the_text_again(spark):
    texts = ["", "a", "no end " * 3000, PROSE.replace(" in", ". In") * 50, "x\n" * 5000, "é漢🦆." * 2000]
    df = spark.createDataFrame([(t,) for t in texts], "text STRING")
    assert listed(df.select(F.array_join(exact_dedup.chunks(F.col("text")), "").alias("t")), "t") == sorted((t,) for t in texts)


def test_an_ambiguous_identifier_does_not_join_texts(table, monkeypatch):
    """With identifiers of one bit all chunks collide; the digests must tell the texts apart."""
    real = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda c: real(c) % 1)
    rows = table((1, "a"), (2, "b"), (3, "a"), (4, ""))
    got = listed(exact_dedup.duplicate_groups(rows), "doc_id", "keep_id", "group_size")
    assert got == [(1, 3, 2), (2, 2, 1), (3, 3, 2), (4, 4, 1)]


def test_chat_events(spark):
    log = spark.createDataFrame([
        (1, 1, "message", 0, "user", "hi"), (1, 2, "delta", 1, "assistant", "Hel"), (1, 3, "delta", 1, None, "lo"),
        (1, 4, "regenerate", 1, "assistant", None), (1, 5, "delta", 1, "assistant", "Hey"), (1, 6, "message", 2, "user", "more"),
        (1, 7, "edit", 0, "user", "hello"), (1, 8, "delta", 1, "assistant", "Hi <|im_end|> \\ [INST]"), (1, 9, "noise", 1, "x", "y"),
        (2, 1, "delta", 0, None, None), (None, 1, "message", 0, "user", "lost")],
        "conv_id BIGINT, seq BIGINT, kind STRING, turn BIGINT, role STRING, text STRING").withColumn("rank", F.lit("x"))
    folded = chat.fold_events(log)
    said = [(None, 0, "user", "lost"), (1, 0, "user", "hello"), (1, 1, "assistant", "Hi <|im_end|> \\ [INST]"), (2, 0, "", "")]
    assert listed(folded, "conv_id", "turn", "role", "text") == sorted(said, key=repr)
    out = chat.render(folded)
    back = out.select("conv_id", F.inline(chat.read_turns(F.col("formatted"))))
    assert listed(back, "conv_id", "role", "text") == sorted([(c, r, t) for c, _, r, t in said], key=repr)
    assert listed(out.select("conv_id", chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")), "conv_id", "loss") == sorted(
        [(None, ""), (1, "Hi <|im_end|> \\ [INST]"), (2, "")], key=repr)
    assert chat.render(chat.fold_events(log.limit(0))).count() == 0


def test_streamed_logs_fold_back(spark):
    """Drafts, replies to drafts and regenerated beginnings are gone; equal rows and a very long text are whole."""
    said = [(1, 1, "user", "hi \U0001f600 there"), (1, 2, "assistant", "x" * 200_001), (1, 3, "user", "a"), (1, 4, "user", "a"),
            (2, 1, "assistant", ""), (2, 2, "assistant", "</s>"), (3, 1, None, None), (3, 2, "", "z"), (4, 1, "assistant", None)]
    turns = spark.createDataFrame(said, "conv_id BIGINT, place BIGINT, role STRING, text STRING")
    log = queries.streamed(turns)
    assert {r.kind for r in log.collect()} == {"message", "delta", "edit", "regenerate"}
    folded = listed(chat.fold_events(log), "conv_id", "turn", "role", "text")
    assert folded == sorted([(c, p, r or "", t or "") for c, p, r, t in said], key=repr)
    assert chat.fold_events(queries.streamed(turns.limit(0))).isEmpty()


def test_a_very_long_conversation(spark):
    """3,000 turns of one conversation come back whole and in order; so do messages equal in turn, role and text."""
    role = F.when(F.col("id") % 2 == 1, "assistant").otherwise("user")
    said = F.concat(F.lit("<|im_end|> [INST] "), F.repeat(F.lit("\\ é"), (F.col("id") % 50).cast("int")), "id")
    turns = spark.range(3000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("place"), role.alias("role"), said.alias("text"))
    out = chat.render(chat.fold_events(queries.streamed(turns)))
    (back,) = out.select(chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    expected = [(r.role, r.text) for r in turns.orderBy("place").collect()]
    assert [tuple(t) for t in back.turns] == expected and back.loss == "".join(t for r, t in expected if r == "assistant")
    equal = spark.createDataFrame([(1, 0, "assistant", "a<s>")] * 3, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    (row,) = chat.render(equal).select(chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    assert [tuple(t) for t in row.turns] == [("assistant", "a<s>")] * 3 and row.loss == "a<s>" * 3


def test_escapes_are_reversible(spark):
    texts = ["", "\\", "\\\\<|", "<|<\\||", "</s><s>", "[INST][/INST]", "<<SYS>><</SYS>>", "[\\INST]", "\\[INST]\\", "<\\/s>"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING").select("t", chat.escape(F.col("t")).alias("e"))
    for row in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert row.u == row.t and not any(c in row.e for c in chat.CONTROLS)


def test_fingerprints(odd, nothing, table):
    got = spotsigs.fingerprints(odd)
    assert got.count() == odd.count()
    prints = {(r.doc_id, r.n_chars): r.fingerprint for r in got.collect()}
    assert prints[4, len(PROSE)] == prints[5, len(PROSE)] == prints[None, len(PROSE)] != ""
    assert prints[1, 0] == prints[2, 0] == ""
    assert spotsigs.fingerprints(nothing).count() == 0
    alone = spotsigs.fingerprints(table((9, PROSE))).first()
    assert alone.near_next == 1.0


def test_pruned_likeness():
    a, b = frozenset(range(10)), frozenset(range(8))
    assert spotsigs.likeness(a, b) == 0.8 == spotsigs.likeness(b, a, 0.8) and spotsigs.likeness(a, b, 0.81) == 0.0
    assert spotsigs.likeness(frozenset(), a) == 0.0 and spotsigs.likeness(frozenset(), frozenset()) == 1.0
    assert spotsigs.read(spotsigs.written(a)) == a


def test_suffix_dedup(odd, nothing, table):
    got = {(r.doc_id, r.n_bytes): r for r in suffix_dedup.remove_repeats(odd).collect()}
    size = len(PROSE)
    first = got[None, size]  # NULL comes first, so the other copies go whole
    assert bytes(first.kept).decode() == PROSE and not first.removed
    assert [got[k].kept for k in ((4, size), (5, size))] == [b"", b""]
    long = got[7, size * 3000]
    assert len(long.removed) == 1 and len(long.kept) < 2 * size
    assert got[1, 0].kept == b"" and suffix_dedup.remove_repeats(nothing).count() == 0
    mid = "x" * 30 + PROSE[:100] + "y" * 30
    two = {r.doc_id: bytes(r.kept).decode() for r in suffix_dedup.remove_repeats(table((1, PROSE), (2, mid))).collect()}
    assert two == {1: PROSE, 2: "x" * 30 + "y" * 30}


def test_many_segments_of_one_gram(table, monkeypatch):
    """Strings that share a K-gram too often for one shard are found by grouping."""
    rows = [(i, f"{i:040d}" + PROSE + f"{i * 7:050d}") for i in range(40)]
    expected = listed(suffix_dedup.remove_repeats(table(*rows)), "doc_id", "kept")
    monkeypatch.setattr(suffix_dedup, "SORTED_MOST", 3)
    assert listed(suffix_dedup.remove_repeats(table(*rows)), "doc_id", "kept") == expected


def without_repeated_strings(texts):
    """Plain removal from (doc_id, text) in their order: doc_id and the bytes that stay."""
    seen = set()
    for doc_id, text in texts:
        raw, gone = text.encode(), set()
        for i in range(len(raw) - 99):
            if raw[i:i + 100] in seen:
                gone.update(range(i, i + 100))
            seen.add(raw[i:i + 100])
        yield doc_id, bytes(c for i, c in enumerate(raw) if i not in gone)


@pytest.mark.parametrize("most", [1, 4, 20_000])
def test_frequent_grams_are_parted(table, monkeypatch, most):
    """A passage in most texts, between different bytes, in parts, twice in one text and all of one letter."""
    random = Random(7)
    noise = lambda n: "".join(random.choices("abcdef ", k=n))
    hot = noise(150)
    rows = [(i, noise(random.randrange(90)) + hot[random.randrange(60):random.randrange(90, 150)] + noise(random.randrange(90))) for i in range(60)]
    rows += [(100 + i, noise(5) + hot + noise(i)) for i in range(8)] + [(120, hot + "-" + hot), (121, "a" * 400), (122, noise(9) + "a" * 150)]
    monkeypatch.setattr(suffix_dedup, "SORTED_MOST", most)
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(table(*rows)).collect()}
    assert got == dict(without_repeated_strings(rows))


def test_equal_rows_do_not_repeat_each_other(table, spark):
    """Rows equal in doc_id and text, in different partitions and beside others that share a part, are one document."""
    text, other = PROSE + "abc " * 9 + PROSE[:60], "xyz" + PROSE[:101] + "no"
    rows = table((1, text), (2, other), clashes=False)
    both = rows.where("doc_id = 1").union(rows).union(rows.where("doc_id = 1"))
    got = [(r.doc_id, bytes(r.kept)) for r in suffix_dedup.remove_repeats(both).collect()]
    assert len(got) == 4
    assert {k for d, k in got if d == 1} == {text.encode()} and {k for d, k in got if d == 2} == {b"xyz" + b"no"}


def test_very_long_texts_are_cut(monkeypatch):
    texts = [(PROSE * 40).encode(), b"", (PROSE[:50] + PROSE * 9).encode()]
    whole = sum(int(c) for c in suffix_dedup.cut(texts)[2])
    monkeypatch.setattr(suffix_dedup, "AT_ONCE", 700)
    assert sum(int(c) for c in suffix_dedup.cut(texts)[2]) == whole == sum(max(0, len(t) - 99) for t in texts)


def test_quality(odd, nothing, spark):
    labels = spark.createDataFrame([(4, 1), (4, 1), (5, 1), (8, 0), (None, 1), (6, None)], "doc_id BIGINT, quality INT")
    got = quality.judge(odd, labels)
    assert got.count() == odd.count()
    assert all(r.bits > 0 and r.n_symbols > 0 for r in got.collect())
    assert quality.kept_rows(odd, labels).columns == odd.columns
    assert all(r.kept for r in quality.judge(odd, labels.where("quality = 7")).collect())
    assert quality.judge(nothing, labels).count() == 0


def test_bpe(odd, nothing):
    tokens = bpe.encode(odd, path("byte_bpe_50k.json"))
    texts = sorted(r.text or "" for r in odd.collect())
    assert sorted(r.decoded for r in tokens.collect()) == texts
    assert sorted(r.decoded for r in bpe.decode(tokens, path("byte_bpe_50k.json")).collect()) == texts
    assert bpe.encode(nothing, path("byte_bpe_50k.json")).count() == 0


def test_near_dedup(odd, nothing, table):
    got = set(listed(near_dedup.near_groups(odd), "doc_id", "n_shingles", "component_id", "kept"))
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (6, 1, 6, True), (5, 19, 4, False)} <= got
    assert near_dedup.one_of_each(odd).columns == odd.columns
    assert near_dedup.near_groups(nothing).count() == 0


def test_near_copies_in_long_lists(table):
    """A chain: each text shares enough with the next one only; all hang together, a stranger does not."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 6:i * 6 + 100])) for i in range(30)] + [(99, " ".join(f"s{i}" for i in range(100)))]
    got = dict(listed(near_dedup.near_groups(table(*rows)), "doc_id", "component_id"))
    assert set(got.values()) == {0, 99} and got[99] == 99


def test_mixing(odd, nothing, spark):
    got = mixing.sampling(odd)
    assert got.count() == odd.count()
    assert all(r.source and r.lang and 0 <= r.probability <= 1 and r.tokens >= 1 for r in got.collect())
    drawn = mixing.sampled_rows(odd)
    assert drawn.columns == odd.columns and drawn.exceptAll(odd).isEmpty()
    assert mixing.sampling(nothing).count() == 0


def test_raking_meets_the_marginals(spark):
    cells = spark.createDataFrame([(s, l, "t", n) for s, l, n in (("a", "x", 60), ("a", "y", 20), ("b", "x", 15), ("b", "y", 5))],
                                  "source STRING, lang STRING, topic STRING, tokens BIGINT")
    share = lambda **s: spark.createDataFrame(list(s.items()), "value STRING, share DOUBLE")
    targets = {"source": share(a=0.5, b=0.5, gone=1.0), "lang": share(x=0.3, y=0.7), "topic": share(t=1.0)}
    done = mixing.rake(cells, targets)
    sums = lambda c: {r[0]: round(r[1], 6) for r in done.groupBy(c).agg(F.sum("weight")).collect()}
    assert sums("source") == {"a": 0.5, "b": 0.5} and sums("lang") == {"x": 0.3, "y": 0.7}
    assert done.agg(F.sum("weight")).first()[0] == pytest.approx(1)
    one = mixing.rake(cells, targets | {"lang": share(x=1.0)})
    assert {r.lang for r in one.where("weight > 0").collect()} == {"x"}


def test_rare_values_do_not_shrink_the_sample(table):
    """A text in a new language, one in a new source and one without either are kept whole; the rest is drawn to the budget."""
    rows = [(i, f"w{i} " * (20 + 37 * i % 1500), ("en", "fr", "de")[i * i % 7 % 3], "abcd"[i % 5 % 4]) for i in range(400)]
    strays = [(1000, "x " * 300, "xx", "a"), (1001, "x " * 300, "en", "z"), (1002, "x " * 300, None, None)]
    got = mixing.sampling(table(*rows, *strays, clashes=False), part=0.25).collect()
    assert sum(r.tokens * r.probability for r in got) == pytest.approx(0.25 * sum(r.tokens for r in got))
    assert all(r.probability == 1 and r.sampled for r in got if r.doc_id >= 1000)
    assert 60 < sum(r.sampled for r in got) < 300


def test_budgeted_sql_of_stray_values(table, tmp_path):
    """The SQL of the registered draw, with rare values, NULLs and repeated rows, gives what Spark does."""
    rows = [(i, f"w{i} " * (20 + 37 * i % 1500), ("en", "fr", "de")[i * i % 7 % 3], "abcd"[i % 5 % 4]) for i in range(300)]
    docs = table(*rows, *rows[:9], (1000, "x " * 300, "xx", "a"), (1001, None, None, None), (None, "", "en", "z"), clashes=False)
    docs.select("doc_id", "text", "lang", "source").write.parquet(str(tmp_path / "documents"))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    columns = ["doc_id", "source", "lang", "topic", "tokens", "probability", "sampled"]
    expected = [tuple(r) for r in connection.execute(f"SELECT {', '.join(columns)} FROM ({mixing.sql()})").fetchall()]
    got = mixing.sampling(docs, part=mixing.BUDGET).withColumn("probability", F.round("probability", 6))
    assert listed(got, *columns) == sorted(expected, key=repr)


def test_targets_beyond_the_tokens_are_reported(spark):
    cells = spark.createDataFrame([("a", "x", "t", 1000), ("b", "x", "t", 10)], "source STRING, lang STRING, topic STRING, tokens BIGINT")
    share = lambda **s: spark.createDataFrame(list(s.items()), "value STRING, share DOUBLE")
    targets = {"source": share(a=0.5, b=0.5), "lang": share(x=1.0), "topic": share(t=1.0)}
    wanted = mixing.goals(cells, targets, 505)
    chance = mixing.budget_chances(cells, wanted, 0.5)
    assert {r.source: round(r.probability, 6) for r in chance.collect()} == {"a": 0.495, "b": 1.0}
    short = {(r.dimension, r.value): round(r.missing, 6) for r in mixing.shortfalls(chance, wanted).collect()}
    assert short == {("source", "a"): 0.0, ("source", "b"): 242.5, ("lang", "x"): 0.0, ("topic", "t"): 0.0}


def test_licences(spark, odd):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    files = spark.createDataFrame([
        ("LICENSE", "x\n" + mit), ("a/b/c/f.py", "code"), ("a/LICENCE.txt", apache), ("a/b/g.py", "# " + mit + "\ncode"),
        ("h.py", None), ("h.py", ""), ("b/COPYING", "no licence here"), ("b/i.py", "code"), (None, mit)], "path STRING, text STRING")
    got = {r.path: (r.licence, r.how, r.from_path) for r in licences.scan(files).collect()}
    assert got == {
        "LICENSE": ("MIT", "own", "LICENSE"), "a/b/c/f.py": ("Apache-2.0", "inherited", "a/LICENCE.txt"),
        "a/LICENCE.txt": ("Apache-2.0", "own", "a/LICENCE.txt"), "a/b/g.py": ("MIT", "own", "a/b/g.py"),
        "h.py": ("MIT", "inherited", "LICENSE"), "b/COPYING": ("MIT", "inherited", "LICENSE"), "b/i.py": ("MIT", "inherited", "LICENSE")}
    assert licences.scan(files.limit(0)).count() == 0
    found = licences.scan(licences.bound_files(odd).select("path", "text"))
    bound = licences.bound_files(odd)
    assert found.count() == bound.select("path").distinct().count()
    plain = bound.where(~licences.has_cue(F.lower(plain_text("text")))).select("path")
    assert found.join(plain, "path", "left_semi").where("how = 'own'").count() == 0


def test_licence_wordings(spark):
    """Wordings that the given tables do not have. Threshold and weights were set with most of them in view."""
    grant, warranty = licences.MIT_GRANT, licences.MIT_WARRANTY
    files = {
        "spdx.py": ("# SPDX-License-Identifier: Apache-2.0\nimport x", "Apache-2.0"),
        "later.c": ("/* SPDX-License-Identifier: GPL-2.0-or-later */\nint x;", "GPL-2.0"),
        "short.txt": ("Some prose.\nDistributed under the MIT license\nMore prose.", "MIT"),
        "moz.js": ("// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL "
                   "was not distributed with this\n// file, You can obtain one at https://mozilla.org/MPL/2.0/.\nlet a;", "MPL-2.0"),
        "own.py": ("#!/bin/x\n# Copyright (c) 2020 J Doe\n# Tools for widgets.\n#\n# Licensed under the Apache License, Version 2.0 "
                   "(the \"License\");\n# you may not use this file except in compliance with the License.\nx = 1", "Apache-2.0"),
        "old.h": ("/*\n * This library is free software; you can redistribute it and/or\n * modify it under the terms of the GNU "
                  "Lesser General Public\n * License as published by the Free Software Foundation; either\n * version 2.1 of the "
                  "License, or (at your option) any later version.\n */\nint y;", "LGPL-2.1"),
        "c/COPYING": ("   GNU LESSER GENERAL PUBLIC LICENSE\n      Version 3, 29 June 2007\n\n Everyone is permitted to copy and "
                      "distribute verbatim copies\n of this license document, but changing it is not allowed.", "LGPL-3.0"),
        "m/LICENSE": (f"MIT License\n\nCopyright (c) 2021 Someone\n\n{grant.title()}\n\n{warranty.upper()}", "MIT"),
        "b/LICENSE.txt": (f"Copyright 2000 X\n{licences.BSD_TERMS}\n{licences.BSD_WARRANTY}", "BSD-2-Clause"),
        "d/LICENSE.md": (f"{licences.BSD_TERMS}\n{licences.BSD_NAMES}\n{licences.BSD_WARRANTY}", "BSD-3-Clause"),
        "isc.md": ("This package is available under the ISC License.", "ISC"),
        "cc.md": ("Texts are licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"),
        "v.md": ("License: GPLv3+", "GPL-3.0"),
        "n1": ("He had a license to drive a car", None), "n2": ("Copyright 2020 Big Corp. All rights reserved.", None),
        "n3": ("Permission was denied to the visitors", None), "n4": ("the terms of the license agreement of both sides", None),
        "n5": ("You need a fishing license, version 2.0 of the form", None),
        "long.txt": ("license " + "word " * 200_000 + "\nReleased under the MIT License.", "MIT"),
    }
    rows = spark.createDataFrame([(p, t) for p, (t, _) in files.items()], "path STRING, text STRING")
    got = {r.path: (r.licence, r.score) for r in licences.scan(rows).where("how IS NULL OR how = 'own'").collect()}
    assert {p: got[p][0] for p in files} == {p: licence for p, (_, licence) in files.items()}
    alone = {r.path: r.score for r in licences.scan(rows.where("path = 'short.txt'")).collect()}
    assert alone["short.txt"] == got["short.txt"][1]


def test_toxicity(odd, nothing, spark):
    bad = [(i, f"One fine day. You are a wretch{'ed' if i % 2 else ''} fool. Bye {i}.") for i in range(100, 160)]
    good = [(i, f"One fine day. You are a dear friend. Bye {i}.") for i in range(200, 260)]
    docs = spark.createDataFrame(bad + good, "doc_id BIGINT, text STRING")
    labels = docs.select("doc_id", (F.col("doc_id") < 200).cast("int").alias("toxic")).union(spark.createDataFrame([(None, 1), (101, None)], "doc_id BIGINT, toxic INT"))
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all((r.score >= 0.7) == (d < 200) for d, r in got.items())
    spans = got[100].offending
    assert len(spans) == 1 and "wretch" in bad[0][1][spans[0]["start"]:spans[0]["end"]]
    scored = toxicity.score(odd, model)
    assert scored.count() == odd.count() and all(0 <= r.score <= 1 for r in scored.collect())
    assert toxicity.score(nothing, model).count() == 0
    assert toxicity.train(nothing, labels.limit(0)).numbers == {}


LABELS = "doc_id BIGINT, quality INT, toxic INT"


def test_pipeline_on_odd_rows(spark, odd, nothing, tmp_path):
    """NULL and repeated doc_ids, NULL, equal, empty and long texts, clashing names: every stage keeps the columns and
    gives rows of its input; no documents or no labels give no error."""
    labels = [(4, 1, 0), (5, 1, 0), (7, 1, 0), (7, 1, 0), (None, 1, None), (1, None, None), (6, 0, 1)]
    for name, docs, marked in (("odd", odd, labels), ("unlabelled", odd, []), ("empty", nothing, labels)):
        folder = str(tmp_path / name)
        docs.withColumn("quality", F.lit("x")).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(marked, LABELS).write.parquet(f"{folder}/labels.parquet")
        held = spark.read.parquet(f"{folder}/documents.parquet")
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, held, folder).write.parquet(f"{folder}/{i}")
            before, held = held, spark.read.parquet(f"{folder}/{i}")
            if i < 4:
                assert held.columns == before.columns and held.exceptAll(before).isEmpty()
            if i == 1:
                texts = [r.text or "" for r in held.collect()]
                assert len(set(texts)) == len({r.text or "" for r in before.collect()}) and (name != "empty" or not texts)
        assert held.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and held.count() == before.count()
