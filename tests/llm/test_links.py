"""Links between sets against all pairs, and how many pairs they take."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mostrador.llm import near_dedup
from mostrador.llm.common import components

SCHEMA = "doc_id BIGINT, text STRING"


def leaders(sets, share):
    """The smallest key that each set reaches, by comparing all pairs."""
    leader = {d: d for d in sets}

    def root(d):
        while leader[d] != d:
            d = leader[d]
        return d
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            common = len(sets[a] & sets[b])
            if 100 * common >= share * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                leader[max(x, y)] = min(x, y)
    return {d: root(d) for d in keys}


def grown(rng, n):
    """Sets around a few cores: near copies, copies of copies, parts of cores, mixtures of passages."""
    core = [list(range(1000 * i, 1000 * i + 40)) for i in range(3)]
    passages = [list(range(9000 + 10 * i, 9000 + 10 * i + 10)) for i in range(12)]
    sets = {}
    for d in range(n):
        kind = rng.integers(0, 4)
        if kind == 3:
            own = {x for i in rng.choice(12, rng.integers(3, 6), replace=False) for x in passages[i]}
        else:
            own = set(core[kind]) if not sets or rng.random() < 0.5 else set(sets[int(rng.integers(0, d))])
        own = {x for x in own if rng.random() > 0.06} | {int(rng.integers(0, 10_000)) for _ in range(rng.integers(0, 4))}
        sets[d] = own or {d}
    return sets


@pytest.mark.parametrize("seed,share,short", [(1, 85, 1), (2, 80, 1), (4, 60, 3)])
def test_what_is_left_is_compared_exactly(spark, monkeypatch, seed, share, short):
    monkeypatch.setattr(near_dedup, "SHORT", short)
    sets = grown(np.random.default_rng(seed), 100)
    table = spark.createDataFrame([(d, len(s), sorted(s)) for d, s in sets.items()], "node BIGINT, size BIGINT, members ARRAY<BIGINT>")
    state = table.select("node", F.col("node").alias("component"))
    found = near_dedup.confirmed(near_dedup.pairs_by_shingles(state, table, share), None, table, share)
    labels = {r.node: r.component for r in components(found).collect()}
    assert {d: labels.get(d, d) for d in sets} == leaders(sets, share)


@pytest.mark.parametrize("share", [85, 80])
def test_groups_of_near_copies_and_mixtures(spark, share, monkeypatch):
    monkeypatch.setattr(near_dedup, "SHORT", 2)
    rng = np.random.default_rng(share)
    passages = [" ".join(f"w{rng.integers(0, 10 ** 6)}" for _ in range(20)) for _ in range(12)]
    base = [" ".join(f"v{rng.integers(0, 10 ** 6)}" for _ in range(80)) for _ in range(2)]
    texts = {}
    for d in range(160):
        if d % 2:
            words = base[d % 4 // 2].split()
            for i in rng.integers(0, len(words), rng.integers(0, 4)):
                words[i] = f"x{rng.integers(0, 10 ** 6)}"
            texts[d] = " ".join(words)
        else:
            texts[d] = " ".join(passages[i] for i in rng.choice(12, rng.integers(3, 6), replace=False))
    sets = {d: {tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)} for d, t in texts.items()}
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(spark.createDataFrame(list(texts.items()), SCHEMA), share).collect()}
    assert got == leaders(sets, share)


def test_mixtures_make_pairs_in_proportion(spark):
    """Texts of 10 out of 40 passages, hardly any two alike: all pairs would grow with the square."""
    rng = np.random.default_rng(7)
    passages = [list(range(100 * i, 100 * i + 30)) for i in range(40)]
    made = []
    for n in (400, 1600):
        sets = [sorted(x for i in rng.choice(40, 10, replace=False) for x in passages[i]) for _ in range(n)]
        table = spark.createDataFrame([(d, len(s), s) for d, s in enumerate(sets)], "node BIGINT, size BIGINT, members ARRAY<BIGINT>")
        state = table.select("node", F.col("node").alias("component"))
        made.append(near_dedup.pairs_by_shingles(state, table, 85).count())
    assert made[0] <= near_dedup.SHORT * 400 and made[1] <= near_dedup.SHORT * 1600  # of 79,800 and 1,279,200


def family(rng, n, lost):
    """Sets that each lack ``lost`` runs of five out of 400 and have as many of their own: near copies, hardly ever linked."""
    sets = {}
    for d in range(n):
        gone = {x for i in rng.choice(396, lost, replace=False) for x in range(i, i + 5)}
        sets[d] = sorted(set(range(400)) - gone) + [10_000 + 100 * d + i for i in range(len(gone))]
    return sets


def counting(monkeypatch):
    """The numbers of rows that the rounds of parting write, as they are made."""
    made, write = [], near_dedup.stored

    def stored(df):
        out = write(df)
        if out.columns == near_dedup.PATHS:
            made.append(out.count())
        return out
    monkeypatch.setattr(near_dedup, "stored", stored)
    return made


def test_strays_of_a_large_group_make_rows_in_proportion(spark, monkeypatch):
    """Nine in ten sets hang together and the others do not: parting them all again and again would make many rows for each."""
    made, totals = counting(monkeypatch), []
    for n in (100, 400):
        sets = family(np.random.default_rng(n), n, 6)
        table = spark.createDataFrame([(d, len(s), s) for d, s in sets.items()], "node BIGINT, size BIGINT, members ARRAY<BIGINT>")
        state = table.select("node", F.expr("if(node % 10 = 0, node, 1)").alias("component"))
        made.clear()
        pairs = near_dedup.pairs_by_shingles(state, table, 80)
        assert pairs.count() <= n  # of 945 and 15,180 that meet
        got = near_dedup.confirmed(pairs, None, table, 80)
        group = state.select("node", "component")
        want = spark.createDataFrame([*leaders({d: set(s) for d, s in sets.items()}, 80).items()], "a BIGINT, b BIGINT")
        assert set(components(got.union(group)).collect()) == set(components(want.union(group)).collect())
        totals.append(sum(made))
        assert totals[-1] <= 3 * made[0]
    assert totals[1] <= 6 * totals[0]


@pytest.mark.parametrize("seed,share,block", [(5, 85, 1), (6, 80, 300), (7, 60, 3000)])
def test_blocks_are_compared_exactly(spark, monkeypatch, seed, share, block):
    for name, value in (("SHORT", 1), ("PARTED", 0), ("BLOCK", block)):
        monkeypatch.setattr(near_dedup, name, value)
    sets = grown(np.random.default_rng(seed), 60)
    table = spark.createDataFrame([(d, len(s), sorted(s)) for d, s in sets.items()], "node BIGINT, size BIGINT, members ARRAY<BIGINT>")
    state = table.select("node", F.col("node").alias("component"))
    found = near_dedup.confirmed(near_dedup.pairs_by_shingles(state, table, share), None, table, share)
    labels = {r.node: r.component for r in components(found).collect()}
    assert {d: labels.get(d, d) for d in sets} == leaders(sets, share)


def exploded_broadcasts(df):
    """Broadcasts of the plan that ran whose rows come from an explode without a shuffle that counted them."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    found, inside, counted = [], None, None
    for line in plan.splitlines():
        depth = len(re.match("[ :]*([+:]- )?", line)[0])
        if "BroadcastExchange" in line:
            inside, counted = depth, None
        elif inside is not None and depth <= inside:
            inside = None
        if inside is None:
            continue
        if counted is None or depth <= counted:
            counted = depth if re.search("ShuffleQueryStage| Exchange ", line) else None
        if counted is None and re.search("Generate |MapInArrow ", line):
            found.append(line)
    return found


def test_nothing_exploded_is_broadcast(spark, monkeypatch):
    """Spark sizes a file's rows before an explode: 48 rows of each signature, all shingles of each set."""
    monkeypatch.setattr(near_dedup, "SHORT", 2)
    sets = grown(np.random.default_rng(3), 60)
    docs = spark.createDataFrame([(d, " ".join(f"w{x} a b c d" for x in sorted(s))) for d, s in sets.items()], SCHEMA)
    found, plain = [], near_dedup.stored
    monkeypatch.setattr(near_dedup, "stored", lambda df: found.extend(exploded_broadcasts(df)) or plain(df))
    near_dedup.near_groups(docs).collect()
    assert not found
