"""Sliced ranking and quotas against plain sorting, with one group holding most rows."""

import random

import pytest
from pyspark.sql import functions as F

from mostrador.functions.ranks import first_within_quota, sliced_rank
from mostrador.operators import catalog, coupons


def hot_rows(seed, n=3000):
    dice = random.Random(seed)
    return [("hot" if dice.random() < 0.6 else f"g{dice.randrange(5)}", dice.randrange(200), i) for i in range(n)]


def test_sliced_rank_equals_a_sort(spark):
    data = hot_rows(1)
    df = spark.createDataFrame(data, "g STRING, t INT, id INT")
    got = {r["id"]: (r["rank"], r["size"]) for r in sliced_rank(df, ["g"], F.floor(F.col("t") / 10), [F.col("t"), F.col("id")]).collect()}
    expected = {}
    for group in {g for g, _, _ in data}:
        ordered = sorted((t, i) for g, t, i in data if g == group)
        expected.update({i: (place, len(ordered)) for place, (_, i) in enumerate(ordered)})
    assert got == expected


@pytest.mark.parametrize("seed,divisors", [(1, [1]), (2, [50, 1]), (3, [100, 10, 1]), (4, [7])])
def test_quota_equals_one_by_one(spark, seed, divisors):
    data = hot_rows(seed)
    dice = random.Random(seed + 100)
    quotas = {"hot": 777, "g0": 0, "g1": -3, "g2": 10**6, "g3": 1, "g4": dice.randrange(300)}
    df = spark.createDataFrame([(g, t, i, quotas[g]) for g, t, i in data], "g STRING, t INT, id INT, quota INT")
    got = {r["id"] for r in first_within_quota(
        df, "g", "quota", [F.floor(F.col("t") / d) for d in divisors], [F.col("t"), F.col("id")]).collect()}
    expected = set()
    for group, quota in quotas.items():
        ordered = sorted((t, i) for g, t, i in data if g == group)
        expected |= {i for _, i in ordered[:max(quota, 0)]}
    assert got == expected


@pytest.mark.parametrize("seed,same_time", [(5, False), (6, False), (7, True)])
def test_redeem_equals_request_by_request(spark, seed, same_time):
    dice = random.Random(seed)
    offers = [(c, f"C{c}", 10, f"2024-01-{5 + 5 * c:02d} 00:00:00", dice.randrange(0, 40), dice.randrange(0, 5), c != 3)
              for c in range(5)]
    claims = {(u, c) for u in range(60) for c in range(5) if dice.random() < 0.7}
    used = {p for p in claims if dice.random() < 0.2}
    asks = []
    for i in range(0, 1500 * 3000, 3000):
        coupon = 0 if dice.random() < 0.4 else dice.randrange(5)
        asks.append((i, dice.randrange(60), f"C{coupon}", "2024-01-01 00:00:00" if same_time else
                     f"2024-01-{1 + i // 300000:02d} 10:{dice.randrange(60):02d}:00.{dice.randrange(10)}"))
    at = "2024-01-12 00:00:00"
    left = {c: (m - a, active and end >= at) for c, _, _, end, m, a, active in offers}
    done, accepted = set(used), set()
    for i, user, code, _ in sorted(asks, key=lambda r: (r[3], r[0])):
        c = int(code[1:])
        if left[c][1] and left[c][0] > 0 and (user, c) in claims and (user, c) not in done:
            done.add((user, c))
            left[c] = (left[c][0] - 1, True)
            accepted.add(i)
    cupones = spark.createDataFrame(offers, "idcupon INT, codigo STRING, porcentaje INT, e STRING, usos_maximos INT, "
                                            "usos_actuales INT, activo BOOLEAN").withColumn(
        "fecha_expiracion", F.col("e").cast("timestamp_ntz")).drop("e")
    pairs = "iduser INT, idcupon INT"
    requests = spark.createDataFrame(asks, "idsolicitud INT, iduser INT, codigo STRING, ts STRING").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz"))
    got, uses, counts = coupons.redeem(requests, cupones, spark.createDataFrame(sorted(claims), pairs),
                                       spark.createDataFrame(sorted(used), pairs), at)
    assert {r["idsolicitud"] for r in got.collect()} == accepted
    assert uses.count() == len(accepted)
    assert all(r["usos_actuales"] <= offers[r["idcupon"]][4] for r in counts.collect())


def test_related_products_are_others_of_the_category(spark):
    goods = spark.createDataFrame([(i, "big" if i < 150 else f"c{i % 20}") for i in range(200)] + [(999, "lonely")],
                                  "idproducto BIGINT, clave STRING")
    group = {r["idproducto"]: r["clave"] for r in goods.collect()}
    found = {}
    for r in catalog.related_products(goods, goods, k=4, seed=3).collect():
        found.setdefault(r["idancla"], []).append(r["idproducto"])
    sizes = {c: list(group.values()).count(c) for c in group.values()}
    for anchor, clave in group.items():
        others = found.get(anchor, [])
        assert len(others) == len(set(others)) == min(4, sizes[clave] - 1)
        assert anchor not in others and all(group[o] == clave for o in others)


def test_related_products_repeat_by_seed_and_spread(spark):
    goods = spark.range(100).select(F.col("id").alias("idproducto"), F.lit("c").alias("clave"))
    anchor = spark.createDataFrame([(5, "c")], "idproducto BIGINT, clave STRING")
    pick = lambda seed: sorted(r["idproducto"] for r in catalog.related_products(goods, anchor, 4, seed).collect())
    assert pick(1) == pick(1)
    assert len({i for seed in range(12) for i in pick(seed)}) > 20


def test_related_products_of_a_foreign_category(spark):
    goods = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "idproducto BIGINT, clave STRING")
    anchors = spark.createDataFrame([(1, "b"), (2, "none")], "idproducto BIGINT, clave STRING")
    got = catalog.related_products(goods, anchors, 4).select("idancla", "idproducto").collect()
    assert sorted(map(tuple, got)) == [(1, 2), (1, 3)]
