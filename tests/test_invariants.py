"""Sums that must agree, plans that must stay shuffle-friendly, and empty or NULL input for every operator."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from conftest import DATA
from mostrador.operators import baskets, catalog, changes, coupons, lookups, pricing, reports
from mostrador.plans import registry
from mostrador.plans.shop import AS_OF, CATEGORY, Shop
from mostrador.sources.schemas import TABLES


@pytest.fixture(scope="module")
def shop(spark):
    return Shop(spark, DATA)


def test_months_add_up_to_the_total(shop):
    total = reports.order_value_totals(shop.compras).first()["total_dinero_compras"]
    assert reports.monthly_revenue(shop.compras).agg(F.sum("total_compras")).first()[0] == total
    assert reports.monthly_orders(shop.compras).agg(F.sum("total_ordenes")).first()[0] == shop.compras.count()


def test_shares_add_up_to_a_hundred(shop):
    shares = reports.yearly_summary(shop.compra).agg(F.sum("Porcentaje")).first()[0]
    assert abs(float(shares) - 100) < 0.05


def test_units_by_category_add_up(shop):
    total = baskets.total_units(shop.compras).first()[0]
    parts = [baskets.units_by_product(shop.compras, shop.producto, c["clave"]).agg(F.sum("total_cantidad_comprada")).first()[0]
             for c in catalog.distinct_keys(shop.producto).collect()]
    assert sum(parts) == total


def test_accepted_and_refused_add_up(shop):
    orders, lines, rejects = pricing.price_orders(shop.order_requests, shop.users, shop.producto, shop.cupones, AS_OF)
    assert orders.count() + rejects.count() == shop.order_requests.count()
    assert lines.select("idcompra").distinct().count() == orders.count()
    new, old = (shop.comentarios.where(F.col("comentario") == kind) for kind in ("click", "view"))
    ok, refused = changes.ingest_comments(new, old)
    assert ok.count() + refused.count() == new.count()


def test_packing_and_exploding_are_inverse(shop):
    from mostrador.functions.lines import explode_lines
    lines = shop.lineas.select("idcompra", "pos", "idproducto", "talla")
    again = explode_lines(baskets.pack_lines(lines), ("idproducto", "talla"))
    assert again.count() == lines.count() and lines.exceptAll(again.select(lines.columns)).isEmpty()


def plan_of(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


@pytest.mark.parametrize("name", [n for n in registry.queries() if not n.endswith("_stream")])
def test_no_plan_pairs_everything(spark, name):
    """With broadcasting off, as for large dimensions, every join still has a key."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(registry.queries()[name](spark, DATA))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert not re.search("PythonUDF|ArrowEvalPython|MapInPandas", plan)


def test_one_parse_per_basket(spark, tmp_path, shop):
    shop.compras.write.parquet(str(tmp_path / "compras"))
    stored = spark.read.parquet(str(tmp_path / "compras"))
    for df in (baskets.total_units(stored), baskets.units_by_seller(stored, shop.producto, shop.users, compat=True),
               baskets.units_by_product_month(stored, shop.producto, compat=True), baskets.enrich_lines(stored, shop.producto),
               pricing.reprice_orders(stored, shop.producto)[0]):
        assert len(re.findall(r"from_json\(ArrayType\((?:Struct|Map)Type", plan_of(df))) == 1


def test_a_hot_product_is_split(spark, make):
    """Most lines name one product; with products too large to broadcast, its partition is still divided."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        product = F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 1000)
        basket = F.to_json(F.array(F.struct(product.alias("idproducto"), F.col("id").alias("cantidad"))))
        orders = spark.range(20000, numPartitions=4).select(F.col("id").alias("idcompra"), basket.alias("productos"))
        goods = spark.range(1000).select(F.col("id").alias("idproducto"), F.col("id").cast("string").alias("nomprod"))
        named = baskets.enrich_lines(orders, goods)
        assert len(named.collect()) == 20000
        assert "skew=true" in named._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_filters_and_columns_reach_the_scan(shop):
    plan = plan_of(catalog.discounted_products(shop.producto, shop.comentarios).select("idproducto"))
    assert "PushedFilters" in plan and "p_retailprice" not in plan
    plan = plan_of(lookups.lookup(shop.source("customer").where("c_custkey = 5"), shop.source("customer"), "c_custkey"))
    assert "EqualTo(c_custkey,5)" in plan


def every_operator(t):
    """All operators on the tables of ``t``."""
    keys = {k: t["compra"].select(k) for k in ("iduser", "idproducto", "idcompra")}
    rules = coupons.grant_rules(t["users"].sparkSession)
    asks = t["user_cupones"].select(F.lit(1).alias("idsolicitud"), "iduser", F.lit("A").alias("codigo"),
                                    F.col("fecha_reclamacion").alias("ts"))
    new = t["comentarios"].withColumn("idcomentario", F.lit(1))
    requests = t["compras"].join(t["compras_detalle"].select("idcompra", "codigoCupon"), "idcompra", "left")
    lines = t["compra"].select("idcompra", "iduser", F.lit("x").alias("clave"), "cantidad")
    batch = t["cupones"].select("idcupon", F.lit("update").alias("op"), F.lit(1).alias("seq"), "codigo")
    for compat in (False, True):
        yield reports.sales_by_product_year(t["compra"], t["producto"], t["comentarios"], compat)
        yield baskets.units_by_seller(t["compras"], t["producto"], t["users"], compat)
        yield baskets.units_by_product(t["compras"], t["producto"], CATEGORY, compat)
        yield baskets.units_by_product_month(t["compras"], t["producto"], compat)
        yield baskets.top_products(t["compras"], t["producto"], compat=compat)
        yield baskets.top_buyers(t["compras"], t["users"], compat=compat)
        yield from changes.ingest_comments(new, t["comentarios"], compat)
    yield reports.yearly_summary(t["compra"])
    yield reports.monthly_revenue(t["compras"])
    yield reports.monthly_orders(t["compra"])
    yield reports.order_value_totals(t["compras"])
    yield reports.users_by(t["users"], "sexo", ("hombre",))
    yield reports.age_histogram(t["users"], AS_OF)
    yield reports.new_users_by_month(t["users"])
    yield reports.products_per_user(t["users"], t["producto"])
    yield reports.count_where(t["users"], F.col("idrol") == 2)
    yield reports.visits_by_month(t["visitas_por_mes"])
    yield reports.visits_total(t["visitas_por_mes"])
    yield reports.top_states(t["users"])
    yield reports.best_sellers(t["compra"], t["producto"])
    yield reports.top_coupons(t["cupones_usados"], t["cupones"])
    yield reports.top_coupon_users(t["cupones_usados"], t["users"])
    yield reports.top_rated(t["producto"], t["comentarios"])
    yield reports.newest_users(t["users"])
    yield lookups.lookup(t["users"], keys["iduser"], "iduser")
    yield lookups.lookup_missing(t["users"], keys["iduser"], "iduser")
    yield from lookups.require_parent(t["compra"], t["users"], "iduser")
    yield lookups.order_details(t["compra_detalle"])
    yield lookups.order_listing(t["compra"], t["users"], t["producto"])
    yield lookups.user_purchases(t["compra"], t["producto"], keys["iduser"])
    yield lookups.detail_lines(t["compra_detalle"], t["producto"], keys["idcompra"])
    yield lookups.role_permissions(t["rolxpermiso"], t["permiso"], t["rol"])
    yield lookups.product_comments(t["comentarios"], t["users"], keys["idproducto"])
    yield catalog.rating_summary(t["comentarios"])
    yield catalog.plain_products(t["producto"], t["comentarios"], t["users"], keys["iduser"])
    yield catalog.personalised_of_owners(t["producto"], t["comentarios"], t["users"], keys["iduser"])
    yield catalog.personalised_products(t["producto"], t["comentarios"])
    yield catalog.newest_products(t["producto"], t["comentarios"])
    yield catalog.discounted_products(t["producto"], t["comentarios"])
    yield catalog.products_by_id(t["producto"], t["comentarios"], keys["idproducto"])
    yield catalog.search_products(t["producto"], "x", t["comentarios"], discounted_only=True)
    yield catalog.products_of_category(t["producto"], t["comentarios"], "x")
    yield catalog.distinct_keys(t["producto"])
    yield catalog.related_products(t["producto"], t["producto"])
    yield baskets.total_units(t["compras"])
    yield baskets.orders_with_line(t["compras"], "talla", "S")
    yield baskets.orders_containing(t["compras"], keys["idproducto"])
    yield baskets.enrich_orders(t["compras"], t["users"], t["producto"])
    yield baskets.enrich_lines(t["compras_detalle"], t["producto"])
    yield baskets.basket_rejects(t["compras"])
    yield from baskets.invoice_documents(t["compras"], t["compras_detalle"], t["detalle_entrega"], t["producto"])
    yield baskets.pack_lines(t["compra"].withColumn("pos", F.lit(0)))
    yield pricing.final_price(t["producto"])
    yield from pricing.price_orders(requests, t["users"], t["producto"], t["cupones"], AS_OF)
    yield from pricing.reprice_orders(t["compras"], t["producto"], t["users"])
    yield from pricing.price_flat_orders(t["compra"].drop("total"), t["users"], t["producto"])
    yield from pricing.price_details(t["compra_detalle"].drop("total"), t["compra"], t["producto"])
    yield from pricing.validate_products(t["compra"], t["producto"])
    yield from pricing.payment_state(t["paypal_logs"])
    yield coupons.claimed_coupons(t["cupones"], t["user_cupones"], t["cupones_usados"], keys["iduser"])
    yield coupons.checkout_coupons(t["cupones"], AS_OF)
    yield coupons.eligible(asks, t["cupones"], t["user_cupones"], t["cupones_usados"], F.col("ts"))
    yield from coupons.redeem(asks, t["cupones"], t["user_cupones"], t["cupones_usados"], AS_OF)
    yield from coupons.grant_coupons(lines, rules, t["cupones"], t["user_cupones"], t["cupones_usados"])
    yield from coupons.record_use(asks, t["cupones"])
    yield coupons.welcome_coupons(t["users"], t["cupones"])
    yield changes.visit_counts(t["compra"], "fecha")
    yield changes.merge_counts(t["visitas_por_mes"], t["visitas_por_mes"])
    yield changes.prepare_users(t["users"])
    yield from changes.apply_changes(t["cupones"], batch, "idcupon")
    yield from changes.replace_role_permission(t["rolxpermiso"], t["rolxpermiso"].withColumn("seq", F.lit(1)))
    yield from changes.delete_pairs(t["rolxpermiso"], t["rolxpermiso"])


def test_empty_input(spark):
    empty = {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}
    one_row = 0
    for df in every_operator(empty):
        one_row += len(df.collect())
    assert one_row == 5  # the whole-table sums and counts


def test_null_input(make):
    nulls = {name: make(name, list(TABLES[name].split(" "))[0], (None,)) for name in TABLES}
    for df in every_operator(nulls):
        df.collect()
