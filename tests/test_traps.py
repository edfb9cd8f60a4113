"""Hand-written cases for behaviour that a name alone does not tell."""

import pytest
from pyspark.sql import functions as F

from mostrador.functions.lines import basket_rejects, explode_lines
from mostrador.functions.scalars import complete_years, contains_text, percent
from mostrador.operators import baskets, catalog, changes, coupons, lookups, pricing, reports

REVIEW = "idcomentario BIGINT, idproducto BIGINT, iduser BIGINT, comentario STRING, calificacion DECIMAL(3,1), fecha TIMESTAMP_NTZ"
REQUEST = "idsolicitud BIGINT, iduser BIGINT, codigo STRING, ts TIMESTAMP_NTZ"
ORDER = "idcompra BIGINT, iduser BIGINT, fecha TIMESTAMP_NTZ, codigoCupon STRING, productos STRING"


def line(product, units=None, **more):
    quantity = "" if units is None else f', "cantidad": {units}'
    rest = "".join(f', "{k}": "{v}"' for k, v in more.items())
    return f'{{"idproducto": {product}{quantity}{rest}}}'


def basket(*lines):
    return "[" + ", ".join(lines) + "]"


ODD = [
    (1, basket()),
    (2, None),
    (3, "not json"),
    (4, basket(line(10, '"3"'))),
    (5, basket(line(10))),
    (6, basket(line(10, "null"), line(11, 4))),
    (7, basket(line(99, 2))),
    (8, basket(line(10, 1), line(10, 2))),
    (9, basket(line(10, 1), line(11, 5), line(12, 7))),
    (10, basket(*[line(12, i + 1) for i in range(11)])),
    (11, '[{"idproducto": 10},'),
    (12, ""),
]


@pytest.fixture
def odd(make):
    return make("compras", "idcompra, productos, iduser, fecha, total",
                *[(i, text, 1 + i % 2, "2024-03-05", 10) for i, text in ODD])


@pytest.fixture
def products(make):
    return make("producto", "idproducto, iduser, nomprod, clave, p_producto, descuento, p_final, foto",
                (10, 1, "mug", "PER", 20, 0, "10.0000", "m"), (11, 1, "cap", "PER", 20, 10, "18.0000", "c"),
                (12, 2, "mug", "ANI", 30, None, "30.0000", "m"))


@pytest.fixture
def people(make):
    return make("users", "iduser, user, email, foto", (1, "ana", "a@x", "a.jpg"), (2, "bo", "b@x", "b.jpg"))


def test_lines_of_every_shape(odd, rows):
    got = rows(explode_lines(odd, ("idproducto", "cantidad"), ["idcompra"]).where("idcompra < 10"))
    assert got == sorted([
        (4, 0, 10, 3.0), (5, 0, 10, None), (6, 0, 10, None), (6, 1, 11, 4.0), (7, 0, 99, 2.0), (8, 0, 10, 1.0),
        (8, 1, 10, 2.0), (9, 0, 10, 1.0), (9, 1, 11, 5.0), (9, 2, 12, 7.0)], key=repr)


def test_unreadable_baskets_are_reported(odd, rows):
    assert rows(basket_rejects(odd), "idcompra", "reason") == sorted([
        (2, "basket_missing"), (3, "basket_unreadable"), (11, "basket_unreadable"), (12, "basket_unreadable")], key=repr)


def test_t1_comments_multiply_sales_only_in_compat(make, products, rows):
    sales = make("compra", "idcompra, total, fecha, idproducto", (1, 5, "2024-01-01", 10), (2, 7, "2024-02-01", 11),
                 (3, 1, None, 77))
    reviews = make("comentarios", "idproducto", (10,), (10,), (10,))
    plain = reports.sales_by_product_year(sales, products)
    assert rows(plain) == sorted([("mug", 2024, 5.0), ("cap", 2024, 7.0), (None, None, 1.0)], key=repr)
    compat = reports.sales_by_product_year(sales, products, reviews, compat=True)
    assert rows(compat) == sorted([("mug", 2024, 15.0), ("cap", 2024, 7.0), (None, None, 1.0)], key=repr)


def test_t2_whole_basket_counts_per_contained_product(odd, products, people, rows):
    # bo's product 12: 7 in order 9 and 1+..+11 in order 10; ana's 10 and 11: the rest
    assert rows(baskets.units_by_seller(odd, products, people)) == [
        ("ana", 3.0 + 4 + 1 + 2 + 1 + 5), ("bo", 7.0 + 66)]
    # compat: quoted product ids still count here (only the quantity is quoted); order 6 has 4 units and two of
    # ana's products, order 9 13 units and two; order 10 stops after ten lines
    assert rows(baskets.units_by_seller(odd, products, people, compat=True)) == [
        ("ana", 3.0 + 2 * 4 + 3 + 2 * 13), ("bo", 13.0 + 55)]


def test_t21_quoted_ids_do_not_count_in_containment_compat(make, products, people, rows):
    orders = make("compras", "idcompra, productos, fecha", (1, '[{"idproducto": "10", "cantidad": 2}]', "2024-01-01"))
    assert rows(baskets.units_by_product(orders, products, "PER")) == [("mug", 2.0)]
    assert rows(baskets.units_by_product(orders, products, "PER", compat=True)) == []
    assert rows(baskets.top_products(orders, products, compat=True)) == [(10, "mug", "m", 2.0)]


def test_t3_first_line_takes_three_lines(odd, products, rows):
    month = "2024-03"
    assert rows(baskets.units_by_product_month(odd, products)) == [
        ("cap", month, 9.0), ("mug", month, 3.0 + 3 + 1 + 7 + 66)]
    # products 10 and 12 share the name mug: orders 4, 5, 6 (0 + 4), 8, 9 (13), 10 (1+2+3)
    assert rows(baskets.units_by_product_month(odd, products, compat=True)) == [("mug", month, 3.0 + 0 + 4 + 3 + 13 + 6)]


def test_t4_missing_first_quantity_voids_the_order(make, products, rows):
    orders = make("compras", "idcompra, productos", (1, basket(line(10), line(11, 5))),
                  (2, basket(line(10, "null"), line(11, 4))), (3, basket(line(11), line(10, 2))))
    assert rows(baskets.top_products(orders, products, compat=True), "idproducto", "total_comprado") == [
        (10, 4.0), (11, None)]
    assert rows(baskets.top_products(orders, products), "idproducto", "total_comprado") == [(10, 2.0), (11, 9.0)]


def test_t5_top_buyers_stop_at_five_lines(make, people, rows):
    orders = make("compras", "idcompra, iduser, productos", (1, 1, basket(*[line(10, 2)] * 6)),
                  (2, 2, basket(line(10, 3.7), line(10, -4), line(10, '"x"'))), (3, 9, basket(line(10, 50))),
                  (4, 1, None), (5, 1, "oops"))
    assert rows(baskets.top_buyers(orders, people), "iduser", "cantidad_compras") == [(1, 12.0), (2, 3.7 - 4)]
    assert rows(baskets.top_buyers(orders, people, compat=True), "iduser", "cantidad_compras") == [(1, 10.0), (2, 3.0)]


def test_t6_same_names_merge(make, people, rows):
    both = people.unionByName(make("users", "iduser, user", (3, "ana")))
    goods = make("producto", "idproducto, iduser", (1, 1), (2, 3), (3, 3))
    assert rows(reports.products_per_user(both, goods)) == [("ana", 3), ("bo", 0)]


def test_t7_t8_rating_denominators(make, products, rows):
    reviews = make("comentarios", "idproducto, calificacion", (10, 5), (10, None), (10, 4.5), (11, None))
    summary = catalog.rating_summary(reviews)
    assert rows(summary, "idproducto", "`5`", "TOTAL", "calificacion_final") == [(10, 1, 3, 1.67), (11, 0, 1, 0.0)]
    rated = catalog.with_rating(products, reviews)
    assert rows(rated, "idproducto", "calificacion_final") == [(10, 2.5), (11, 0.0), (12, 0.0)]
    assert rows(reports.top_rated(products, reviews), "idproducto", "promedio_calificacion") == [(10, 4.75), (11, None)]


@pytest.mark.parametrize("birth,today,age", [
    ("2004-02-29", "2005-02-28", 0), ("2004-02-29", "2005-03-01", 1), ("2000-05-05", "2024-05-05", 24),
    ("2000-05-05", "2024-05-04", 23)])
def test_t9_complete_years(spark, birth, today, age):
    got = spark.range(1).select(complete_years(F.lit(birth).cast("date"), F.lit(today).cast("date"))).first()[0]
    assert got == age


def test_t9_age_bands(make, rows):
    users = make("users", "iduser, fecha_nacimiento", (1, "2014-01-20"), (2, "2014-01-21"), (3, "1953-06-01"), (4, None))
    assert rows(reports.age_histogram(users, "2024-01-20")) == [(1, 0, 0, 0, 1)]
    assert rows(reports.age_histogram(users.limit(0), "2024-01-20")) == [(None,) * 5]


def test_t10_months_in_time_order(make):
    users = make("users", "iduser, created_at", (1, "2024-02-01"), (2, "2023-12-31"), (3, "2024-01-05"), (4, "2024-02-09"))
    got = [tuple(r) for r in reports.new_users_by_month(users).collect()]
    assert got == [("December 2023", 1), ("January 2024", 1), ("February 2024", 2)]


@pytest.fixture
def offers(make):
    return make("cupones", "idcupon, codigo, porcentaje, fecha_expiracion, usos_maximos, usos_actuales, activo",
                (1, "A", 10, "2024-01-20 12:00:00", 2, 0, True), (2, "B", 5, "2030-01-01", 3, 3, True),
                (3, "C", 5, "2030-01-01", 0, 0, True), (4, "D", 5, "2030-01-01", 9, 0, False))


def test_t11_t12_two_notions_of_valid(make, offers, rows):
    assert rows(coupons.checkout_coupons(offers, "2024-01-20 12:00:00"), "codigo") == [("A",), ("B",)]
    assert rows(coupons.checkout_coupons(offers, "2024-01-20 12:00:01"), "codigo") == [("B",)]
    claims = make("user_cupones", "iduser, idcupon", (1, 1), (1, 2), (2, 1), (1, 4))
    used = make("cupones_usados", "iduser, idcupon", (2, 1))
    asks = make(REQUEST, "idsolicitud, iduser, codigo, ts", *[
        (10 * u + i, u, c, "2024-01-01") for u in (1, 2, 3) for i, c in enumerate("ABCD")])
    assert rows(coupons.eligible(asks, offers, claims, used, "2024-01-19"), "iduser", "codigo") == [(1, "A")]


def test_t13_share_of_all_including_undated(make, rows):
    sales = make("compra", "idcompra, total, fecha", (1, 1, "2024-01-01"), (2, 2, None))
    assert rows(reports.yearly_summary(sales), "Año", "Porcentaje") == [(2024, 33.33), (None, 66.67)]
    assert rows(reports.yearly_summary(make("compra", "idcompra, total, fecha", (1, 0, "2024-01-01"))),
                "Porcentaje") == [(None,)]
    users = make("users", "iduser, estado", *[(i, f"s{i % 7}") for i in range(70)])
    assert rows(reports.top_states(users)) == [(f"s{i}", 10, 14.3) for i in range(5)]


def test_t14_enrichment_keeps_unknown_and_empty(odd, products, people, rows):
    named = {r["idcompra"]: r["productos"] for r in baskets.enrich_lines(odd, products).collect()}
    assert sorted(named) == [1, 4, 5, 6, 7, 8, 9, 10]
    assert named[1] == []
    assert [e["idproducto"] for e in named[7]] == [None]
    assert [(e["idproducto"], e["cantidad"]) for e in named[9]] == [("mug", 1.0), ("cap", 5.0), ("mug", 7.0)]
    assert [e["cantidad"] for e in named[10]] == [float(i + 1) for i in range(11)]
    only_ana = baskets.enrich_orders(odd, people.where("iduser = 1"), products)
    assert {r[0] for r in only_ana.select("usuario").collect()} == {"a@x"}


def test_invoices_need_every_part(make, odd, products, rows):
    details = make("compras_detalle", "iddetalle, idcompra, codigoCupon", (7, 9, "late"), (5, 9, "first"), (1, 3, None),
                   (2, 8, None))
    delivery = make("detalle_entrega", "identrega, idcompra, pais", (1, 9, "MX"), (2, 3, "MX"))
    documents, rejects = baskets.invoice_documents(odd, details, delivery, products)
    assert rows(documents, "idcompra", "comprasDetalle.codigoCupon", "detalleEntrega.pais") == [(9, "first", "MX")]
    reasons = dict(rows(rejects, "idcompra", "reason"))
    assert (reasons[3], reasons[8], reasons[1]) == ("basket_unreadable", "delivery_missing", "detail_missing")
    assert len(reasons) == len(ODD) - 1


def test_t15_whole_order_refused(make, people, products, offers, rows):
    orders = make(ORDER, "idcompra, iduser, fecha, codigoCupon, productos",
                  (1, 1, "2024-01-02", "A", basket(line(10, 2, talla="S"), line(11, 1))),
                  (2, 1, "2024-01-02", None, basket(line(10, 2), line(99, 1), line(11, 1))),
                  (3, 9, "2024-01-02", None, basket(line(10, 1))), (4, 1, "2024-01-02", "NOPE", basket(line(10, 1))),
                  (5, 1, "2024-01-02", "", basket(line(10, '"3"'))), (6, 1, "2024-01-02", None, basket()),
                  (7, 1, "2024-01-02", None, None), (8, 1, "2024-01-02", None, "{oops"),
                  (9, 1, "2024-01-02", None, basket(line(10))))
    priced, lines, rejects = pricing.price_orders(orders, people, products, offers, "2024-01-02")
    assert rows(priced, "idcompra", "total") == [(1, (20 + 18) * 0.9), (5, 30.0)]
    assert rows(lines, "idcompra", "idproducto", "talla", "clave", "total_producto") == sorted([
        (1, 10, "S", "PER", 18.0), (1, 11, None, "PER", 16.2), (5, 10, None, "PER", 30.0)], key=repr)
    assert rows(rejects) == sorted([
        (2, "unknown_product"), (3, "unknown_user"), (4, "invalid_coupon"), (6, "empty_basket"), (7, "basket_missing"),
        (8, "basket_unreadable"), (9, "bad_quantity")], key=repr)
    again = explode_lines(priced, keep=["idcompra"])
    assert rows(again.where("idcompra = 1"), "pos", "idproducto", "total_producto") == [(0, 10, 18.0), (1, 11, 16.2)]
    repriced, _, bad = pricing.reprice_orders(orders, products, people)
    assert rows(repriced, "idcompra", "total") == [(1, 38.0), (4, 10.0), (5, 30.0)]
    assert rows(bad).count((3, "unknown_user")) == 1


def test_t15_personalised_by_any_or_last_line(make, rows):
    schema = ("idcompra BIGINT, productos STRING, "
              "detallePersonalizacion STRUCT<lado_frontal: STRING, lado_trasero: STRING, foto: STRING, foto2: STRING>")
    asked = ("front", "back", "f.png", None)
    orders = make(schema, "idcompra, productos, detallePersonalizacion",
                  (1, basket(line(1, tipo_personalizacion="personalizado"), line(2, tipo_personalizacion="no")), asked),
                  (2, basket(line(1, tipo_personalizacion="personalizado")), asked), (3, basket(), asked))
    nothing = (None,) * 4
    full = ("front", "back", "f.png", "")
    assert rows(pricing.personalisation_rows(orders)) == [(1, *full), (2, *full), (3, *nothing)]
    assert rows(pricing.personalisation_rows(orders, compat=True)) == [(1, *nothing), (2, *full), (3, *nothing)]


def test_t16_repeated_or_unknown_products_refuse_the_order(spark, products, rows):
    lines = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (2, 10), (3, 10), (3, 99)], "idcompra BIGINT, idproducto BIGINT")
    ok, rejects = pricing.validate_products(lines, products)
    assert rows(ok) == [(1, 10), (1, 11)]
    assert rows(rejects) == [(2, "repeated_product"), (3, "unknown_product")]


def test_t17_collation_is_a_choice(make, rows):
    users = make("users", "iduser, estado", (1, "León"), (2, "LEON"), (3, "Puebla"))
    assert len(rows(reports.users_by(users, "estado"))) == 3
    folded = reports.users_by(users, "estado", collation="UNICODE_CI_AI")
    assert sorted(r["cantidad"] for r in folded.collect()) == [1, 2]
    goods = make("producto", "idproducto, clave", (1, "per"), (2, "PER"), (3, "ani"))
    assert catalog.distinct_keys(goods).count() == 3
    assert rows(catalog.distinct_keys(goods, collation="UNICODE_CI")) == [("PER",), ("ani",)]


def test_t18_ties_go_to_the_lower_key(make, rows):
    users = make("users", "iduser, created_at", *[(i, "2024-01-01") for i in range(20)])
    assert rows(reports.newest_users(users), "iduser") == [(i,) for i in range(8)]


def test_t19_month_is_seven_characters(spark, rows):
    visits = spark.createDataFrame([("2024-01-05T10:00",), ("2024-01",), ("garbage text",)], "fecha_visita STRING")
    got = changes.visit_counts_from_text(visits)
    assert rows(got) == [("2024-01", 2), ("garbage", 1)]
    assert rows(changes.merge_counts(got, got)) == [("2024-01", 4), ("garbage", 2)]


def test_t22_comment_intake(make, rows):
    new = make(REVIEW, "idcomentario, idproducto, iduser, calificacion, fecha",
               (1, 1, 1, 5, "2024-01-02"), (2, 1, 1, 4, "2024-01-01"), (3, 1, 2, None, "2024-01-01"),
               (4, 1, 3, 4.5, "2024-01-01"), (5, 1, 4, 6, "2024-01-01"), (6, 1, 5, 3, "2024-01-01"))
    old = make("comentarios", "idproducto, iduser", (1, 5), (1, 5))
    ok, rejects = changes.ingest_comments(new, old)
    assert rows(ok, "idcomentario") == [(2,)]
    assert rows(rejects, "idcomentario", "reason") == [
        (1, "repeated_in_batch"), (3, "rating_out_of_range"), (4, "rating_out_of_range"), (5, "rating_out_of_range"),
        (6, "already_commented")]
    ok, rejects = changes.ingest_comments(new, old, compat=True)
    assert rows(ok, "idcomentario") == [(2,), (3,), (4,)]
    assert ok.count() + rejects.count() == 6


def test_t23_two_rules_can_fire(spark, make, rows):
    schema = "idcompra BIGINT, iduser BIGINT, clave STRING, cantidad DECIMAL(12,3)"
    lines = make(schema, "idcompra, iduser, clave, cantidad", (1, 1, "Dragon Ball", 2), (1, 1, "Dragon Ball", 1),
                 (2, 2, "Dragon Ball", 2), (3, 3, "dragon ball", 9), (4, 4, "One Piece", 2), (5, 4, "One Piece", 2),
                 (6, 5, "One Piece", 3), (7, 2, "Dragon Ball", 2), (8, 6, "Dragon Ball", 2))
    offers = make("cupones", "idcupon, codigo, activo", (1, "SAIYAN2", True), (2, "DRAGON2024", False), (3, "ONEPIECE5", True))
    claims = make("user_cupones", "iduser, idcupon", (5, 3))
    used = make("cupones_usados", "iduser, idcupon", (6, 1))
    grants, missing = coupons.grant_coupons(lines, coupons.grant_rules(spark), offers, claims, used)
    assert rows(grants) == [(1, 1, "SAIYAN2"), (2, 1, "SAIYAN2")]
    assert rows(missing) == [(1, "DRAGON2024")]


def test_t25_decimal_money(make, people, rows):
    goods = make("producto", "idproducto, p_producto, descuento", (1, "0.10", "0"), (2, "19.99", "15"), (3, "5", None))
    priced = catalog.with_rating(pricing.final_price(goods), make("comentarios", "idproducto"))
    assert rows(priced, "idproducto", "p_final") == [(1, 0.1), (2, 16.9915), (3, 5.0)]
    asks = make("compra", "idcompra, iduser, idproducto, cantidad, fecha", (1, 1, 1, 3, "2024-01-01"), (2, 1, 2, 3, "2024-01-01"),
                (3, 9, 1, 1, "2024-01-01"), (4, 1, 9, 1, "2024-01-01"), (5, 1, 1, None, "2024-01-01")).drop("total")
    orders, details, rejects = pricing.price_flat_orders(asks, people, priced)
    assert rows(orders, "idcompra", "total") == [(1, 0.3), (2, 50.97)]
    assert details.count() == 2
    assert rows(rejects) == [(3, "unknown_user"), (4, "unknown_product"), (5, "bad_quantity")]
    more = make("compra_detalle", "iddetalle, idcompra, idproducto, cantidad", (1, 1, 1, 2), (2, 77, 1, 2), (3, 1, 9, 2))
    ok, bad = pricing.price_details(more.drop("total"), orders, priced)
    assert rows(ok, "iddetalle", "total") == [(1, 0.2)]
    assert rows(bad) == [(2, "unknown_order"), (3, "unknown_product")]


def test_search_treats_wildcards_as_text(make, rows):
    goods = make("producto", "idproducto, nomprod", (1, "50% off Mug"), (2, "50 off mug"), (3, "a_b"), (4, "axb"), (5, "c\\d"))
    find = lambda text, **kw: [i for i, in rows(catalog.search_products(goods, text, **kw), "idproducto")]
    assert find("50%") == [1]
    assert find("MUG") == [1, 2]
    assert find("_") == [3]
    assert find("\\") == [5]
    assert find("a_b", raw_pattern=True) == [3, 4]


def test_payment_log(make, rows):
    log = make("paypal_logs", "order_id, iduser, status, total, currency, description, ts",
               ("a", 1, "CREATED", 5, None, None, "2024-01-01 10:00:00"), ("a", 1, "COMPLETED", 6, "MXN", None, "2024-01-01 10:01:00"),
               ("a", 1, "COMPLETED", 7, "MXN", "thanks", "2024-01-01 10:02:00"), ("a", 2, "COMPLETED", 9, "MXN", "", "2024-01-01 10:02:00"),
               ("b", 1, "CREATED", 3, "EUR", "book", "2024-01-01 10:00:00"), ("b", 1, "DECLINED", 3, "EUR", "", "2024-01-01 10:05:00"),
               ("c", 1, "CREATED", 3, "", "", "2024-01-01 10:00:00"), ("c", 1, "COMPLETED", 8, "", "", "2024-01-01 09:00:00"))
    state, rejects = pricing.payment_state(log)
    assert rows(state, "order_id", "status", "total", "currency", "description") == [
        ("a", "COMPLETED", 7.0, "MXN", "thanks"), ("b", "CREATED", 3.0, "EUR", "book"),
        ("c", "CREATED", 3.0, "USD", "Compra en Proceso")]
    assert rows(rejects, "order_id", "iduser", "reason") == [
        ("a", 2, "no_created_row"), ("b", 1, "not_completed"), ("c", 1, "no_created_row")]


def test_payments_at_one_time_and_without_a_user(make, rows):
    at = "2024-01-01 10:00:00"
    events = [("a", 1, "CREATED", 5, at), ("a", 1, "COMPLETED", 2, at), ("a", 1, "COMPLETED", 3, at),
              ("b", None, "CREATED", 5, at), ("b", None, "COMPLETED", 7, at), ("c", 1, "CREATED", 5, None)]
    for log in (events, events[::-1]):
        state, rejects = pricing.payment_state(make("paypal_logs", "order_id, iduser, status, total, ts", *log))
        assert rows(state, "order_id", "iduser", "total") == [("a", 1, 3.0), ("b", None, 7.0)]
        assert rows(rejects, "order_id", "reason") == [("c", "missing_time")]


def test_an_element_that_is_no_object_spoils_nothing_else(make, rows):
    orders = make("compras", "idcompra, productos", (1, '[{"idproducto": 10, "cantidad": 2}, 5]'), (2, '[{"idproducto": 10}, null]'),
                  (3, '[{"idproducto": 10, "cantidad": 1}]'), (4, "[{oops"), (5, "7"))
    assert baskets.total_units(orders).first()[0] == 3
    assert rows(basket_rejects(orders), "idcompra", "reason") == [
        (1, "line_without_product"), (2, "line_without_product"), (4, "basket_unreadable"), (5, "basket_unreadable")]


def test_untidy_order_ids(make, rows):
    users, goods = make("users", "iduser", (1,)), make("producto", "idproducto, p_final", (10, 5))
    basket = lambda n: f'[{{"idproducto": 10, "cantidad": {n}}}]'
    asked = make("idcompra BIGINT, iduser BIGINT, fecha TIMESTAMP_NTZ, codigoCupon STRING, productos STRING", "idcompra, iduser, productos",
                 (1, 1, basket(1)), (1, 1, basket(2)), (None, 1, basket(3)), (None, 1, basket(4)), (2, 1, basket(2)),
                 (3, 1, basket("1.00049")))
    orders, lines, rejects = pricing.price_orders(asked, users, goods, make("cupones", "idcupon"), "2024-01-01")
    assert rows(orders, "idcompra", "total") == [(2, 10.0)] and rows(lines, "idcompra", "cantidad") == [(2, 2.0)]
    assert rows(rejects) == [(1, "repeated_order")] * 2 + [(3, "bad_quantity")] + [(None, "missing_order_id")] * 2


def test_details_are_repriced_one_by_one(make, rows):
    goods = make("producto", "idproducto, p_final", (10, 5), (11, 2))
    details = make("iddetalle BIGINT, idcompra BIGINT, productos STRING", "iddetalle, idcompra, productos",
                   (7, 1, '[{"idproducto": 10, "cantidad": 1}]'), (8, 1, '[{"idproducto": 11, "cantidad": 1}]'))
    priced, lines, _ = pricing.reprice_orders(details, goods, key="iddetalle")
    assert rows(priced, "iddetalle", "idcompra", "total") == [(7, 1, 5.0), (8, 1, 2.0)]
    assert rows(lines, "iddetalle", "idproducto") == [(7, 10), (8, 11)]


def test_coupons_that_share_a_code(make, rows):
    offers = make("cupones", "idcupon, codigo, porcentaje, activo, fecha_expiracion, usos_maximos, usos_actuales",
                  (4, "A", 10, True, "2025-01-01 00:00:00", 1, 0), (5, "A", 20, True, "2025-01-01 00:00:00", 1, 0))
    claims = make("user_cupones", "iduser, idcupon", (1, 4), (1, 5), (2, 5))
    asks = make("idsolicitud BIGINT, iduser BIGINT, codigo STRING, ts TIMESTAMP_NTZ", "idsolicitud, iduser, codigo, ts",
                (1, 1, "A", "2024-01-01 00:00:00"), (2, 2, "A", "2024-01-02 00:00:00"))
    got, _, _ = coupons.redeem(asks, offers, claims, make("cupones_usados", "iduser"), "2024-01-03")
    assert rows(got, "idsolicitud", "idcupon") == [(1, 4), (2, 5)]


def test_shares_of_a_total_near_zero(spark):
    money = spark.range(1).select(percent(F.lit("1000000.00").cast("decimal(16,2)"), F.lit("0.01").cast("decimal(16,2)"), 2))
    assert float(money.first()[0]) == 10_000_000_000.0


def test_bulk_lookup_and_parents(spark, make, people, rows):
    keys = spark.createDataFrame([(1,), (7,)], "iduser BIGINT")
    assert rows(lookups.lookup(people, keys, "iduser"), "user") == [("ana",)]
    assert rows(lookups.lookup_missing(people, keys, "iduser")) == [(7,)]
    pairs = make("rolxpermiso", "idrol, idpermiso", (1, 5), (2, 6), (None, 7))
    roles = make("rol", "idrol, nomrol", (1, "x"))
    ok, rejects = lookups.require_parent(pairs, roles, "idrol")
    assert rows(ok) == [(1, 5)] and rows(rejects) == [(2, 6), (None, 7)]


def test_claims_uses_and_welcome(spark, make, people, offers, rows):
    claims = make("user_cupones", "iduser, idcupon, fecha_reclamacion", (1, 1, "2024-01-01"), (1, 2, "2024-01-01"), (2, 1, "2024-01-01"))
    used = make("cupones_usados", "iduser, idcupon, fecha_uso", (1, 2, "2024-01-03"), (2, 2, "2024-01-03"))
    got = coupons.claimed_coupons(offers, claims, used, people.where("iduser = 1"))
    assert [(r["codigo"], r["fecha_uso"] is None) for r in got.orderBy("codigo").collect()] == [("A", True), ("B", False)]
    asks = make(REQUEST, "idsolicitud, iduser, codigo, ts", (1, 1, "A", "2024-01-01"), (2, 1, "ZZ", "2024-01-01"))
    uses, unknown = coupons.record_use(asks, offers)
    assert rows(uses, "iduser", "idcupon") == [(1, 1)] and rows(unknown, "idsolicitud") == [(2,)]
    assert rows(coupons.welcome_coupons(people, offers, "A")) == [(1, 1), (2, 1)]
    assert rows(coupons.welcome_coupons(people, offers, "D")) == []
    assert rows(coupons.welcome_coupons(people, offers)) == []


def test_user_intake(spark, rows):
    raw = spark.createDataFrame([("ana", "x.jpg", "pw"), ("bo", "", "pw"), ("cy", None, "pw")], "user STRING, foto STRING, password STRING")
    assert rows(changes.prepare_users(raw)) == [("ana", "x.jpg", 1), ("bo", "uploads/default.jpg", 1), ("cy", "uploads/default.jpg", 1)]


CHANGE = "idcupon BIGINT, op STRING, seq BIGINT, codigo STRING, usos_maximos INT"


@pytest.mark.parametrize("log,expected,missing", [
    ([("update", "z", 9)], [(1, "z", 9, 1)], []),
    ([("delete", None, None)], [], []),
    ([("delete", None, None), ("delete", None, None)], [], [1]),
    ([("merge", "z", 9)], [(1, "a", 2, 1)], [0]),
    ([("delete", None, None), ("update", "z", 9)], [], [1]),
    ([("delete", None, None), ("insert", "n", 4)], [(1, "n", 4, None)], []),
    ([("delete", None, None), ("insert", "n", 4), ("update", "z", 9)], [(1, "z", 9, None)], []),
    ([("update", "y", 8), ("update", "z", None)], [(1, "z", None, 1)], []),
    ([("insert", "n", 4)], [(1, "a", 2, 1)], [0]),
    ([("insert", "n", 4), ("delete", None, None)], [], [0]),
])
def test_changes_to_a_present_key(make, rows, log, expected, missing):
    table = make("cupones", "idcupon, codigo, usos_maximos, usos_actuales", (1, "a", 2, 1))
    batch = make(CHANGE, "idcupon, op, seq, codigo, usos_maximos", *[(1, op, i, c, n) for i, (op, c, n) in enumerate(log)])
    new, gone = changes.apply_changes(table, batch, "idcupon")
    assert rows(new, "idcupon", "codigo", "usos_maximos", "usos_actuales") == expected
    assert rows(gone, "seq") == [(k,) for k in missing]
    assert new.columns == table.columns


@pytest.mark.parametrize("log,expected,missing", [
    ([("update", "z", 9)], [], [0]), ([("delete", None, None)], [], [0]),
    ([("insert", "n", 4), ("update", "z", 9)], [(1, "z", 9)], []),
    ([("update", "z", 9), ("insert", "n", 4)], [(1, "n", 4)], [0]),
    ([("insert", "a", 1), ("update", "b", 2), ("insert", "c", 3)], [(1, "b", 2)], [2]),
    ([("insert", "n", 4), ("delete", None, None), ("insert", "m", 5)], [(1, "m", 5)], []),
    ([("insert", "n", 4), ("delete", None, None), ("update", "z", 9)], [], [2]),
])
def test_changes_to_an_absent_key(make, rows, log, expected, missing):
    table = make("cupones", "idcupon, codigo", (2, "b"))
    batch = make(CHANGE, "idcupon, op, seq, codigo, usos_maximos", *[(1, op, i, c, n) for i, (op, c, n) in enumerate(log)])
    new, gone = changes.apply_changes(table, batch, "idcupon")
    assert rows(new.where("idcupon = 1"), "idcupon", "codigo", "usos_maximos") == expected
    assert rows(new.where("idcupon = 2"), "codigo") == [("b",)]
    assert rows(gone, "seq") == [(k,) for k in missing]


def test_role_changes_reach_every_row(spark, make, rows):
    pairs = make("rolxpermiso", "idrol, idpermiso", (1, 5), (1, 6), (2, 6))
    wanted = spark.createDataFrame([(1, 9, 1), (7, 9, 1), (2, None, 1)], "idrol INT, idpermiso INT, seq BIGINT")
    new, missing = changes.replace_role_permission(pairs, wanted)
    assert rows(new) == [(1, 9), (1, 9), (2, 6)] and rows(missing) == [(7,)]
    left, absent = changes.delete_pairs(pairs, make("rolxpermiso", "idrol, idpermiso", (1, 5), (1, 7)))
    assert rows(left) == [(1, 6), (2, 6)] and rows(absent) == [(1, 7)]


def test_key_only_deletes(spark, make, rows):
    table = make("carrusel", "idfoto, foto", (1, "a"), (2, "b"))
    batch = spark.createDataFrame([(1, "delete", 1), (5, "delete", 2)], "idfoto BIGINT, op STRING, seq BIGINT")
    new, missing = changes.apply_changes(table, batch, "idfoto")
    assert rows(new) == [(2, "b")] and rows(missing, "idfoto", "reason") == [(5, "no_such_key")]


def test_contains_text_of_null(spark):
    assert spark.range(1).select(contains_text(F.lit(None).cast("string"), "x")).first()[0] is None


def test_a_second_created_event_is_refused(make, rows):
    event = ("a", 1, "CREATED", 1, "2024-01-01 10:00:00")
    log = make("paypal_logs", "order_id, iduser, status, total, ts", event, event, event,
               ("a", 1, "CREATED", 9, "2024-01-01 11:00:00"), ("a", 1, "CREATED", 8, None))
    state, rejects = pricing.payment_state(log)
    assert rows(state, "order_id", "total") == [("a", 1.0)]
    assert rows(rejects, "total", "reason") == [(1.0, "already_created")] * 2 + [(8.0, "missing_time"), (9.0, "already_created")]


def test_updates_of_flat_orders_that_share_an_id(make, rows):
    asks = make("compra", "idcompra, iduser, idproducto, cantidad", (1, 1, 10, 1), (2, 1, 10, 2), (2, 1, 10, 3), (None, 1, 10, 1))
    known = make("compra", "idcompra", (1,), (1,), (2,))
    orders, details, rejects = pricing.price_flat_orders(
        asks, make("users", "iduser", (1,)), make("producto", "idproducto, p_final", (10, 5)), known)
    assert rows(orders, "idcompra", "total") == rows(details, "idcompra", "total") == [(1, 5.0)]
    assert rows(rejects) == [(2, "repeated_order"), (2, "repeated_order"), (None, "missing_order_id")]


@pytest.fixture
def by_shuffles(spark):
    """Joins as those of large tables: no side is broadcast, no partitions are merged."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def test_requests_without_id_spread_over_tasks(spark, make, by_shuffles):
    line = '[{"idproducto": 1, "cantidad": 2}]'
    asked = make("idcompra BIGINT, iduser BIGINT, fecha TIMESTAMP_NTZ, codigoCupon STRING, productos STRING", "idcompra, iduser, productos",
                 *[(i if i % 5 == 0 else None, i, line) for i in range(200)], (5, 1, line))
    users, goods = make("users", "iduser", *[(i,) for i in range(200)]), make("producto", "idproducto, p_final", (1, 3))
    orders, _, rejects = pricing.price_orders(asked, users, goods, make("cupones", "idcupon"), "2024-01-20")
    spread = rejects.where("reason = 'missing_order_id'").groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in spread) == 160 and len(spread) > 1
    assert orders.count() == 39 and rejects.where("reason = 'repeated_order'").count() == 2


def test_invoice_parts_do_not_travel_with_the_lines(spark, make, rows):
    line = '[{"idproducto": 1, "cantidad": 2}, {"idproducto": 9, "cantidad": 1}]'
    orders = make("compras", "idcompra, iduser, productos", (1, 5, line), (2, 6, "[]"), (3, 7, line), (None, 8, line), (4, 9, "{oops"))
    details = make("compras_detalle", "iddetalle, idcompra, productos", (12, 1, "b"), (11, 1, "a"), (13, 2, "c"), (14, None, "d"), (15, 4, "e"))
    places = make("detalle_entrega", "identrega, idcompra, pais", (1, 1, "MX"), (2, 2, "US"), (3, 3, "MX"), (4, 4, "MX"))
    documents, rejects = baskets.invoice_documents(orders, details, places, make("producto", "idproducto, nomprod", (1, "taza")))
    assert rows(documents, "idcompra", "compra.iduser", "comprasDetalle.productos", "detalleEntrega.pais", "productos.idproducto") == [
        (1, 5, "a", "MX", ["taza", None]), (2, 6, "c", "US", [])]
    assert rows(rejects, "idcompra", "reason") == [
        (3, "detail_missing"), (4, "basket_unreadable"), (None, "detail_missing")]
    plan = documents._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [step for step in plan if "comprasDetalle#" in step and " pos#" in step]
