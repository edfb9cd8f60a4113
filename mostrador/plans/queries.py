"""The registered queries. Every one reads whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mostrador.functions.lines import as_variant
from mostrador.functions.scalars import moment
from mostrador.operators import baskets, catalog, changes, coupons, lookups, pricing, reports, search
from mostrador.plans.registry import QUERIES, query
from mostrador.plans.shop import AS_OF, CATEGORY, RULES, Shop
from mostrador.sources import keyed, tables
from mostrador.sources.versions import children
from mostrador.streaming import jobs

DAY = "'%Y-%m-%d'"
MICROS = "'%Y-%m-%d %H:%M:%S.%f'"
MONTH = "'%Y-%m'"


def day(column: str) -> str:
    return f"strftime({column}, {DAY})"


def micros(column: str) -> str:
    return f"strftime(CAST({column} AS TIMESTAMP), {MICROS})"


def dbl(expression: str) -> str:
    return f"CAST({expression} AS DOUBLE)"


def big(expression: str) -> str:
    return f"CAST({expression} AS BIGINT)"


def half_up(total: str, count: str) -> str:
    """total / count rounded half up to two places, in whole numbers."""
    return f"(({total}) * 200 + ({count})) // (2 * ({count})) / 100.0"


# ---- scans, lookups, joins -------------------------------------------------------------------------

USER_COLUMNS = (f'iduser, usuario AS "user", email, {day("fecha_nacimiento")} AS fecha_nacimiento, sexo, foto, estado, '
                f'idrol, {micros("created_at")} AS created_at')
PRODUCT_COLUMNS = (f"p.idproducto, p.iduser, p.nomprod, p.clave, {dbl('p.p_producto')} AS p_producto, p.descuento, "
                   f"{dbl('p.p_final')} AS p_final, p.tipo_personalizacion, p.foto, "
                   f"{micros('p.created_at')} AS created_at")


@query("load_users", f"SELECT {USER_COLUMNS} FROM users")
def _(s):
    return s.users


@query("load_producto", f"SELECT {PRODUCT_COLUMNS} FROM producto p")
def _(s):
    return s.producto


@query("load_permiso", "SELECT * FROM permiso")
def _(s):
    return s.permiso


@query("order_details", f"SELECT idcompra, idproducto, cantidad, {dbl('total')} AS total FROM compra")
def _(s):
    return lookups.order_details(s.compra_detalle)


@query("lookup", f"SELECT {USER_COLUMNS} FROM users WHERE iduser IN (SELECT iduser FROM comentarios)")
def _(s):
    return lookups.lookup(s.users, s.comentarios.select("iduser"), "iduser")


@query("lookup_missing", "SELECT DISTINCT idproducto FROM cambios WHERE idproducto NOT IN (SELECT idproducto FROM producto)")
def _(s):
    return lookups.lookup_missing(s.producto, s.product_changes.select("idproducto").distinct(), "idproducto")


@query("parse_orders", f"""
SELECT s.idcompra, s.iduser, s.codigocupon AS "codigoCupon", {day('s.fecha')} AS dia, d.pais,
       count(l.pos) AS lineas, {dbl('coalesce(sum(l.cantidad), 0)')} AS unidades
FROM solicitudes s JOIN detalle_entrega d USING (idcompra) LEFT JOIN lineas l ON l.idcompra = s.idcompra
GROUP BY ALL""")
def _(s):
    line = "ARRAY<STRUCT<idproducto: BIGINT, cantidad: INT, talla: STRING, tipo_personalizacion: STRING>>"
    request = F.struct(
        "idcompra", "iduser", "fecha", "codigoCupon", F.from_json("productos", line).alias("productos"),
        F.struct("pais", "nombre", "estado").alias("detalleEntrega"))
    texts = (s.order_requests.join(s.detalle_entrega.drop("identrega"), "idcompra")
             .select(F.to_json(request).alias("value")))
    orders, _ = tables.split_corrupt(tables.parse_orders(texts))
    units = F.aggregate("productos", F.lit(0.0), lambda t, l: t + l["cantidad"].try_cast("double"))
    return orders.select("idcompra", "iduser", "codigoCupon", F.date_format("fecha", "yyyy-MM-dd").alias("dia"),
                         F.col("detalleEntrega.pais").alias("pais"),
                         F.size("productos").cast("bigint").alias("lineas"), units.alias("unidades"))


@query("pack_lines", """
SELECT idcompra, '[' || string_agg('{"idproducto":' || idproducto || ',"cantidad":' || cantidad || ',"talla":"'
       || talla || '"}', ',' ORDER BY pos) || ']' AS productos
FROM lineas GROUP BY idcompra""")
def _(s):
    return baskets.pack_lines(s.lineas.select("idcompra", "pos", "idproducto", "cantidad", "talla"))


@query("order_listing", f"""
SELECT c.idcompra, {dbl('c.total')} AS total, {micros('c.fecha')} AS fecha, p.nomprod AS producto,
       u.email AS usuario, c.cantidad
FROM compra c JOIN users u ON c.iduser = u.iduser JOIN producto p ON c.idproducto = p.idproducto""")
def _(s):
    return lookups.order_listing(s.compra, s.users, s.producto)


@query("user_purchases", f"""
SELECT c.iduser, p.nomprod AS producto, p.foto AS "productoFoto", c.cantidad, {dbl('c.total')} AS total
FROM compra c JOIN producto p ON c.idproducto = p.idproducto
WHERE c.iduser IN (SELECT iduser FROM users WHERE idrol = 2)""")
def _(s):
    return lookups.user_purchases(s.compra, s.producto, s.users.where("idrol = 2").select("iduser"))


@query("detail_lines", f"""
SELECT d.idcompra, p.nomprod AS producto, d.cantidad, {dbl('d.total')} AS total
FROM compra d JOIN producto p ON d.idproducto = p.idproducto
WHERE d.idcompra IN (SELECT idcompra FROM compra WHERE total > 50000)""")
def _(s):
    keys = s.compra.where("total > 50000").select("idcompra")
    return lookups.detail_lines(s.compra_detalle, s.producto, keys)


@query("role_permissions", """
SELECT rp.idrol, rp.idpermiso, p.nompermiso AS nombre_permiso
FROM rolxpermiso rp JOIN permiso p ON rp.idpermiso = p.idpermiso WHERE rp.idrol IN (SELECT idrol FROM rol)""")
def _(s):
    return lookups.role_permissions(s.rolxpermiso, s.permiso, s.rol.select("idrol"))


@query("product_comments", f"""
SELECT c.idproducto, c.comentario, {micros('c.fecha')} AS fecha, c.calificacion, u.usuario AS "user", u.foto AS "userFoto"
FROM comentarios c JOIN users u ON c.iduser = u.iduser
WHERE c.idproducto IN (SELECT idproducto FROM producto WHERE descuento > 0)""")
def _(s):
    keys = catalog.discounted(s.producto).select("idproducto")
    return lookups.product_comments(s.comentarios, s.users, keys)


@query("require_parent", f"""
SELECT idcompra, idproducto, cantidad, {dbl('total')} AS total FROM compra
WHERE idproducto IN (SELECT idproducto FROM comentarios)""")
def _(s):
    ok, _ = lookups.require_parent(lookups.order_details(s.compra_detalle), s.comentarios.select("idproducto"),
                                   "idproducto")
    return ok


@query("require_parent_rejects", f"""
SELECT idcompra, idproducto, cantidad, {dbl('total')} AS total FROM compra
WHERE idproducto NOT IN (SELECT idproducto FROM comentarios)""")
def _(s):
    _, rejects = lookups.require_parent(lookups.order_details(s.compra_detalle), s.comentarios.select("idproducto"),
                                        "idproducto")
    return rejects


# ---- flat reports ----------------------------------------------------------------------------------

@query("yearly_summary", f"""
SELECT year(fecha) AS "Año", count(*) AS "Count", {dbl('sum(total)')} AS "Sum",
       round({dbl('sum(total)')} / count(*), 6) AS "Avg",
       {half_up('CAST(sum(total) * 100 AS HUGEINT) * 100',
                '(SELECT CAST(sum(total) * 100 AS HUGEINT) FROM compra)')} AS "Porcentaje"
FROM compra GROUP BY 1""")
def _(s):
    return reports.yearly_summary(s.compra)


@query("sales_by_product_year", f"""
SELECT p.nomprod AS "Nombre_Producto", year(c.fecha) AS "Año", {dbl('sum(c.total)')} AS "Total"
FROM compra c LEFT JOIN producto p ON c.idproducto = p.idproducto GROUP BY 1, 2""")
def _(s):
    return reports.sales_by_product_year(s.compra, s.producto)


@query("sales_by_product_year_compat", f"""
SELECT p.nomprod AS "Nombre_Producto", year(c.fecha) AS "Año", {dbl('sum(c.total)')} AS "Total"
FROM compra c LEFT JOIN producto p ON c.idproducto = p.idproducto
     LEFT JOIN comentarios k ON c.idproducto = k.idproducto GROUP BY 1, 2""")
def _(s):
    return reports.sales_by_product_year(s.compra, s.producto, s.comentarios, compat=True)


def _monthly(table, measure):
    return f"SELECT strftime(fecha, {MONTH}) AS mes, {measure} FROM {table} GROUP BY 1"


@query("monthly_revenue", _monthly("compra", f"{dbl('sum(total)')} AS total_compras"))
def _(s):
    return reports.monthly_revenue(s.compra)


@query("monthly_orders", _monthly("compra", "count(*) AS total_ordenes"))
def _(s):
    return reports.monthly_orders(s.compra)


@query("monthly_revenue_baskets", _monthly("pedidos", f"{dbl('sum(total)')} AS total_compras"))
def _(s):
    return reports.monthly_revenue(s.compras)


@query("monthly_orders_baskets", _monthly("pedidos", "count(*) AS total_ordenes"))
def _(s):
    return reports.monthly_orders(s.compras)


@query("order_value_totals", f"""
SELECT {dbl('sum(total)')} AS total_dinero_compras, round({dbl('sum(total)')} / count(*), 1) AS media_dinero_compras
FROM pedidos""")
def _(s):
    return reports.order_value_totals(s.compras)


@query("users_by_sex", "SELECT sexo, count(*) AS cantidad FROM users WHERE sexo IN ('hombre', 'mujer') GROUP BY 1")
def _(s):
    return reports.users_by(s.users, "sexo", ("hombre", "mujer"))


@query("users_by_state", "SELECT estado, count(*) AS total_usuarios FROM users GROUP BY 1")
def _(s):
    return reports.users_by(s.users, "estado", count_name="total_usuarios")


def _ages(bands):
    age = (f"(year(DATE '{AS_OF}') - year(fecha_nacimiento) - CASE WHEN month(DATE '{AS_OF}') * 100 + "
           f"day(DATE '{AS_OF}') < month(fecha_nacimiento) * 100 + day(fecha_nacimiento) THEN 1 ELSE 0 END)")
    counts = [f"""{big(f'sum(CASE WHEN {age} BETWEEN {a} AND {b} THEN 1 ELSE 0 END)')} AS "{a}-{b}" """ for a, b in bands]
    return f"SELECT {', '.join(counts)} FROM users"


@query("age_histogram", _ages(reports.AGE_BANDS))
def _(s):
    return reports.age_histogram(s.users, AS_OF)


@query("age_histogram_wide", _ages(reports.WIDE_AGE_BANDS))
def _(s):
    return reports.age_histogram(s.users, AS_OF, reports.WIDE_AGE_BANDS)


@query("new_users_by_month", """
SELECT strftime(created_at, '%B %Y') AS mes, count(*) AS total_nuevos FROM users GROUP BY 1""")
def _(s):
    return reports.new_users_by_month(s.users)


@query("products_per_user", """
SELECT u.usuario AS nombre_usuario, count(p.idproducto) AS total_productos
FROM users u LEFT JOIN producto p ON u.iduser = p.iduser GROUP BY 1""")
def _(s):
    return reports.products_per_user(s.users, s.producto)


@query("count_products", "SELECT count(*) AS total_productos FROM producto")
def _(s):
    return reports.count_where(s.producto, name="total_productos")


@query("count_discounted", "SELECT count(*) AS total FROM producto WHERE descuento > 0")
def _(s):
    return reports.count_where(s.producto, F.col("descuento") > 0)


@query("count_users", "SELECT count(*) AS cantidad_usuarios FROM users")
def _(s):
    return reports.count_where(s.users, name="cantidad_usuarios")


@query("count_administrators", "SELECT count(*) AS cantidad_administradores FROM users WHERE idrol = 2")
def _(s):
    return reports.count_where(s.users, F.col("idrol") == changes.ADMINISTRATOR, "cantidad_administradores")


VISITS = f"SELECT strftime(ts, {MONTH}) AS mes, count(*) AS numero_de_visitas FROM visitas GROUP BY 1"


@query("visits_by_month", VISITS)
def _(s):
    return reports.visits_by_month(changes.visit_counts(s.visitas))


@query("visits_total", "SELECT count(*) AS total_visitas FROM visitas")
def _(s):
    return reports.visits_total(changes.visit_counts(s.visitas))


@query("top_states", """
SELECT estado, count(*) AS total_usuarios,
       (count(*) * 2000 + (SELECT count(*) FROM users)) // (2 * (SELECT count(*) FROM users)) / 10.0 AS porcentaje
FROM users GROUP BY 1 ORDER BY total_usuarios DESC, estado LIMIT 5""")
def _(s):
    return reports.top_states(s.users)


@query("best_sellers", """
SELECT p.foto, p.nomprod, count(*) AS total_ventas FROM compra c JOIN producto p ON c.idproducto = p.idproducto
GROUP BY 1, 2 ORDER BY total_ventas DESC, nomprod, foto LIMIT 5""")
def _(s):
    return reports.best_sellers(s.compra, s.producto)


@query("top_coupons", """
SELECT c.codigo AS nombre_codigo, count(u.idcupon) AS cantidad_usados
FROM cupones_usados u JOIN cupones c ON u.idcupon = c.idcupon
GROUP BY 1 ORDER BY cantidad_usados DESC, nombre_codigo LIMIT 5""")
def _(s):
    return reports.top_coupons(s.cupones_usados, s.cupones)


@query("top_coupon_users", """
SELECT u.usuario AS nombre_usuario, u.foto AS foto_usuario, count(c.idcupon) AS cantidad_usados
FROM cupones_usados c JOIN users u ON c.iduser = u.iduser
GROUP BY 1, 2 ORDER BY cantidad_usados DESC, nombre_usuario, foto_usuario LIMIT 5""")
def _(s):
    return reports.top_coupon_users(s.cupones_usados, s.users)


@query("top_rated", f"""
SELECT p.idproducto, p.nomprod, avg(c.calificacion) AS promedio_calificacion
FROM producto p JOIN comentarios c ON p.idproducto = c.idproducto
GROUP BY 1, 2 ORDER BY promedio_calificacion DESC NULLS LAST, p.idproducto LIMIT 3""")
def _(s):
    return reports.top_rated(s.producto, s.comentarios)


@query("newest_users", f"SELECT {USER_COLUMNS} FROM (SELECT * FROM users ORDER BY created_at DESC, iduser LIMIT 8)")
def _(s):
    return reports.newest_users(s.users)


# ---- ratings and catalogue -------------------------------------------------------------------------

STARS = "coalesce(sum(CASE WHEN c.calificacion IN (1, 2, 3, 4, 5) THEN c.calificacion ELSE 0 END), 0)"


def rated(condition: str = "", owner: bool = False) -> str:
    return f"""
SELECT {PRODUCT_COLUMNS}, {"u.usuario AS nombre_usuario," if owner else ""}
       coalesce({half_up(STARS, 'nullif(count(c.calificacion), 0)')}, 0) AS calificacion_final
FROM producto p LEFT JOIN comentarios c ON p.idproducto = c.idproducto
     {"LEFT JOIN users u ON p.iduser = u.iduser" if owner else ""} {condition}
GROUP BY ALL"""


SELLERS = "(SELECT iduser FROM users WHERE sexo = 'mujer')"


def _sellers(s):
    return s.users.where("sexo = 'mujer'").select("iduser")


@query("rating_summary", f"""
SELECT c.idproducto, {', '.join(f'''{big(f'sum(CASE WHEN c.calificacion = {r} THEN 1 ELSE 0 END)')} AS "{r}"'''
                                for r in catalog.RATINGS)},
       count(*) AS "TOTAL", {half_up(STARS, 'count(*)')} AS calificacion_final
FROM comentarios c GROUP BY 1""")
def _(s):
    return catalog.rating_summary(s.comentarios)


@query("with_rating", rated())
def _(s):
    return catalog.with_rating(s.producto, s.comentarios)


@query("plain_products", rated("WHERE p.tipo_personalizacion = 'no_personalizado'", owner=True))
def _(s):
    return catalog.plain_products(s.producto, s.comentarios, s.users)


@query("plain_products_of_owners",
       rated(f"WHERE p.tipo_personalizacion = 'no_personalizado' AND p.iduser IN {SELLERS}", owner=True))
def _(s):
    return catalog.plain_products(s.producto, s.comentarios, s.users, _sellers(s))


@query("personalised_of_owners",
       rated(f"WHERE p.tipo_personalizacion = 'personalizado' AND p.iduser IN {SELLERS}", owner=True))
def _(s):
    return catalog.personalised_of_owners(s.producto, s.comentarios, s.users, _sellers(s))


@query("personalised_products", rated("WHERE p.tipo_personalizacion = 'personalizado'"))
def _(s):
    return catalog.personalised_products(s.producto, s.comentarios)


@query("newest_products", rated("""
WHERE p.idproducto IN (SELECT idproducto FROM producto WHERE tipo_personalizacion = 'no_personalizado'
                       ORDER BY created_at DESC, idproducto LIMIT 4)"""))
def _(s):
    return catalog.newest_products(s.producto, s.comentarios)


@query("discounted_products", rated("WHERE p.descuento > 0"))
def _(s):
    return catalog.discounted_products(s.producto, s.comentarios)


@query("products_by_id", rated("WHERE p.idproducto IN (SELECT idproducto FROM comentarios)"))
def _(s):
    return catalog.products_by_id(s.producto, s.comentarios, s.comentarios.select("idproducto"))


@query("search_products", rated("WHERE p.nomprod ILIKE '%RED%'"))
def _(s):
    return catalog.search_products(s.producto, "RED", s.comentarios)


@query("search_products_discounted", rated("WHERE p.nomprod ILIKE '%bolt%' AND p.descuento > 0"))
def _(s):
    return catalog.search_products(s.producto, "bolt", s.comentarios, discounted_only=True)


@query("search_names", f"SELECT {PRODUCT_COLUMNS} FROM producto p WHERE p.nomprod ILIKE '%ing%'")
def _(s):
    return catalog.search_products(s.producto, "ing")


@query("products_of_category", rated(f"WHERE p.clave = '{CATEGORY}'"))
def _(s):
    return catalog.products_of_category(s.producto, s.comentarios, CATEGORY)


@query("products_of_category_discounted", rated(f"WHERE p.clave = '{CATEGORY}' AND p.descuento > 0"))
def _(s):
    return catalog.products_of_category(s.producto, s.comentarios, CATEGORY, discounted_only=True)


@query("distinct_keys", "SELECT DISTINCT clave FROM producto")
def _(s):
    return catalog.distinct_keys(s.producto)


@query("distinct_keys_discounted", "SELECT DISTINCT clave FROM producto WHERE descuento > 0")
def _(s):
    return catalog.distinct_keys(s.producto, discounted_only=True)


@query("related_products", """, orden AS (
  SELECT clave, idproducto, count(*) OVER (PARTITION BY clave) AS n,
         row_number() OVER (PARTITION BY clave ORDER BY substr(md5(idproducto || ':7'), 1, 15), idproducto) - 1 AS puesto
  FROM producto)
SELECT a.idproducto AS idancla, b.idproducto, p.nomprod, p.clave
FROM orden a JOIN range(1, 5) pasos(paso) ON paso < a.n
JOIN orden b ON b.clave = a.clave AND b.puesto = (a.puesto + paso) % a.n JOIN producto p ON p.idproducto = b.idproducto""")
def _(s):
    found = catalog.related_products(s.producto, s.producto.select("idproducto", "clave"), k=4, seed=7)
    return found.select("idancla", "idproducto", "nomprod", "clave")


@query("related_products_counts", """
SELECT idproducto AS idancla, least(4, count(*) OVER (PARTITION BY clave) - 1) AS relacionados, true AS validos
FROM producto""")
def _(s):
    """How many products each anchor got, and whether all are others of its category."""
    found = catalog.related_products(s.producto, s.producto.select("idproducto", "clave"), k=4, seed=7,
                                     comments=s.comentarios)
    anchors = s.producto.select(F.col("idproducto").alias("idancla"), F.col("clave").alias("_clave"))
    return (found.join(anchors, "idancla").groupBy("idancla")
            .agg(F.count_distinct("idproducto").alias("relacionados"),
                 F.bool_and((F.col("clave") == F.col("_clave")) & (F.col("idproducto") != F.col("idancla")))
                 .alias("validos")))


# ---- baskets ---------------------------------------------------------------------------------------

@query("explode_lines", f"""
SELECT idcompra, pos, idproducto, {dbl('cantidad')} AS cantidad, talla, tipo_personalizacion,
       {dbl('total_producto')} AS total_producto FROM lineas""")
def _(s):
    from mostrador.functions.lines import explode_lines
    return explode_lines(s.compras, keep=["idcompra"]).drop("clave")


@query("total_units", f"SELECT {dbl('sum(cantidad)')} AS total_productos_comprados FROM lineas")
def _(s):
    return baskets.total_units(s.compras)


TEN = """, diez AS (SELECT idcompra, sum(cantidad) AS unidades FROM lineas WHERE pos < 10 GROUP BY 1),
contiene AS (SELECT DISTINCT idcompra, idproducto FROM lineas)"""


@query("units_by_seller", f"""
SELECT u.usuario AS nombre_usuario, {dbl('sum(l.cantidad)')} AS total_productos_vendidos
FROM lineas l JOIN producto p ON l.idproducto = p.idproducto JOIN users u ON p.iduser = u.iduser GROUP BY 1""")
def _(s):
    return baskets.units_by_seller(s.compras, s.producto, s.users)


@query("units_by_seller_compat", f"""{TEN}
SELECT u.usuario AS nombre_usuario, {dbl('sum(d.unidades)')} AS total_productos_vendidos
FROM contiene c JOIN diez d ON c.idcompra = d.idcompra JOIN producto p ON c.idproducto = p.idproducto
     JOIN users u ON p.iduser = u.iduser GROUP BY 1""")
def _(s):
    return baskets.units_by_seller(s.compras, s.producto, s.users, compat=True)


@query("units_by_product", f"""
SELECT p.nomprod AS nombre_producto, {dbl('sum(l.cantidad)')} AS total_cantidad_comprada
FROM lineas l JOIN producto p ON l.idproducto = p.idproducto WHERE p.clave = '{CATEGORY}' GROUP BY 1""")
def _(s):
    return baskets.units_by_product(s.compras, s.producto, CATEGORY)


@query("units_by_product_compat", f"""{TEN}
SELECT p.nomprod AS nombre_producto, {dbl('sum(d.unidades)')} AS total_cantidad_comprada
FROM contiene c JOIN diez d ON c.idcompra = d.idcompra JOIN producto p ON c.idproducto = p.idproducto
WHERE p.clave = '{CATEGORY}' GROUP BY 1""")
def _(s):
    return baskets.units_by_product(s.compras, s.producto, CATEGORY, compat=True)


THREE = """, tres AS (
  SELECT idcompra, sum(cantidad) AS unidades, max(CASE WHEN pos = 0 THEN idproducto END) AS idproducto
  FROM lineas WHERE pos < 3 GROUP BY 1)"""


@query("units_by_product_month", f"""
SELECT p.nomprod AS producto, strftime(o.fecha, {MONTH}) AS mes, {dbl('sum(l.cantidad)')} AS total_comprado
FROM lineas l JOIN pedidos o ON l.idcompra = o.idcompra JOIN producto p ON l.idproducto = p.idproducto GROUP BY 1, 2""")
def _(s):
    return baskets.units_by_product_month(s.compras, s.producto)


@query("units_by_product_month_compat", f"""{THREE}
SELECT p.nomprod AS producto, strftime(o.fecha, {MONTH}) AS mes, {dbl('sum(t.unidades)')} AS total_comprado
FROM tres t JOIN pedidos o ON t.idcompra = o.idcompra JOIN producto p ON t.idproducto = p.idproducto GROUP BY 1, 2""")
def _(s):
    return baskets.units_by_product_month(s.compras, s.producto, compat=True)


@query("top_products", f"""
SELECT p.idproducto, p.nomprod AS nombre_producto, p.foto, {dbl('sum(l.cantidad)')} AS total_comprado
FROM lineas l JOIN producto p ON l.idproducto = p.idproducto
GROUP BY 1, 2, 3 ORDER BY total_comprado DESC, p.idproducto LIMIT 5""")
def _(s):
    return baskets.top_products(s.compras, s.producto)


@query("top_products_compat", f"""{THREE}
SELECT p.idproducto, p.nomprod AS nombre_producto, p.foto, {dbl('sum(t.unidades)')} AS total_comprado
FROM tres t JOIN producto p ON t.idproducto = p.idproducto
GROUP BY 1, 2, 3 ORDER BY total_comprado DESC, p.idproducto LIMIT 5""")
def _(s):
    return baskets.top_products(s.compras, s.producto, compat=True)


def _buyers(condition):
    return f"""
SELECT u.usuario AS nombre_usuario, u.foto AS foto_usuario, u.iduser,
       {dbl('coalesce(sum(l.cantidad), 0)')} AS cantidad_compras
FROM pedidos o JOIN users u ON o.iduser = u.iduser LEFT JOIN lineas l ON o.idcompra = l.idcompra {condition}
GROUP BY 1, 2, 3 ORDER BY cantidad_compras DESC, u.iduser LIMIT 6"""


@query("top_buyers", _buyers(""))
def _(s):
    return baskets.top_buyers(s.compras, s.users)


@query("top_buyers_compat", _buyers("AND l.pos < 5"))
def _(s):
    return baskets.top_buyers(s.compras, s.users, compat=True)


def _with_line(kind):
    return f"""
SELECT idcompra, iduser, {dbl('total')} AS total, {day('fecha')} AS fecha FROM pedidos
WHERE idcompra IN (SELECT idcompra FROM lineas WHERE tipo_personalizacion = '{kind}')"""


def _order_heads(df):
    return df.select("idcompra", "iduser", "total", F.date_format("fecha", "yyyy-MM-dd").alias("fecha"))


@query("orders_with_line_personalised", _with_line("personalizado"))
def _(s):
    return _order_heads(baskets.orders_with_line(s.compras, "tipo_personalizacion", "personalizado"))


@query("orders_with_line_plain", _with_line("no_personalizado"))
def _(s):
    return _order_heads(baskets.orders_with_line(s.compras, "tipo_personalizacion", "no_personalizado"))


@query("orders_containing", f"""
SELECT DISTINCT idcompra, idproducto FROM lineas
WHERE idproducto IN (SELECT idproducto FROM producto WHERE clave = '{CATEGORY}')""")
def _(s):
    return baskets.orders_containing(s.compras, s.producto.where(F.col("clave") == CATEGORY).select("idproducto"))


NAMED = """string_agg(p.nomprod || '|' || l.cantidad || '|' || l.talla || '|' || l.tipo_personalizacion || '|'
       || l.total_producto, ';' ORDER BY l.pos)"""
NAMED_JOIN = "LEFT JOIN lineas l ON l.idcompra = o.idcompra LEFT JOIN producto p ON l.idproducto = p.idproducto"


def _line_text(df):
    """Enriched lines as one text per order, so that any engine can compare them."""
    line = lambda e: F.concat_ws("|", e["idproducto"], e["cantidad"].cast("int"), e["talla"],
                                 e["tipo_personalizacion"], e["total_producto"].cast("decimal(14,2)"))
    text = F.array_join(F.transform("productos", line), ";")
    return df.withColumn("productos", F.when(F.size("productos") > 0, text))


@query("enrich_orders", f"""
SELECT o.idcompra, u.email AS usuario, {NAMED} AS productos, {dbl('o.total')} AS total, {micros('o.fecha')} AS fecha
FROM pedidos o JOIN users u ON o.iduser = u.iduser {NAMED_JOIN} GROUP BY o.idcompra, u.email, o.total, o.fecha""")
def _(s):
    return _line_text(baskets.enrich_orders(s.compras, s.users, s.producto))


@query("enrich_lines", f"""
SELECT o.idcompra AS iddetalle, o.idcompra, {NAMED} AS productos, {dbl('o.total')} AS total,
       CASE WHEN o.idcompra % 3 = 0 THEN 'Brand#' || (1 + o.idcompra % 25) END AS "codigoCupon"
FROM pedidos o {NAMED_JOIN} GROUP BY o.idcompra, o.total""")
def _(s):
    return _line_text(baskets.enrich_lines(s.compras_detalle, s.producto))


@query("enrich_user_orders", f"""
SELECT o.idcompra, o.iduser, {NAMED} AS productos, {dbl('o.total')} AS total, {micros('o.fecha')} AS fecha
FROM pedidos o {NAMED_JOIN} WHERE o.iduser IN (SELECT iduser FROM users WHERE idrol = 2)
GROUP BY o.idcompra, o.iduser, o.total, o.fecha""")
def _(s):
    keys = s.users.where("idrol = 2").select("iduser")
    return _line_text(baskets.enrich_lines(lookups.lookup(s.compras, keys, "iduser"), s.producto))


@query("invoice_documents", f"""
SELECT o.idcompra, o.iduser, {dbl('o.total')} AS total, o.idcompra AS iddetalle,
       CASE WHEN o.idcompra % 3 = 0 THEN 'Brand#' || (1 + o.idcompra % 25) END AS "codigoCupon",
       d.pais, d.nombre, d.estado, {NAMED} AS productos
FROM pedidos o JOIN detalle_entrega d ON d.idcompra = o.idcompra {NAMED_JOIN}
GROUP BY o.idcompra, o.iduser, o.total, d.pais, d.nombre, d.estado""")
def _(s):
    documents, _ = baskets.invoice_documents(s.compras, s.compras_detalle, s.detalle_entrega, s.producto)
    return _line_text(documents.select(
        "idcompra", "compra.iduser", "compra.total", "comprasDetalle.iddetalle", "comprasDetalle.codigoCupon",
        "detalleEntrega.pais", "detalleEntrega.nombre", "detalleEntrega.estado", "productos"))


# ---- pricing and payments --------------------------------------------------------------------------

PRICED = f""", ofertas AS (
  SELECT codigo, porcentaje FROM cupones
  WHERE activo AND usos_maximos > 0 AND CAST(fecha_expiracion AS TIMESTAMP) >= TIMESTAMP '{AS_OF}'),
juzgadas AS (
  SELECT s.*, coalesce(o.porcentaje, 0) AS porcentaje,
         CASE WHEN u.iduser IS NULL THEN 'unknown_user'
              WHEN s.codigocupon IS NOT NULL AND o.codigo IS NULL THEN 'invalid_coupon'
              WHEN s.idcompra NOT IN (SELECT idcompra FROM lineas) THEN 'empty_basket' END AS reason
  FROM solicitudes s LEFT JOIN users u ON s.iduser = u.iduser LEFT JOIN ofertas o ON s.codigocupon = o.codigo),
preciadas AS (
  SELECT j.idcompra, j.iduser, j.fecha, j.codigocupon, l.pos, l.idproducto, l.cantidad, l.talla,
         l.tipo_personalizacion, p.clave,
         p.p_final * l.cantidad * (100 - j.porcentaje) * CAST(0.01 AS DECIMAL(3,2)) AS total_producto
  FROM juzgadas j JOIN lineas l ON j.idcompra = l.idcompra JOIN producto p ON l.idproducto = p.idproducto
  WHERE j.reason IS NULL)"""
PRICED_ORDERS = f"""{PRICED}
SELECT idcompra, iduser, codigocupon AS "codigoCupon", {dbl('round(sum(total_producto), 2)')} AS total, {day('fecha')} AS dia
FROM preciadas GROUP BY idcompra, iduser, codigocupon, fecha"""
PRICED_LINES = f"""{PRICED}
SELECT idcompra, iduser, pos, idproducto, {dbl('cantidad')} AS cantidad, talla, tipo_personalizacion, clave,
       {dbl('round(total_producto, 6)')} AS total_producto FROM preciadas"""


def _prices(s):
    return pricing.price_orders(s.order_requests, s.users, s.producto, s.cupones, AS_OF)


def _priced_heads(orders):
    return orders.select("idcompra", "iduser", "codigoCupon", "total", F.date_format("fecha", "yyyy-MM-dd").alias("dia"))


@query("price_orders", PRICED_ORDERS)
def _(s):
    return _priced_heads(_prices(s)[0])


@query("price_orders_lines", PRICED_LINES)
def _(s):
    return _prices(s)[1]


@query("price_orders_rejects", f"{PRICED} SELECT idcompra, reason FROM juzgadas WHERE reason IS NOT NULL")
def _(s):
    return _prices(s)[2]


@query("reprice_orders", f"""
SELECT l.idcompra, o.iduser, {dbl('round(sum(p.p_final * l.cantidad), 2)')} AS total
FROM lineas l JOIN producto p ON l.idproducto = p.idproducto JOIN pedidos o ON l.idcompra = o.idcompra GROUP BY 1, 2""")
def _(s):
    orders, _, _ = pricing.reprice_orders(s.compras, s.producto, s.users)
    return orders.select("idcompra", "iduser", "total")


@query("reprice_details", f"""
SELECT l.idcompra AS iddetalle, l.idcompra, {dbl('round(sum(p.p_final * l.cantidad), 2)')} AS total
FROM lineas l JOIN producto p ON l.idproducto = p.idproducto GROUP BY 1""")
def _(s):
    details, _, _ = pricing.reprice_orders(s.compras_detalle, s.producto, key="iddetalle")
    return details.select("iddetalle", "idcompra", "total")


def _two_details(s):
    """Two details for every second order: its basket, and once more without its first line's fellow lines."""
    first = s.compras_detalle
    one = "to_json(slice(from_json(productos, 'ARRAY<STRUCT<idproducto: STRING, cantidad: STRING>>'), 1, 1))"
    return first.select("iddetalle", "idcompra", "productos").unionByName(first.where("idcompra % 2 = 0").select(
        (-1 - F.col("idcompra")).alias("iddetalle"), "idcompra", F.expr(one).alias("productos")))


@query("reprice_two_details", f"""
SELECT l.idcompra AS iddetalle, l.idcompra, {dbl('round(sum(p.p_final * l.cantidad), 2)')} AS total
FROM lineas l JOIN producto p ON l.idproducto = p.idproducto GROUP BY 1
UNION ALL
SELECT -1 - l.idcompra, l.idcompra, {dbl('round(p.p_final * l.cantidad, 2)')}
FROM (SELECT * FROM lineas QUALIFY row_number() OVER (PARTITION BY idcompra ORDER BY pos) = 1) l
JOIN producto p ON l.idproducto = p.idproducto WHERE l.idcompra % 2 = 0""")
def _(s):
    details, _, _ = pricing.reprice_orders(_two_details(s), s.producto, key="iddetalle")
    return details.select("iddetalle", "idcompra", "total")


def _untidy_requests(s):
    """The requests with every fifth sent twice and every seventh without its id."""
    asked = s.order_requests
    sent = asked.unionByName(asked.where("idcompra % 5 = 0"))
    return sent.withColumn("idcompra", F.when(F.col("idcompra") % 7 != 0, F.col("idcompra")))


def _untidy_prices(s):
    return pricing.price_orders(_untidy_requests(s), s.users, s.producto, s.cupones, AS_OF)


@query("price_untidy_orders", f"{PRICED_ORDERS.replace('FROM preciadas', 'FROM preciadas WHERE idcompra % 5 <> 0 AND idcompra % 7 <> 0')}")
def _(s):
    return _priced_heads(_untidy_prices(s)[0])


@query("price_untidy_orders_rejects", f"""{PRICED}
SELECT CASE WHEN idcompra % 7 <> 0 THEN idcompra END AS idcompra,
       CASE WHEN idcompra % 7 = 0 THEN 'missing_order_id' WHEN idcompra % 5 = 0 THEN 'repeated_order' ELSE reason END AS reason
FROM juzgadas, range(2) veces(vez)
WHERE (vez = 0 OR idcompra % 5 = 0) AND (idcompra % 5 = 0 OR idcompra % 7 = 0 OR reason IS NOT NULL)""")
def _(s):
    return _untidy_prices(s)[2]


@query("price_flat_orders", f"""
SELECT c.idcompra, c.iduser, c.idproducto, c.cantidad, {dbl('round(p.p_final * c.cantidad, 2)')} AS total,
       {micros('c.fecha')} AS fecha
FROM compra c JOIN producto p ON c.idproducto = p.idproducto JOIN users u ON c.iduser = u.iduser""")
def _(s):
    orders, _, _ = pricing.price_flat_orders(s.compra.drop("total"), s.users, s.producto)
    return orders


@query("price_details", f"""
SELECT c.idcompra AS iddetalle, c.idcompra, c.idproducto, c.cantidad, {dbl('round(p.p_final * c.cantidad, 2)')} AS total
FROM compra c JOIN producto p ON c.idproducto = p.idproducto""")
def _(s):
    details, _ = pricing.price_details(s.compra_detalle.drop("total"), s.compra, s.producto)
    return details


@query("validate_products", """
SELECT idcompra, pos, idproducto FROM lineas
WHERE idcompra NOT IN (SELECT idcompra FROM lineas GROUP BY idcompra HAVING count(*) > count(DISTINCT idproducto))""")
def _(s):
    ok, _ = pricing.validate_products(s.lineas.select("idcompra", "pos", "idproducto"), s.producto)
    return ok


@query("validate_products_rejects", """
SELECT idcompra, 'repeated_product' AS reason FROM lineas GROUP BY idcompra HAVING count(*) > count(DISTINCT idproducto)""")
def _(s):
    _, rejects = pricing.validate_products(s.lineas.select("idcompra", "pos", "idproducto"), s.producto)
    return rejects


KNOWN_USERS, KNOWN_PRODUCTS = "iduser % 10 <> 0", "idproducto % 50 <> 0"
UNKNOWN_USER = f"iduser NOT IN (SELECT iduser FROM users WHERE {KNOWN_USERS})"
UNKNOWN_PRODUCT = f"idproducto NOT IN (SELECT idproducto FROM producto WHERE {KNOWN_PRODUCTS})"


@query("reprice_orders_rejects", f"""
SELECT idcompra, CASE WHEN o.{UNKNOWN_USER} THEN 'unknown_user' WHEN falta IS NULL THEN 'empty_basket'
       ELSE 'unknown_product' END AS reason
FROM pedidos o LEFT JOIN (SELECT idcompra, bool_or({UNKNOWN_PRODUCT}) AS falta FROM lineas GROUP BY 1) USING (idcompra)
WHERE o.{UNKNOWN_USER} OR falta IS NULL OR falta""")
def _(s):
    return pricing.reprice_orders(s.compras, s.producto.where(KNOWN_PRODUCTS), s.users.where(KNOWN_USERS))[2]


@query("price_flat_orders_rejects", f"""
SELECT idcompra, CASE WHEN {UNKNOWN_USER} THEN 'unknown_user' ELSE 'unknown_product' END AS reason
FROM compra WHERE {UNKNOWN_USER} OR {UNKNOWN_PRODUCT}""")
def _(s):
    return pricing.price_flat_orders(s.compra.drop("total"), s.users.where(KNOWN_USERS), s.producto.where(KNOWN_PRODUCTS))[2]


@query("update_flat_orders_rejects", f"""
SELECT idcompra, CASE WHEN idcompra % 6 = 0 THEN 'unknown_order' WHEN {UNKNOWN_USER} THEN 'unknown_user'
       ELSE 'unknown_product' END AS reason
FROM compra WHERE idcompra % 6 = 0 OR {UNKNOWN_USER} OR {UNKNOWN_PRODUCT}""")
def _(s):
    return pricing.price_flat_orders(s.compra.drop("total"), s.users.where(KNOWN_USERS), s.producto.where(KNOWN_PRODUCTS),
                                     s.compra.where("idcompra % 6 <> 0"))[2]


def _repeated_updates(s):
    """Updates of all flat orders, every fifth sent twice, every seventh without its id."""
    sent = s.compra.drop("total")
    sent = sent.unionByName(sent.where("idcompra % 5 = 0")).withColumn("idcompra", F.when(F.col("idcompra") % 7 != 0, F.col("idcompra")))
    return pricing.price_flat_orders(sent, s.users, s.producto, s.compra.unionByName(s.compra.where("idcompra % 3 = 0")))


@query("update_flat_orders_repeats", f"""
SELECT c.idcompra, c.iduser, c.idproducto, c.cantidad, {dbl('round(p.p_final * c.cantidad, 2)')} AS total,
       {micros('c.fecha')} AS fecha
FROM compra c JOIN producto p ON c.idproducto = p.idproducto JOIN users u ON c.iduser = u.iduser
WHERE c.idcompra % 5 <> 0 AND c.idcompra % 7 <> 0""")
def _(s):
    return _repeated_updates(s)[0]


@query("update_flat_orders_repeats_rejects", """
SELECT CASE WHEN idcompra % 7 <> 0 THEN idcompra END AS idcompra,
       CASE WHEN idcompra % 7 = 0 THEN 'missing_order_id' ELSE 'repeated_order' END AS reason
FROM compra, range(2) veces(vez) WHERE (vez = 0 OR idcompra % 5 = 0) AND (idcompra % 5 = 0 OR idcompra % 7 = 0)""")
def _(s):
    return _repeated_updates(s)[2]


@query("price_details_rejects", f"""
SELECT idcompra AS iddetalle, CASE WHEN idcompra % 6 = 0 THEN 'unknown_order' ELSE 'unknown_product' END AS reason
FROM compra WHERE idcompra % 6 = 0 OR {UNKNOWN_PRODUCT}""")
def _(s):
    return pricing.price_details(s.compra_detalle.drop("total"), s.compra.where("idcompra % 6 <> 0"),
                                 s.producto.where(KNOWN_PRODUCTS))[1]


@query("invoice_rejects", """
SELECT idcompra, CASE WHEN idcompra % 4 = 0 THEN 'detail_missing' ELSE 'delivery_missing' END AS reason
FROM pedidos WHERE idcompra % 4 = 0 OR idcompra % 6 = 0 OR idcompra NOT IN (SELECT idcompra FROM detalle_entrega)""")
def _(s):
    return baskets.invoice_documents(s.compras, s.compras_detalle.where("idcompra % 4 <> 0"),
                                     s.detalle_entrega.where("idcompra % 6 <> 0"), s.producto)[1]


@query("basket_rejects", """
SELECT idcompra, CASE WHEN idcompra % 9 = 0 THEN 'basket_missing' ELSE 'basket_unreadable' END AS reason
FROM pedidos WHERE idcompra % 9 = 0 OR idcompra % 11 = 0""")
def _(s):
    spoilt = F.when(F.col("idcompra") % 9 == 0, F.lit(None)).when(F.col("idcompra") % 11 == 0, "[{oops").otherwise(F.col("productos"))
    return baskets.basket_rejects(s.compras.withColumn("productos", spoilt)).select("idcompra", "reason")


@query("final_price", f"SELECT idproducto, {dbl('p_final')} AS p_final FROM producto")
def _(s):
    return pricing.final_price(s.producto.drop("p_final")).select("idproducto", "p_final")


def _personal(chosen):
    return f"""
SELECT o.o_orderkey AS idcompra, CASE WHEN k.si THEN o_orderpriority END AS lado_frontal,
       CASE WHEN k.si THEN o_orderstatus END AS lado_trasero,
       CASE WHEN k.si THEN 'f' || o_orderkey || '.png' END AS foto, CASE WHEN k.si THEN '' END AS foto2
FROM orders o LEFT JOIN (
  SELECT idcompra, {chosen} AS si FROM lineas GROUP BY 1) k ON o.o_orderkey = k.idcompra"""


def _personal_requests(s):
    asked = s.source("orders").select(
        F.col("o_orderkey").alias("idcompra"),
        F.struct(F.col("o_orderpriority").alias("lado_frontal"), F.col("o_orderstatus").alias("lado_trasero"),
                 F.concat(F.lit("f"), F.col("o_orderkey"), F.lit(".png")).alias("foto"),
                 F.lit(None).cast("string").alias("foto2")).alias("detallePersonalizacion"))
    return s.compras.select("idcompra", "productos").join(asked, "idcompra")


@query("personalisation_rows", _personal("bool_or(tipo_personalizacion = 'personalizado')"))
def _(s):
    return pricing.personalisation_rows(_personal_requests(s))


@query("personalisation_rows_compat", _personal("arg_max(tipo_personalizacion, pos) = 'personalizado'"))
def _(s):
    return pricing.personalisation_rows(_personal_requests(s), compat=True)


PAYMENTS = f"""
SELECT c.order_id, c.iduser, coalesce(p.status, c.status) AS status, {dbl('coalesce(p.total, c.total)')} AS total,
       coalesce(CASE WHEN p.order_id IS NULL THEN c.currency ELSE p.currency END, 'USD') AS currency,
       CASE WHEN p.order_id IS NULL THEN 'Compra en Proceso' ELSE coalesce(p.description, 'Pago Finalizado') END
       AS description
FROM (SELECT * FROM pagos WHERE status = 'CREATED') c
     LEFT JOIN (SELECT * FROM pagos WHERE status = 'COMPLETED') p USING (order_id, iduser)"""


@query("payment_state", PAYMENTS)
def _(s):
    state, _ = pricing.payment_state(s.pagos)
    return state.drop("details")


@query("payment_state_rejects", """
SELECT p.order_id, p.iduser, CASE WHEN p.status <> 'COMPLETED' THEN 'not_completed' ELSE 'no_created_row' END AS reason
FROM pagos p LEFT JOIN (SELECT * FROM pagos WHERE status = 'CREATED') c USING (order_id, iduser)
WHERE p.status <> 'CREATED' AND (p.status <> 'COMPLETED' OR c.order_id IS NULL)""")
def _(s):
    _, rejects = pricing.payment_state(s.pagos)
    return rejects.select("order_id", "iduser", "reason")


def _repeated_payments(s):
    """The payment log with a second, dearer CREATED event for every fourth order and every tenth one's copied twice."""
    made, number = s.pagos.where("status = 'CREATED'"), F.substring("order_id", 4, 20).cast("long")
    later = made.where(number % 4 == 0).withColumns({"ts": F.col("ts") + F.expr("INTERVAL 2 MINUTES"), "total": (F.col("total") + 1).cast("decimal(14,2)")})
    copy = made.where(number % 10 == 0)
    return s.pagos.unionByName(later).unionByName(copy).unionByName(copy)


@query("payment_repeats", PAYMENTS)
def _(s):
    return pricing.payment_state(_repeated_payments(s))[0].drop("details")


@query("payment_repeats_rejects", f"""
SELECT p.order_id, p.iduser, CASE WHEN p.status <> 'COMPLETED' THEN 'not_completed' ELSE 'no_created_row' END AS reason,
       {dbl('p.total')} AS total
FROM pagos p LEFT JOIN (SELECT * FROM pagos WHERE status = 'CREATED') c USING (order_id, iduser)
WHERE p.status <> 'CREATED' AND (p.status <> 'COMPLETED' OR c.order_id IS NULL)
UNION ALL
SELECT order_id, iduser, 'already_created', {dbl('total')} + 1 FROM pagos
WHERE status = 'CREATED' AND CAST(substr(order_id, 4) AS BIGINT) % 4 = 0
UNION ALL
SELECT order_id, iduser, 'already_created', {dbl('total')} FROM pagos, range(2)
WHERE status = 'CREATED' AND CAST(substr(order_id, 4) AS BIGINT) % 10 = 0""")
def _(s):
    return pricing.payment_state(_repeated_payments(s))[1].select("order_id", "iduser", "reason", "total")


# ---- coupons ---------------------------------------------------------------------------------------

COUPON_COLUMNS = (f"c.idcupon, c.codigo, {dbl('c.porcentaje')} AS porcentaje, c.usos_maximos, c.usos_actuales, c.activo, "
                  f"{micros('c.fecha_expiracion')} AS fecha_expiracion")


@query("claimed_coupons", f"""
SELECT k.iduser, {COUPON_COLUMNS}, {micros('k.fecha_reclamacion')} AS fecha_reclamacion, {micros('x.fecha_uso')} AS fecha_uso
FROM cupones c JOIN user_cupones k ON c.idcupon = k.idcupon
     LEFT JOIN cupones_usados x ON c.idcupon = x.idcupon AND k.iduser = x.iduser
WHERE k.iduser IN (SELECT iduser FROM users)""")
def _(s):
    return coupons.claimed_coupons(s.cupones, s.user_cupones, s.cupones_usados, s.users.select("iduser"))


@query("checkout_coupons", f"""
SELECT {COUPON_COLUMNS} FROM cupones c
WHERE activo AND usos_maximos > 0 AND CAST(fecha_expiracion AS TIMESTAMP) >= TIMESTAMP '{AS_OF}'""")
def _(s):
    return coupons.checkout_coupons(s.cupones, AS_OF)


ELIGIBLE = f""", validas AS (
  SELECT r.idsolicitud, r.iduser, c.idcupon, r.codigo, r.ts, c.porcentaje, c.usos_maximos, c.usos_actuales
  FROM canjes r JOIN cupones c ON r.codigo = c.codigo
       JOIN user_cupones k ON k.idcupon = c.idcupon AND k.iduser = r.iduser
       LEFT JOIN cupones_usados x ON x.idcupon = c.idcupon AND x.iduser = r.iduser
  WHERE c.activo AND c.usos_maximos > c.usos_actuales AND x.idcupon IS NULL
        AND CAST(c.fecha_expiracion AS TIMESTAMP) >= TIMESTAMP '{AS_OF}')"""
ACCEPTED = f"""{ELIGIBLE}, primeras AS (
  SELECT *, row_number() OVER (PARTITION BY iduser, idcupon ORDER BY ts, idsolicitud) AS vez FROM validas),
aceptadas AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY idcupon ORDER BY ts, idsolicitud) AS puesto
                 FROM primeras WHERE vez = 1) WHERE puesto <= usos_maximos - usos_actuales)"""
ACCEPTED_ROWS = f"""{ACCEPTED}
SELECT idsolicitud, iduser, idcupon, codigo, {dbl('porcentaje')} AS porcentaje, {micros('ts')} AS ts FROM aceptadas"""


@query("eligible", f"""{ELIGIBLE}
SELECT idsolicitud, iduser, idcupon, codigo, {micros('ts')} AS ts, {dbl('porcentaje')} AS porcentaje, usos_maximos,
       usos_actuales FROM validas""")
def _(s):
    return coupons.eligible(s.canjes, s.cupones, s.user_cupones, s.cupones_usados, AS_OF)


def _redeemed(s):
    return coupons.redeem(s.canjes, s.cupones, s.user_cupones, s.cupones_usados, AS_OF)


@query("redeem", ACCEPTED_ROWS)
def _(s):
    return _redeemed(s)[0]


@query("redeem_uses", f"{ACCEPTED} SELECT iduser, idcupon, {micros('ts')} AS fecha_uso FROM aceptadas")
def _(s):
    return _redeemed(s)[1]


@query("redeem_counts", f"""{ACCEPTED}
SELECT idcupon, {big('max(usos_actuales) + count(*)')} AS usos_actuales FROM aceptadas GROUP BY 1""")
def _(s):
    return _redeemed(s)[2]


RULES_WITH_INACTIVE = RULES[:2] + [("SMALL", 60, "Brand#6")]


def _grant_sql(rules, columns):
    return f"""{PRICED}, reglas(clave, cantidad_requerida, codigo) AS (VALUES {', '.join(map(str, rules))}),
unidades AS (SELECT idcompra, iduser, clave, sum(cantidad) AS n FROM preciadas GROUP BY 1, 2, 3),
ganados AS (
  SELECT DISTINCT u.iduser, r.codigo FROM unidades u JOIN reglas r ON u.clave = r.clave AND u.n >= r.cantidad_requerida),
nuevos AS (
  SELECT g.* FROM ganados g
  WHERE NOT EXISTS (SELECT 1 FROM user_cupones k JOIN cupones c USING (idcupon)
                    WHERE k.iduser = g.iduser AND c.codigo = g.codigo)
    AND NOT EXISTS (SELECT 1 FROM cupones_usados x JOIN cupones c USING (idcupon)
                    WHERE x.iduser = g.iduser AND c.codigo = g.codigo))
SELECT {columns} FROM nuevos n LEFT JOIN cupones c ON n.codigo = c.codigo AND c.activo"""


def _grants(s, rules):
    return coupons.grant_coupons(_prices(s)[1], coupons.grant_rules(s.spark, rules), s.cupones, s.user_cupones,
                                 s.cupones_usados)


@query("grant_coupons", _grant_sql(RULES, "n.iduser, c.idcupon, n.codigo") + " WHERE c.codigo IS NOT NULL")
def _(s):
    return _grants(s, RULES)[0]


@query("grant_coupons_missing", _grant_sql(RULES_WITH_INACTIVE, "n.iduser, n.codigo") + " WHERE c.codigo IS NULL")
def _(s):
    return _grants(s, RULES_WITH_INACTIVE)[1]


@query("record_use", f"""
SELECT r.iduser, c.idcupon, {micros('r.ts')} AS fecha_uso FROM canjes r JOIN cupones c ON r.codigo = c.codigo""")
def _(s):
    return coupons.record_use(s.canjes, s.cupones)[0]


@query("welcome_coupons", """
SELECT u.iduser, c.idcupon FROM users u JOIN cupones c ON c.codigo = 'Brand#7' AND c.activo""")
def _(s):
    return coupons.welcome_coupons(s.users, s.cupones, "Brand#7")


# ---- counters, intake, change batches ----------------------------------------------------------------

@query("visit_counts", VISITS)
def _(s):
    return changes.visit_counts(s.visitas)


@query("visit_counts_from_text", VISITS)
def _(s):
    return changes.visit_counts_from_text(s.visitas.select(F.col("ts").cast("string").alias("fecha_visita")))


@query("merge_counts", f"""
SELECT strftime(d, {MONTH}) AS mes, count(*) AS numero_de_visitas
FROM (SELECT ts AS d FROM visitas UNION ALL SELECT created_at FROM users) GROUP BY 1""")
def _(s):
    registered = changes.visit_counts(s.users, "created_at")
    return changes.merge_counts(registered, changes.visit_counts(s.visitas))


@query("prepare_users", f"""
SELECT iduser, usuario AS "user", CASE WHEN sexo = 'otro' THEN 'uploads/default.jpg' ELSE foto END AS foto, 2 AS idrol
FROM users""")
def _(s):
    raw = s.users.select("iduser", "user", F.when(F.col("sexo") == "otro", "").otherwise(F.col("foto")).alias("foto"),
                         F.lit("secret").alias("password"))
    return changes.prepare_users(raw, changes.ADMINISTRATOR)


COMMENTS = """, nuevos AS (SELECT * FROM comentarios WHERE comentario = 'click'),
previos AS (SELECT DISTINCT idproducto, iduser FROM comentarios WHERE comentario = 'view'),
juicio AS (
  SELECT n.*, n.calificacion IS NOT NULL%s AS vale, p.iduser IS NOT NULL AS ya,
         row_number() OVER (PARTITION BY n.idproducto, n.iduser, n.calificacion IS NOT NULL%s
                            ORDER BY n.fecha, n.idcomentario) AS vez
  FROM nuevos n LEFT JOIN previos p ON n.idproducto = p.idproducto AND n.iduser = p.iduser)"""
COMMENT_OK = (f"SELECT idcomentario, idproducto, iduser, comentario, calificacion, {micros('fecha')} AS fecha FROM juicio "
              "WHERE vale AND NOT ya AND vez = 1")


def _comments(s, compat=False):
    new, old = (s.comentarios.where(F.col("comentario") == kind) for kind in ("click", "view"))
    return changes.ingest_comments(new, old, compat)


@query("ingest_comments", f"{COMMENTS % ('', '')} {COMMENT_OK}")
def _(s):
    return _comments(s)[0]


@query("ingest_comments_compat", f"{COMMENTS % (' OR true', ' OR true')} {COMMENT_OK}")
def _(s):
    return _comments(s, compat=True)[0]


@query("ingest_comments_rejects", f"""{COMMENTS % ('', '')}
SELECT idcomentario, CASE WHEN NOT vale THEN 'rating_out_of_range' WHEN ya THEN 'already_commented'
       ELSE 'repeated_in_batch' END AS reason
FROM juicio WHERE NOT vale OR ya OR vez > 1""")
def _(s):
    return _comments(s)[1].select("idcomentario", "reason")


REPLAY = """, ordenados AS (SELECT *, row_number() OVER (PARTITION BY idproducto ORDER BY seq) AS vez FROM cambios),
replay AS (
  SELECT DISTINCT c.idproducto, 0::BIGINT AS vez, p.idproducto IS NOT NULL AS hay, p.clave, p.nomprod,
         p.descuento::BIGINT AS descuento, NULL::BIGINT AS seq, NULL::VARCHAR AS reason
  FROM cambios c LEFT JOIN producto p ON c.idproducto = p.idproducto
  UNION ALL
  SELECT r.idproducto, o.vez, CASE o.op WHEN 'insert' THEN true WHEN 'delete' THEN false ELSE r.hay END,
         CASE WHEN o.op = 'insert' AND NOT r.hay THEN NULL ELSE r.clave END,
         CASE WHEN (o.op = 'insert' AND NOT r.hay) OR (o.op = 'update' AND r.hay) THEN o.nomprod ELSE r.nomprod END,
         CASE WHEN (o.op = 'insert' AND NOT r.hay) OR (o.op = 'update' AND r.hay) THEN o.descuento ELSE r.descuento END,
         o.seq, CASE WHEN o.op = 'insert' AND r.hay THEN 'key_exists' WHEN o.op <> 'insert' AND NOT r.hay THEN 'no_such_key' END
  FROM replay r JOIN ordenados o ON o.idproducto = r.idproducto AND o.vez = r.vez + 1)"""


@query("apply_changes", f"""{REPLAY}
SELECT idproducto, clave, nomprod, descuento::BIGINT AS descuento FROM producto WHERE idproducto NOT IN (SELECT idproducto FROM cambios)
UNION ALL
SELECT idproducto, clave, nomprod, descuento FROM replay
JOIN (SELECT idproducto, max(vez) AS vez FROM ordenados GROUP BY 1) USING (idproducto, vez) WHERE hay""")
def _(s):
    return changes.apply_changes(s.producto.select("idproducto", "clave", "nomprod", "descuento"), s.product_changes,
                                 "idproducto")[0]


@query("apply_changes_missing", f"""{REPLAY}
SELECT idproducto, seq, reason FROM replay WHERE reason IS NOT NULL""")
def _(s):
    return changes.apply_changes(s.producto.select("idproducto", "clave", "nomprod", "descuento"), s.product_changes,
                                 "idproducto")[1].select("idproducto", "seq", "reason")


@query("replace_role_permission", """
SELECT idrol, (SELECT max(n_nationkey) FROM nation WHERE n_regionkey = idrol) AS idpermiso FROM rolxpermiso""")
def _(s):
    wanted = s.rolxpermiso.groupBy("idrol").agg(F.max("idpermiso").alias("idpermiso")).withColumn("seq", F.lit(1))
    return changes.replace_role_permission(s.rolxpermiso, wanted)[0]


@query("delete_pairs", """
SELECT idrol, idpermiso FROM rolxpermiso
WHERE (idrol, idpermiso) NOT IN (SELECT (n_regionkey, max(n_nationkey)) FROM nation GROUP BY n_regionkey)""")
def _(s):
    pairs = s.rolxpermiso.groupBy("idrol").agg(F.max("idpermiso").alias("idpermiso"))
    return changes.delete_pairs(s.rolxpermiso, pairs)[0]


@query("replace_role_permission_missing", "SELECT DISTINCT idrol + 100 AS idrol FROM rolxpermiso")
def _(s):
    wanted = s.rolxpermiso.groupBy((F.col("idrol") + 100).alias("idrol")).agg(F.max("idpermiso").alias("idpermiso"))
    return changes.replace_role_permission(s.rolxpermiso, wanted.withColumn("seq", F.lit(1)))[1]


@query("delete_pairs_missing", "SELECT DISTINCT idrol, idpermiso + 1000 AS idpermiso FROM rolxpermiso")
def _(s):
    return changes.delete_pairs(s.rolxpermiso, s.rolxpermiso.withColumn("idpermiso", F.col("idpermiso") + 1000))[1]


@query("record_use_rejects", """
SELECT idsolicitud, iduser, codigo FROM canjes WHERE codigo NOT IN (SELECT codigo FROM cupones WHERE idcupon % 2 = 0)""")
def _(s):
    return coupons.record_use(s.canjes, s.cupones.where("idcupon % 2 = 0"))[1].select("idsolicitud", "iduser", "codigo")


@query("append_then_load", 'SELECT iduser, usuario AS "user", email, estado FROM users')
def _(s):
    """The users written in two parts and read back as a stored table."""
    work = tables.work_dir(s.spark)
    for part in ("iduser % 2 = 0", "iduser % 2 <> 0"):
        tables.append(s.users.where(part).select("iduser", "user", "email", "estado"), work, "users")
    return tables.load(s.spark, work, "users").select("iduser", "user", "email", "estado")


# ---- streams, run to the end of their input ------------------------------------------------------------

def _stored(df, path):
    """Write a source for a stream that takes it as one batch."""
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def _stored_in_two(df, path):
    """Write a source for a stream that takes two thirds of the rows as one batch, and then the others."""
    spark = df.sparkSession
    df.repartition(max(3, int(spark.conf.get("spark.sql.shuffle.partitions")))).write.parquet(path)
    files = sum(name.startswith("part-") for name in children(spark, path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", -(-2 * files // 3)).parquet(path)


@query("visits_stream", f"""
SELECT {day("date_trunc('day', ts)")} AS dia, count(*) AS numero_de_visitas FROM visitas
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM visitas) - INTERVAL 1 DAY GROUP BY 1""")
def _(s):
    work = tables.work_dir(s.spark)
    visits = _stored(s.visitas, f"{work}/visits")
    jobs.start_daily_visits(visits, f"{work}/days", f"{work}/state").awaitTermination()
    return s.spark.read.schema("dia DATE, numero_de_visitas BIGINT").parquet(f"{work}/days")


@query("visits_stream_monthly", f"""
SELECT strftime(ts, '%Y-%m') AS mes, count(*) AS numero_de_visitas FROM visitas
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM visitas) - INTERVAL 1 DAY GROUP BY 1""")
def _(s):
    work = tables.work_dir(s.spark)
    jobs.start_daily_visits(_stored(s.visitas, f"{work}/visits"), f"{work}/days", f"{work}/state").awaitTermination()
    return jobs.monthly_rollup(s.spark.read.schema("dia DATE, numero_de_visitas BIGINT").parquet(f"{work}/days"))


def _intake(s, rules=None):
    """Order requests as JSON files, taken in by the stream; gives the folder of its outputs."""
    work = tables.work_dir(s.spark)
    line = "ARRAY<STRUCT<idproducto: BIGINT, cantidad: INT, talla: STRING, tipo_personalizacion: STRING>>"
    with tables.shuffles_removed(s.spark):
        s.order_requests.withColumn("productos", F.from_json("productos", line)).write.json(f"{work}/in", compression="gzip")
    orders = tables.read_orders(s.spark, f"{work}/in", streaming=True)
    jobs.start_order_intake(orders, s.users, s.producto, s.cupones, AS_OF, f"{work}/out", f"{work}/state", rules,
                            s.user_cupones, s.cupones_usados).awaitTermination()
    return f"{work}/out"


@query("order_intake_stream", PRICED_ORDERS)
def _(s):
    return _priced_heads(s.spark.read.parquet(f"{_intake(s)}/orders"))


@query("order_intake_stream_rejects", f"{PRICED} SELECT idcompra, reason FROM juzgadas WHERE reason IS NOT NULL")
def _(s):
    return s.spark.read.parquet(f"{_intake(s)}/rejects").select("idcompra", "reason")


@query("order_intake_stream_details", f"""{PRICED}
SELECT idcompra AS iddetalle, idcompra, codigocupon AS "codigoCupon", {dbl('round(sum(total_producto), 2)')} AS total
FROM preciadas GROUP BY idcompra, codigocupon""")
def _(s):
    return s.spark.read.parquet(f"{_intake(s)}/details").select("iddetalle", "idcompra", "codigoCupon", "total")


@query("order_intake_stream_grants", _grant_sql(RULES, "n.iduser, c.idcupon, n.codigo") + " WHERE c.codigo IS NOT NULL")
def _(s):
    out = _intake(s, coupons.grant_rules(s.spark, RULES))
    return s.spark.read.parquet(f"{out}/grants").drop("query_id", "batch_id")


@query("comment_intake_stream", f"{COMMENTS % ('', '')} {COMMENT_OK}")
def _(s):
    work = tables.work_dir(s.spark)
    new, old = (s.comentarios.where(F.col("comentario") == kind) for kind in ("click", "view"))
    stream = _stored(new, f"{work}/in")
    jobs.start_comment_intake(stream, old, f"{work}/out", f"{work}/state").awaitTermination()
    return s.spark.read.parquet(f"{work}/out/comments").drop("query_id", "batch_id")


@query("redeem_stream", ACCEPTED_ROWS)
def _(s):
    work = tables.work_dir(s.spark)
    stream = _stored(s.canjes, f"{work}/in")
    jobs.start_redemption(stream, s.cupones, s.user_cupones, s.cupones_usados, AS_OF, f"{work}/out",
                          f"{work}/state").awaitTermination()
    return s.spark.read.parquet(f"{work}/out").drop("query_id", "batch_id")


@query("payment_stream", PAYMENTS)
def _(s):
    work = tables.work_dir(s.spark)
    stream = _stored_in_two(s.pagos, f"{work}/in")
    jobs.start_payment_log(stream, f"{work}/out", f"{work}/state").awaitTermination()
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in s.pagos.schema)
    return jobs.current_payments(s.spark, f"{work}/out", schema)[0].drop("details")


def _in_order(rows, column, path, start, parts=3):
    """Run a stream over the rows in order of a time: cut into parts, each of them a batch."""
    cuts = rows.agg(F.percentile_approx(F.unix_micros(F.col(column).cast("timestamp")), [i / parts for i in range(1, parts)]).alias("at")).first()["at"] or []
    place = sum((F.when(F.unix_micros(F.col(column).cast("timestamp")) > at, 1).otherwise(0) for at in cuts), F.lit(0))
    for i in range(parts):
        rows.where(place == i).write.mode("append").parquet(path)
        start(rows.sparkSession.readStream.schema(rows.schema).parquet(path)).awaitTermination()


@query("comment_intake_stream_batches", f"{COMMENTS % ('', '')} {COMMENT_OK}")
def _(s):
    work = tables.work_dir(s.spark)
    new, old = (s.comentarios.where(F.col("comentario") == kind) for kind in ("click", "view"))
    _in_order(new, "fecha", f"{work}/in", lambda stream: jobs.start_comment_intake(stream, old, f"{work}/out", f"{work}/state"))
    return s.spark.read.parquet(f"{work}/out/comments").drop("query_id", "batch_id")


@query("redeem_stream_batches", ACCEPTED_ROWS)
def _(s):
    work = tables.work_dir(s.spark)
    _in_order(s.canjes, "ts", f"{work}/in", lambda stream: jobs.start_redemption(
        stream, s.cupones, s.user_cupones, s.cupones_usados, AS_OF, f"{work}/out", f"{work}/state"))
    return s.spark.read.parquet(f"{work}/out").drop("query_id", "batch_id")


def _sent_again(s):
    """All order requests in one batch, and every third once more in a later one; gives the folder of the outputs."""
    work = tables.work_dir(s.spark)
    line = "ARRAY<STRUCT<idproducto: BIGINT, cantidad: INT, talla: STRING, tipo_personalizacion: STRING>>"
    asked = s.order_requests.withColumn("productos", F.from_json("productos", line))
    for sent in (asked, asked.where("idcompra % 3 = 0")):
        with tables.shuffles_removed(s.spark):
            sent.write.mode("append").json(f"{work}/in", compression="gzip")
        jobs.start_order_intake(tables.read_orders(s.spark, f"{work}/in", streaming=True), s.users, s.producto, s.cupones, AS_OF,
                                f"{work}/out", f"{work}/state").awaitTermination()
    return f"{work}/out"


@query("order_intake_sent_again", PRICED_ORDERS)
def _(s):
    out = _sent_again(s)
    schema = s.spark.read.parquet(f"{out}/orders").drop("query_id", "batch_id").schema
    stored = tables.committed(s.spark, out, "orders", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema))
    return _priced_heads(stored)


@query("order_intake_sent_again_rejects", f"""{PRICED}
SELECT idcompra, coalesce(reason, 'repeated_order') AS reason FROM juzgadas, range(2) veces(vez)
WHERE (vez = 0 AND reason IS NOT NULL) OR (vez = 1 AND idcompra % 3 = 0)""")
def _(s):
    return tables.committed(s.spark, _sent_again(s), "rejects", "idcompra BIGINT, reason STRING")


# ---- tables in buckets, visits that come late -------------------------------------------------------------

def _in_buckets(s):
    """The products stored in buckets, with the changes applied; and the changes that matched nothing."""
    goods = s.producto.select("idproducto", "clave", "nomprod", "descuento")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in goods.schema)
    table = keyed.KeyedTable(s.spark, tables.work_dir(s.spark), schema, "idproducto", buckets=16)
    table.replace(goods)
    return table, table.apply(s.product_changes)


@query("apply_changes_in_buckets", f"""{REPLAY}
SELECT idproducto, clave, nomprod, descuento::BIGINT AS descuento FROM producto WHERE idproducto NOT IN (SELECT idproducto FROM cambios)
UNION ALL
SELECT idproducto, clave, nomprod, descuento FROM replay
JOIN (SELECT idproducto, max(vez) AS vez FROM ordenados GROUP BY 1) USING (idproducto, vez) WHERE hay""")
def _(s):
    return _in_buckets(s)[0].read()


@query("apply_changes_in_buckets_missing", f"""{REPLAY}
SELECT idproducto, seq, reason FROM replay WHERE reason IS NOT NULL""")
def _(s):
    return _in_buckets(s)[1].select("idproducto", "seq", "reason")


@query("lookup_in_buckets", "SELECT idproducto, clave FROM producto WHERE idproducto IN (SELECT idproducto FROM compra WHERE idcompra % 50 = 0)")
def _(s):
    goods = s.producto.select("idproducto", "clave")
    table = keyed.KeyedTable(s.spark, tables.work_dir(s.spark), "idproducto BIGINT, clave STRING", "idproducto", buckets=16)
    table.replace(goods)
    return table.lookup(s.compra.where("idcompra % 50 = 0").select("idproducto"))


@query("visits_stream_all", VISITS)
def _(s):
    """Every visit counts, those of days long past too: the days come in descending order."""
    work = tables.work_dir(s.spark)
    visits = s.visitas.withColumn("_back", F.timestamp_seconds(-F.unix_seconds(F.col("ts").cast("timestamp"))))
    _in_order(visits, "_back", f"{work}/in", lambda stream: jobs.start_every_visit(stream, f"{work}/days", f"{work}/state"))
    return jobs.monthly_rollup(jobs.days_of_every_visit(s.spark, f"{work}/days"))


@query("search_many", f"""
SELECT texto, count(*) AS productos, {big('sum(idproducto)')} AS suma_ids
FROM producto p JOIN (SELECT DISTINCT upper(substr(nomprod, CAST(1 + idproducto % 7 AS BIGINT), CAST(1 + idproducto % 6 AS BIGINT))) AS texto
  FROM producto) t ON contains(lower(p.nomprod), lower(t.texto)) GROUP BY texto""")
def _(s):
    """Pieces of one to six letters of all names, searched in all names."""
    key = F.col("idproducto")
    pieces = s.producto.select(F.upper(F.substring("nomprod", 1 + key % 7, 1 + key % 6)).alias("texto"))
    return search.search_many(s.producto.select("idproducto", "nomprod"), pieces).groupBy("texto").agg(
        F.count("*").alias("productos"), F.sum("idproducto").alias("suma_ids"))


# ---- baskets parsed once and stored as VARIANT -------------------------------------------------------

def _with_variants(s, spoilt: bool = False):
    """The same shop with its orders stored as VARIANT baskets; spoilt, some of them missing or no JSON."""
    path, orders = tables.work_dir(s.spark), s.compras
    if spoilt:
        orders = orders.withColumn("productos", F.when(F.col("idcompra") % 9 == 0, F.lit(None)).when(
            F.col("idcompra") % 11 == 0, "[{oops").otherwise(F.col("productos")))
    as_variant(orders).write.parquet(path)
    stored = Shop(s.spark, s.directory)
    stored.compras = s.spark.read.parquet(path)
    return stored


def _on_variants(name: str) -> None:
    asked = QUERIES[name]
    query(f"{name}_variant", asked.sql)(lambda s: asked.run(_with_variants(s)))


for _name in ("explode_lines", "total_units", "units_by_seller", "units_by_seller_compat", "units_by_product",
              "units_by_product_month_compat", "top_products", "top_buyers", "orders_with_line_personalised",
              "orders_containing", "enrich_orders", "invoice_documents"):
    _on_variants(_name)


@query("basket_rejects_variant", QUERIES["basket_rejects"].sql)
def _(s):
    return baskets.basket_rejects(_with_variants(s, spoilt=True).compras).select("idcompra", "reason")
