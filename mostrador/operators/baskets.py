"""Reports and documents over orders whose basket is a JSON array of lines.

The reports follow their names. With ``compat=True`` they give the numbers of the shop's own
queries, which look at a fixed number of leading lines and credit them more freely; each function
says how. Product ids and quantities are read as numbers whether quoted or not, except where
compat needs the JSON type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mostrador.functions.lines import (
    LINE_FIELDS, basket_problem, basket_rejects, elements, explode_lines, is_variant, lines_of, quantity, sum_quantities)
from mostrador.functions.scalars import month_start, month_text
from mostrador.operators.lookups import lookup

SELLER_LINES, PRODUCT_LINES, BUYER_LINES = 10, 3, 5


def total_units(orders: DataFrame) -> DataFrame:
    """Units over all lines of all orders, as one row."""
    lines = explode_lines(orders, ("cantidad",), keep=[])
    return lines.agg(F.sum("cantidad").alias("total_productos_comprados"))


def _units(orders: DataFrame, *keys: Column) -> DataFrame:
    """Units per product (and further order keys), summed before any join."""
    keyed = orders.select("productos", *keys)
    names = [c for c in keyed.columns if c != "productos"]
    lines = explode_lines(keyed, ("idproducto", "cantidad"), keep=names)
    return lines.groupBy("idproducto", *names).agg(F.sum("cantidad").alias("unidades"))


def _units_of_containing_orders(orders: DataFrame) -> DataFrame:
    """Per product: the first ten quantities of every order that contains it, whatever they belong to.

    Containment compares JSON types, so a quoted product id does not count. The distinct ids come from
    within the row, which needs no shuffle and no (order, product) pairs beyond the lines themselves.
    """
    if is_variant(orders):
        number = lambda e: F.when(F.schema_of_variant(e) == "BIGINT", F.try_variant_get(e, "$", "bigint"))
        lines = F.transform(elements(F.col("productos")), lambda e: F.struct(
            number(F.try_variant_get(e, "$.idproducto", "variant")).alias("idproducto"),
            F.try_variant_get(e, "$.cantidad", "string").alias("cantidad")))
    else:
        lines = F.from_json("productos", "ARRAY<STRUCT<idproducto: BIGINT, cantidad: STRING>>")
    parsed = orders.select(lines.alias("_lines"))
    first = F.filter(F.slice("_lines", 1, SELLER_LINES), lambda line: quantity(line).isNotNull())
    units = F.when(F.size(first) > 0, sum_quantities(first))
    ids = F.array_distinct(F.transform("_lines", lambda line: line["idproducto"]))
    pairs = parsed.select(units.alias("_units"), F.explode_outer(ids).alias("idproducto"))
    return (pairs.where("idproducto IS NOT NULL").groupBy("idproducto")
            .agg(F.sum("_units").alias("unidades")))


def units_by_seller(orders: DataFrame, producto: DataFrame, users: DataFrame, compat: bool = False) -> DataFrame:
    """Units sold per seller name.

    ``compat``: for each product of the seller, the first ten lines of every order containing it.
    """
    sold = _units_of_containing_orders(orders) if compat else _units(orders)
    per_seller = (sold.join(producto.select("idproducto", "iduser"), "idproducto")
                  .groupBy("iduser").agg(F.sum("unidades").alias("unidades")))
    return (per_seller.join(users.select("iduser", F.col("user").alias("nombre_usuario")), "iduser")
            .groupBy("nombre_usuario").agg(F.sum("unidades").alias("total_productos_vendidos"))
            .orderBy(F.desc("total_productos_vendidos"), "nombre_usuario"))


def units_by_product(orders: DataFrame, producto: DataFrame, clave: str = "PER", compat: bool = False) -> DataFrame:
    """Units sold per product name of one category; ``compat`` as in :func:`units_by_seller`."""
    sold = _units_of_containing_orders(orders) if compat else _units(orders)
    names = producto.where(F.col("clave") == clave).select("idproducto", F.col("nomprod").alias("nombre_producto"))
    return (sold.join(names, "idproducto")
            .groupBy("nombre_producto").agg(F.sum("unidades").alias("total_cantidad_comprada"))
            .orderBy(F.desc("total_cantidad_comprada"), "nombre_producto"))


def _units_by_first_line(orders: DataFrame, guard_first: bool, *keys: Column) -> DataFrame:
    """Lines 0 to 2 credited to the product of line 0.

    A missing quantity counts 0, and so does an explicit JSON null or text that is no number. Without
    ``guard_first``, a first line that has no quantity at all voids the order.
    """
    if is_variant(orders):
        lines = F.transform(elements(F.col("productos")), lambda e: F.try_variant_get(e, "$", "MAP<STRING, STRING>"))
    else:
        lines = F.from_json("productos", "ARRAY<MAP<STRING, STRING>>")
    parsed = orders.select(lines.alias("_lines"), *keys)
    names = [c for c in parsed.columns if c != "_lines"]

    def units(i):
        line = F.get("_lines", F.lit(i))
        number = F.coalesce(F.element_at(line, "cantidad").try_cast("double"), F.lit(0.0))
        if i > 0 or guard_first:
            return number
        return F.when(F.map_contains_key(line, "cantidad"), number)

    total = units(0)
    for i in range(1, PRODUCT_LINES):
        total = total + units(i)
    # The first line becomes a row of its own: a test on its product then stays above the parsing.
    rows = parsed.select(total.alias("_units"), *names, F.explode_outer(F.slice("_lines", 1, 1)).alias("_first"))
    product = F.element_at("_first", "idproducto").try_cast("bigint")
    return (rows.groupBy(product.alias("idproducto"), *names).agg(F.sum("_units").alias("unidades"))
            .where("idproducto IS NOT NULL"))


def units_by_product_month(orders: DataFrame, producto: DataFrame, compat: bool = False) -> DataFrame:
    """Units per product name and month.

    ``compat``: the quantities of the first three lines go to the product of the first line.
    """
    month = month_start("fecha").alias("_month")
    sold = _units_by_first_line(orders, True, month) if compat else _units(orders, month)
    return (sold.join(producto.select("idproducto", F.col("nomprod").alias("producto")), "idproducto")
            .groupBy("producto", "_month")
            .agg(F.coalesce(F.sum("unidades"), F.lit(0.0)).alias("total_comprado"))
            .select("producto", month_text(F.col("_month")).alias("mes"), "total_comprado")
            .orderBy("mes", "producto"))


def top_products(orders: DataFrame, producto: DataFrame, n: int = 5, compat: bool = False) -> DataFrame:
    """Products with most units.

    ``compat``: as in :func:`units_by_product_month`, and an order whose first line has no quantity adds nothing.
    """
    sold = _units_by_first_line(orders, False) if compat else _units(orders)
    names = producto.select("idproducto", F.col("nomprod").alias("nombre_producto"), "foto")
    return (sold.join(names, "idproducto")
            .select("idproducto", "nombre_producto", "foto", F.col("unidades").alias("total_comprado"))
            .orderBy(F.desc("total_comprado"), "idproducto").limit(n))


def top_buyers(orders: DataFrame, users: DataFrame, n: int = 6, compat: bool = False) -> DataFrame:
    """Users who bought most units; ``compat`` counts whole units of the first five lines only."""
    lines = lines_of(orders, ("cantidad",))
    if compat:
        def whole_units(total, line):
            units = F.coalesce(quantity(line).try_cast("bigint"), F.lit(0))
            return total + F.greatest(units, F.lit(0))
        units = F.aggregate(F.slice(lines, 1, BUYER_LINES), F.lit(0).cast("bigint"), whole_units)
        units = F.coalesce(units, F.lit(0)).cast("double")
    else:
        units = F.coalesce(sum_quantities(lines), F.lit(0.0))
    bought = orders.groupBy("iduser").agg(F.sum(units).alias("cantidad_compras"))
    return (bought.join(users.select("iduser", F.col("user").alias("nombre_usuario"),
                                     F.col("foto").alias("foto_usuario")), "iduser")
            .select("nombre_usuario", "foto_usuario", "iduser", "cantidad_compras")
            .orderBy(F.desc("cantidad_compras"), "iduser").limit(n))


def orders_with_line(orders: DataFrame, field: str, value: str) -> DataFrame:
    """Orders having at least one line whose ``field`` equals ``value``."""
    lines = lines_of(orders, (field,))
    return orders.where(F.exists(lines, lambda line: line[field] == value))


def orders_containing(orders: DataFrame, products: DataFrame) -> DataFrame:
    """(order, product) for every listed product an order contains, once however often it is in the basket."""
    ids = F.transform(lines_of(orders, ("idproducto",)), lambda line: line["idproducto"].try_cast("bigint"))
    held = orders.select("idcompra", F.explode_outer(F.array_distinct(ids)).alias("idproducto"))
    return lookup(held, products, "idproducto").select("idcompra", "idproducto")


def pack_lines(lines: DataFrame, key: str = "idcompra") -> DataFrame:
    """Lines to one JSON array per order, in ``pos`` order."""
    fields = [c for c in lines.columns if c not in (key, "pos")]
    packed = F.sort_array(F.collect_list(F.struct("pos", F.struct(*fields).alias("line"))))
    return lines.groupBy(key).agg(F.to_json(F.transform(packed, lambda e: e["line"])).alias("productos"))


def enrich_lines(orders: DataFrame, producto: DataFrame, key: str | None = None) -> DataFrame:
    """Baskets with every product id replaced by the product's name, NULL when unknown.

    Works on orders and on order details alike: all other columns stay. Rows must be distinct in ``key``, by which
    alone they are then gathered, or without it in all other columns. Unreadable baskets are left to
    ``basket_rejects``.
    """
    keep = [c for c in orders.columns if c != "productos"]
    rows = explode_lines(orders, LINE_FIELDS, keep, outer=True)
    line = F.struct("pos", F.struct(
        F.col("nomprod").alias("idproducto"),
        *[F.col(name) for name in LINE_FIELDS if name != "idproducto"]).alias("line"))
    collected = F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), line)))
    carried = [F.any_value(c).alias(c) for c in keep if key and c != key]
    return (rows.join(producto.select("idproducto", "nomprod"), "idproducto", "left").groupBy(*([key] if key else keep))
            .agg(*carried, F.transform(collected, lambda e: e["line"]).alias("productos"),
                 F.bool_and("readable").alias("_readable"))
            .where("_readable").select(*keep, "productos"))


def enrich_orders(orders: DataFrame, users: DataFrame, producto: DataFrame) -> DataFrame:
    """All orders with the buyer's e-mail and named lines; orders of unknown users do not appear."""
    buyers = users.select("iduser", F.col("email").alias("usuario"))
    named = enrich_lines(orders.select("idcompra", "iduser", "productos", "total", "fecha"), producto, "idcompra")
    return named.join(buyers, "iduser").select("idcompra", "usuario", "productos", "total", "fecha")


def _first_row(df: DataFrame, key: str, order: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), F.col(order)).alias(name))


def invoice_documents(orders: DataFrame, details: DataFrame, delivery: DataFrame,
                      producto: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Order, first detail, first delivery and named lines as one nested row; orders lacking a part go to rejects.

    Orders are distinct in idcompra. Only the lines are exploded, named and gathered; the parts, with their baskets, wait by
    idcompra and meet them once.
    """
    detail = _first_row(details, "idcompra", "iddetalle", "comprasDetalle")
    address = _first_row(delivery, "idcompra", "identrega", "detalleEntrega")
    parts = orders.join(detail, "idcompra", "left").join(address, "idcompra", "left")
    whole = parts.where("comprasDetalle IS NOT NULL AND detalleEntrega IS NOT NULL").groupBy("idcompra").agg(
        F.any_value(F.struct(*[F.col(c) for c in orders.columns])).alias("compra"),
        *[F.any_value(c).alias(c) for c in ("comprasDetalle", "detalleEntrega")])
    named = enrich_lines(orders.where("idcompra IS NOT NULL").select("idcompra", "productos"), producto, "idcompra")
    documents = whole.join(named, "idcompra")
    reason = (F.when(F.col("comprasDetalle").isNull(), "detail_missing")
              .when(F.col("detalleEntrega").isNull(), "delivery_missing").otherwise(basket_problem(parts)))
    return documents, parts.withColumn("reason", reason).where("reason IS NOT NULL").select("idcompra", "reason")


__all__ = [
    "basket_rejects", "enrich_lines", "enrich_orders", "invoice_documents", "orders_containing",
    "orders_with_line", "pack_lines", "top_buyers", "top_products", "total_units", "units_by_product",
    "units_by_product_month", "units_by_seller",
]
