"""Pricing of order requests, in DECIMAL, with every refused order reported and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from mostrador.functions.lines import explode_lines, lines_of
from mostrador.functions.scalars import exact_decimal, is_set
from mostrador.operators.coupons import checkout_coupons

REQUEST_FIELDS = ("idproducto", "cantidad", "talla", "tipo_personalizacion")
QUANTITY = "decimal(12,3)"
LINE_MONEY = "decimal(20,6)"
ORDER_MONEY = "decimal(16,2)"
#: Into how many places rows are dealt beside their keys.
PLACES = 1024


def final_price(products: DataFrame) -> DataFrame:
    """Set ``p_final`` from list price and discount percentage; no discount counts as 0."""
    off = F.coalesce(F.col("descuento"), F.lit(0)).cast("decimal(5,2)")
    price = F.col("p_producto").cast("decimal(12,2)") * (F.lit(100).cast("decimal(5,2)") - off)
    return products.withColumn("p_final", (price * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(14,4)"))


def _place(*columns) -> Column:
    """A small number that goes along with a key. Rows without a key get theirs of what else they hold, so that they spread."""
    return F.pmod(F.xxhash64(*columns), F.lit(PLACES)).cast("smallint")


def _repeated(orders: DataFrame, key: str) -> DataFrame:
    """Keys that more than one row has. Only keys are shuffled, one per task and value."""
    counts = orders.where(F.col(key).isNotNull()).groupBy(_place(key).alias("_place"), key).agg(F.count("*").alias("_rows"))
    return counts.where("_rows > 1").select("_place", key, F.lit(True).alias("_repeated"))


def refused_keys(orders: DataFrame, key: str = "idcompra", taken: DataFrame | None = None) -> DataFrame:
    """The keys that more than one row has, and those of the rows that were ``taken`` before."""
    repeated = _repeated(orders, key)
    if taken is None:
        return repeated
    return repeated.unionByName(taken.select(_place(key).alias("_place"), key, F.lit(True).alias("_repeated"))).distinct()


def _baskets(orders: DataFrame, products: DataFrame, key: str) -> DataFrame:
    """One row per order with its lines at list conditions, their sum, and what is wrong with them.

    Products are joined line by line (adaptive execution splits a hot product) and the lines are gathered
    once, by the key, which must be unique. Prices have four decimals and quantities three, so line money is
    exact; a quantity that does not fit is refused, not rounded.
    """
    lines = (explode_lines(orders, REQUEST_FIELDS, [key], outer=True)
             .withColumn("cantidad", exact_decimal(F.col("cantidad"), QUANTITY)))
    prices = products.select("idproducto", F.col("p_final").cast("decimal(14,4)").alias("_price"), "clave",
                             F.lit(True).alias("_known"))
    money = (F.col("_price") * F.col("cantidad")).try_cast("decimal(22,7)")
    priced = lines.join(prices, "idproducto", "left").withColumn("total_producto", money)
    line = F.struct("pos", "idproducto", "cantidad", "talla", "tipo_personalizacion", "total_producto", "clave")
    is_line = F.col("pos").isNotNull()
    # Collecting shrinks nothing before the shuffle, so the lines are spread by order first.
    per_order = priced.withColumn("_place", _place(key)).repartition("_place", key).groupBy("_place", key).agg(
        F.sum("total_producto").alias("_sum"),
        F.bool_or("missing").alias("_missing"), F.bool_and("readable").alias("_readable"),
        F.count("pos").alias("_n"),
        F.bool_or(is_line & F.col("_known").isNull()).alias("_unknown"),
        F.bool_or(is_line & F.col("total_producto").isNull()).alias("_unpriced"),
        F.sort_array(F.collect_list(F.when(is_line, line))).alias("lineas"))
    problem = (F.when(F.col("_missing"), "basket_missing").when(~F.col("_readable"), "basket_unreadable")
               .when(F.col("_n") == 0, "empty_basket").when(F.col("_unknown"), "unknown_product")
               .when(F.col("_unpriced"), "bad_quantity"))
    return per_order.select("_place", key, "_sum", "lineas", problem.alias("_problem"))


def _checked(orders: DataFrame, headers: DataFrame, products: DataFrame, header_problem, key: str = "idcompra",
             refused: DataFrame | None = None) -> DataFrame:
    """Headers with their priced lines, and ``reason`` set on the orders to refuse.

    ``_percent`` on the headers is the discount. It is the same for a whole order, so it is applied after
    the lines are gathered and the lines never have to meet users or coupons. Rows without a key, and all rows
    that share one or have one of the keys ``refused`` (:func:`refused_keys`), are refused before their baskets are opened,
    so no two baskets ever mix.
    """
    repeated = refused_keys(orders, key) if refused is None else refused
    at = ["_place", key]
    single = orders.select(_place(key).alias("_place"), key, "productos").where(F.col(key).isNotNull()).join(repeated, at, "left_anti")
    others = [f.name for f in headers.schema if f.name != key and isinstance(f.dataType, T.AtomicType)]
    factor = ((F.lit(100) - F.col("_percent")) * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(5,4)")
    discounted = F.transform("lineas", lambda line: line.withField(
        "total_producto", (line["total_producto"] * F.col("_factor")).cast(LINE_MONEY)))
    key_problem = F.when(F.col(key).isNull(), "missing_order_id").when(F.col("_repeated"), "repeated_order")
    return (headers.withColumn("_factor", factor).withColumn("_header_problem", header_problem)
            .withColumn("_place", F.when(F.col(key).isNull(), _place(*others)).otherwise(_place(key)))
            .join(repeated, at, "left").join(_baskets(single.drop("_place"), products, key), at, "left")
            .withColumn("total", (F.col("_sum") * F.col("_factor")).try_cast(ORDER_MONEY))
            .withColumn("lineas", discounted)
            .withColumn("reason", F.coalesce(
                key_problem, "_header_problem", "_problem", F.when(F.col("total").isNull(), "bad_quantity")))
            .drop("_sum", "_factor", "_percent", "_problem", "_header_problem", "_repeated", "_place"))


def checked_orders(orders: DataFrame, users: DataFrame, products: DataFrame, coupons: DataFrame, as_of,
                   refused: DataFrame | None = None) -> DataFrame:
    """All orders with priced lines and, where the order must be refused, the ``reason``.

    The parts that :func:`price_orders` returns are read off this one DataFrame; a job that writes all
    of them can store it first. One that prices the orders slice by slice gives the :func:`refused_keys` of all of them.
    """
    valid = (checkout_coupons(coupons, as_of).groupBy(F.col("codigo").alias("codigoCupon"))
             .agg(F.min_by(F.struct("porcentaje"), "idcupon").alias("_coupon")))
    buyers = users.select("iduser", F.lit(True).alias("_buyer"))
    percent = F.greatest(F.coalesce(F.col("_coupon.porcentaje"), F.lit(0)), F.lit(0)).cast("decimal(5,2)")
    headers = (orders.drop("productos", "total").join(buyers, "iduser", "left").join(valid, "codigoCupon", "left")
               .withColumn("_percent", percent))
    problem = (F.when(F.col("_buyer").isNull(), "unknown_user")
               .when(is_set(F.col("codigoCupon")) & F.col("_coupon").isNull(), "invalid_coupon"))
    return _checked(orders, headers, products, problem, refused=refused).drop("_buyer", "_coupon")


def accepted_parts(checked: DataFrame, key: str = "idcompra") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Split checked orders into order rows with their JSON basket, line rows, and refused orders."""
    good = checked.where("reason IS NULL")
    basket = F.to_json(F.transform("lineas", lambda line: line.dropFields("pos")))
    keys = list(dict.fromkeys(c for c in (key, "idcompra") if c in checked.columns))
    head = keys + [c for c in ("iduser", "fecha", "codigoCupon") if c in checked.columns]
    owner = keys + [c for c in ("iduser",) if c in checked.columns]
    orders = good.select(*head, "total", basket.alias("productos"))
    lines = good.select(*owner, F.explode("lineas").alias("_l")).select(*owner, "_l.*")
    return orders, lines, checked.where("reason IS NOT NULL").select(*keys, "reason")


def price_orders(orders: DataFrame, users: DataFrame, products: DataFrame, coupons: DataFrame,
                 as_of) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Price basket orders (idcompra, iduser, fecha, codigoCupon, productos) as (orders, lines, rejects).

    A line costs price x quantity less the coupon's percentage; the order total is rounded once. An order
    is refused whole when its user, coupon or any product is unknown, its basket cannot be priced, it has no
    idcompra, or another request has the same one. Each request is either accepted or listed as refused.
    """
    return accepted_parts(checked_orders(orders, users, products, coupons, as_of))


def reprice_orders(orders: DataFrame, products: DataFrame, users: DataFrame | None = None,
                   key: str = "idcompra") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Price existing orders, or their details by ``key`` iddetalle, again; without coupon.

    Every row is priced by itself and comes back under its key. Users are checked when given.
    """
    headers = orders.drop("productos", "total").withColumn("_percent", F.lit(0).cast("decimal(5,2)"))
    problem = F.lit(None).cast("string")
    if users is not None:
        headers = headers.join(users.select("iduser", F.lit(True).alias("_buyer")), "iduser", "left")
        problem = F.when(F.col("_buyer").isNull(), "unknown_user")
    return accepted_parts(_checked(orders, headers, products, problem, key), key)


def _flat_total():
    return (F.col("_price") * exact_decimal(F.col("cantidad"), QUANTITY)).try_cast(ORDER_MONEY)


def price_flat_orders(requests: DataFrame, users: DataFrame, products: DataFrame,
                      existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Price one-product orders (idcompra, fecha, iduser, idproducto, cantidad) as (orders, details, rejects).

    With ``existing`` orders the requests are updates of these, and others are refused; so are updates without an
    id and all that share one, as nothing says which of them counts.
    """
    prices = products.select("idproducto", F.col("p_final").cast("decimal(14,4)").alias("_price"),
                             F.lit(True).alias("_known"))
    if existing is None:
        requests = requests.withColumns({"_order": F.lit(True), "_key_problem": F.lit(None).cast("string")})
    else:
        known = existing.select("idcompra").distinct().withColumn("_order", F.lit(True))
        key_problem = F.when(F.col("idcompra").isNull(), "missing_order_id").when(F.col("_repeated"), "repeated_order")
        requests = (requests.join(known, "idcompra", "left").join(_repeated(requests, "idcompra").drop("_place"), "idcompra", "left")
                    .withColumn("_key_problem", key_problem).drop("_repeated"))
    checked = (requests.join(users.select("iduser", F.lit(True).alias("_buyer")), "iduser", "left")
               .join(prices, "idproducto", "left")
               .withColumn("total", _flat_total())
               .withColumn("reason", F.when(F.col("_key_problem").isNotNull(), F.col("_key_problem"))
                           .when(F.col("_order").isNull(), "unknown_order").when(F.col("_buyer").isNull(), "unknown_user")
                           .when(F.col("_known").isNull(), "unknown_product")
                           .when(F.col("total").isNull(), "bad_quantity")))
    good = checked.where("reason IS NULL")
    return (good.select("idcompra", "total", "fecha", "iduser", "idproducto", "cantidad"),
            good.select("idcompra", "idproducto", "cantidad", "total"),
            checked.where("reason IS NOT NULL").select("idcompra", "reason"))


def price_details(requests: DataFrame, compra: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Price detail rows (iddetalle, idcompra, idproducto, cantidad) of existing orders as (details, rejects)."""
    prices = products.select("idproducto", F.col("p_final").cast("decimal(14,4)").alias("_price"),
                             F.lit(True).alias("_known"))
    parents = compra.select("idcompra", F.lit(True).alias("_order"))
    checked = (requests.join(parents, "idcompra", "left").join(prices, "idproducto", "left")
               .withColumn("total", _flat_total())
               .withColumn("reason", F.when(F.col("_order").isNull(), "unknown_order")
                           .when(F.col("_known").isNull(), "unknown_product")
                           .when(F.col("total").isNull(), "bad_quantity")))
    return (checked.where("reason IS NULL").select("iddetalle", "idcompra", "idproducto", "cantidad", "total"),
            checked.where("reason IS NOT NULL").select("iddetalle", "reason"))


def validate_products(lines: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of orders whose products all exist and appear once, and the other orders with the reason."""
    known = products.select("idproducto", F.lit(1).alias("_known"))
    per_order = (lines.groupBy("idcompra", "idproducto").agg(F.count("*").alias("_n"))
                 .join(known, "idproducto", "left").groupBy("idcompra")
                 .agg(F.max("_n").alias("_n"), F.bool_or(F.col("_known").isNull()).alias("_unknown")))
    rejects = per_order.select("idcompra", F.when(F.col("_unknown"), "unknown_product")
                               .when(F.col("_n") > 1, "repeated_product").alias("reason")).where("reason IS NOT NULL")
    return lines.join(rejects, "idcompra", "left_anti"), rejects


def personalisation_rows(orders: DataFrame, compat: bool = False) -> DataFrame:
    """One personalisation row per order: its texts and photos if personalised, else NULLs.

    An order is personalised when any line is; ``compat`` looks at the last line only.
    """
    lines = lines_of(orders, ("tipo_personalizacion",))
    if compat:
        personal = F.try_element_at(lines, F.lit(-1))["tipo_personalizacion"] == "personalizado"
    else:
        personal = F.exists(lines, lambda line: line["tipo_personalizacion"] == "personalizado")
    asked = F.col("detallePersonalizacion")
    judged = orders.select("idcompra", "detallePersonalizacion", personal.alias("_personal"))
    personal = F.col("_personal")
    return judged.select(
        "idcompra",
        *[F.when(personal, asked[name]).alias(name) for name in ("lado_frontal", "lado_trasero")],
        *[F.when(personal, F.coalesce(asked[name], F.lit(""))).alias(name) for name in ("foto", "foto2")])


def delivery_rows(orders: DataFrame) -> DataFrame:
    """One delivery row per order request."""
    return orders.select("idcompra", "detalleEntrega.*")


PAYMENT_KEY, PAYMENT_FIELDS = ["order_id", "iduser"], ("status", "total", "currency", "description", "details")


def _entry():
    return F.struct("ts", *PAYMENT_FIELDS)


def payment_marks(events: DataFrame) -> DataFrame:
    """Per (order_id, iduser) the first CREATED entry and the last COMPLETED one of some events.

    Marks of parts of a log can be merged (:func:`merge_marks`), so the state need not be derived from the whole log.
    """
    created, completed = F.col("status") == "CREATED", F.col("status") == "COMPLETED"
    return events.where("ts IS NOT NULL").where(created | completed).groupBy(*PAYMENT_KEY).agg(
        F.min(F.when(created, _entry())).alias("_made"), F.max(F.when(completed, _entry())).alias("_paid"))


def merge_marks(marks: DataFrame) -> DataFrame:
    return marks.groupBy(*PAYMENT_KEY).agg(F.min("_made").alias("_made"), F.max("_paid").alias("_paid"))


def marks_state(marks: DataFrame) -> DataFrame:
    """The current row of each (order_id, iduser) with a CREATED entry."""
    paid = F.coalesce(F.col("_paid.ts") >= F.col("_made.ts"), F.lit(False))

    def value(name):
        return F.when(paid, F.col(f"_paid.{name}")).otherwise(F.col(f"_made.{name}"))

    def default(name, text):
        return F.when(is_set(value(name)), value(name)).otherwise(text).alias(name)

    return marks.where("_made IS NOT NULL").select(
        *PAYMENT_KEY, value("status").alias("status"), value("total").alias("total"), default("currency", F.lit("USD")),
        default("description", F.when(paid, "Pago Finalizado").otherwise("Compra en Proceso")),
        value("details").alias("details"))


def payment_rejects(events: DataFrame, marks: DataFrame) -> DataFrame:
    """The events that are in no mark's favour, with the reason; of equal CREATED events all but one."""
    made = marks.where("_made IS NOT NULL").select(*[F.col(k).alias(f"_{k}") for k in PAYMENT_KEY], "_made")
    same = F.col("order_id").eqNullSafe(F.col("_order_id")) & F.col("iduser").eqNullSafe(F.col("_iduser"))
    # Equal events meet before the shuffle, so a repeated one costs a row for each task.
    counted = events.groupBy(*events.columns).agg(F.count("*").alias("_n"))
    judged = counted.join(made, same, "left")
    completed = F.coalesce(F.col("status") == "COMPLETED", F.lit(False))
    created = F.coalesce(F.col("status") == "CREATED", F.lit(False)) & F.col("ts").isNotNull()
    opened = created & F.col("_made").eqNullSafe(_entry())
    early = F.col("_made").isNull() | (F.col("ts") < F.col("_made.ts"))
    reason = (F.when(F.col("ts").isNull(), "missing_time").when(created, "already_created")
              .when(~completed, "not_completed").when(early, "no_created_row"))
    times = F.when(opened, F.col("_n") - 1).otherwise(F.col("_n"))
    return (judged.withColumn("reason", reason).where(F.col("reason").isNotNull() & (times > 0))
            .withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), times))).select(*events.columns, "reason"))


def payment_state(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Current row per (order_id, iduser) of a payment event log, and the events that changed nothing.

    The first CREATED event makes the row, further ones are refused as ``already_created``; the latest COMPLETED event
    at or after it replaces status, money and texts. Any other event is refused, with the reason. Events of one time
    are ordered by all their fields, so the order of rows does not matter; a NULL order or user is a key like any
    other; events without a time are refused.
    """
    marks = payment_marks(events)
    return marks_state(marks), payment_rejects(events, marks)
