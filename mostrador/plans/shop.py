"""The shop's tables, derived by Spark from a TPC-H-like star schema with an event table.

``Shop(spark, directory)`` gives each table as a lazy DataFrame; ``ORACLE_TABLES`` holds the same
derivations as SQL common table expressions for checks in another engine.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

AS_OF = "2024-01-20"
CATEGORY = "PROMO"
RULES = [("PROMO", 60, "Brand#1"), ("SMALL", 40, "Brand#2"), ("SMALL", 60, "Brand#3")]
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
LINE_FLAGS = ("l_returnflag", "l_linestatus")


def _day(base: str, days) -> F.Column:
    return F.date_add(F.lit(base).cast("date"), days.cast("int")).cast("timestamp_ntz")


def _line_fields(column) -> list:
    """The shop's fields of an order line; ``column`` gives a source column by name."""
    size = F.when(column("l_returnflag") == "A", "S").when(column("l_returnflag") == "N", "M").otherwise("L")
    kind = F.when(column("l_linestatus") == "F", "personalizado").otherwise("no_personalizado")
    return [column("l_partkey").alias("idproducto"), column("l_quantity").cast("int").alias("cantidad"),
            size.alias("talla"), kind.alias("tipo_personalizacion"),
            column("l_extendedprice").cast("decimal(14,2)").alias("total_producto")]


class Shop:
    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    @cached_property
    def users(self) -> DataFrame:
        key = F.col("c_custkey")
        sex = F.when(key % 3 == 0, "hombre").when(key % 3 == 1, "mujer").otherwise("otro")
        return (self.source("customer").join(self.source("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
                .select(key.alias("iduser"), F.col("c_name").alias("user"),
                        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
                        _day("1945-01-01", key * 7919 % 27500).cast("date").alias("fecha_nacimiento"),
                        sex.alias("sexo"), F.concat(F.lit("uploads/u"), key % 7, F.lit(".jpg")).alias("foto"),
                        F.col("n_name").alias("estado"), F.when(key % 100 == 0, 2).otherwise(1).alias("idrol"),
                        _day("2022-01-01", key * 7919 % 730).alias("created_at")))

    @cached_property
    def producto(self) -> DataFrame:
        key, off = F.col("p_partkey"), F.col("p_size") % 5 * 5
        price = F.col("p_retailprice").cast("decimal(12,2)")
        final = price * (F.lit(100) - off).cast("decimal(5,0)") * F.lit("0.01").cast("decimal(3,2)")
        kind = F.when(F.col("p_size") % 2 == 0, "personalizado").otherwise("no_personalizado")
        return self.source("part").select(
            key.alias("idproducto"), (key % 40).alias("iduser"), F.col("p_name").alias("nomprod"),
            F.col("p_type").alias("clave"), price.alias("p_producto"), off.alias("descuento"),
            final.cast("decimal(14,4)").alias("p_final"), kind.alias("tipo_personalizacion"),
            F.concat(F.lit("uploads/"), F.col("p_brand"), F.lit(".jpg")).alias("foto"),
            _day("2020-01-01", key * 31 % 900).alias("created_at"))

    @cached_property
    def _lines(self) -> DataFrame:
        return self.source("lineitem").select(F.col("l_orderkey").alias("idcompra"), *LINE_ORDER, *LINE_FLAGS)

    @cached_property
    def lineas(self) -> DataFrame:
        """Order lines as rows; the line number of the source repeats, so the position comes from a full sort key."""
        place = F.row_number().over(Window.partitionBy("idcompra").orderBy(*LINE_ORDER)) - 1
        return self._lines.withColumn("pos", place).select("idcompra", "pos", *_line_fields(F.col))

    @cached_property
    def pedidos(self) -> DataFrame:
        return self.source("orders").select(
            F.col("o_orderkey").alias("idcompra"), F.col("o_custkey").alias("iduser"),
            F.col("o_totalprice").cast("decimal(14,2)").alias("total"), F.col("o_orderdate").alias("fecha"))

    @cached_property
    def compra(self) -> DataFrame:
        return (self.lineas.join(self.pedidos.drop("total"), "idcompra")
                .select((F.col("idcompra") * 100 + F.col("pos")).alias("idcompra"),
                        F.col("total_producto").alias("total"), "fecha", "iduser", "idproducto", "cantidad"))

    @cached_property
    def compra_detalle(self) -> DataFrame:
        return self.compra.select(F.col("idcompra").alias("iddetalle"), "idcompra", "idproducto", "cantidad", "total")

    @cached_property
    def cestas(self) -> DataFrame:
        """Order baskets as JSON text. The sort key comes first in the struct, so sorting gives line order.

        Collecting shrinks nothing before the shuffle, so the lines are spread by order first.
        """
        lines = F.sort_array(F.collect_list(F.struct(*LINE_ORDER, *LINE_FLAGS)))
        basket = F.transform(lines, lambda e: F.struct(*_line_fields(lambda name: e[name])))
        return (self._lines.repartition("idcompra").groupBy("idcompra")
                .agg(F.to_json(basket).alias("productos")))

    @cached_property
    def compras(self) -> DataFrame:
        # Baskets are as many as orders and already spread by order: merge them there.
        return (self.pedidos.join(self.cestas.hint("merge"), "idcompra", "left")
                .withColumn("productos", F.coalesce("productos", F.lit("[]"))))

    @cached_property
    def compras_detalle(self) -> DataFrame:
        code = F.when(F.col("idcompra") % 3 == 0, F.concat(F.lit("Brand#"), F.col("idcompra") % 25 + 1))
        return self.compras.select(F.col("idcompra").alias("iddetalle"), "idcompra", "productos", "total",
                                   code.alias("codigoCupon"))

    @cached_property
    def order_requests(self) -> DataFrame:
        """Orders as the shop front would send them: every third with a coupon code, some from unknown users."""
        code = F.when(F.col("idcompra") % 3 == 0, F.concat(F.lit("Brand#"), F.col("idcompra") % 25 + 1))
        buyer = F.when(F.col("idcompra") % 97 == 0, -1).otherwise(F.col("iduser"))
        return self.compras.select("idcompra", buyer.alias("iduser"), "fecha", code.alias("codigoCupon"), "productos")

    @cached_property
    def _events(self) -> DataFrame:
        return self.source("events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))

    def _events_of(self, *kinds: str) -> DataFrame:
        return self._events.where(F.col("event_type").isin(*kinds))

    @cached_property
    def comentarios(self) -> DataFrame:
        rating = F.when(F.col("event_id") % 17 != 0, (F.col("event_id") % 5 + 1).cast("int"))
        return self._events_of("view", "click").select(
            F.col("event_id").alias("idcomentario"), F.col("k").alias("idproducto"), F.col("user_id").alias("iduser"),
            F.col("event_type").alias("comentario"), rating.alias("calificacion"), F.col("ts").alias("fecha"))

    @cached_property
    def cupones(self) -> DataFrame:
        number = F.expr("cast(substring(p_brand, 7) as int)")
        return self.source("part").select("p_brand").distinct().select(
            number.alias("idcupon"), F.col("p_brand").alias("codigo"),
            (5 * (1 + number % 4)).cast("decimal(5,2)").alias("porcentaje"), (10 + number % 7).alias("usos_maximos"),
            (number % 5).alias("usos_actuales"), (number % 6 != 0).alias("activo"),
            _day("2024-01-10", number).alias("fecha_expiracion"))

    def _coupon_events(self, kind: str) -> DataFrame:
        return self._events_of(kind).select(
            F.col("event_id").alias("idsolicitud"), F.col("user_id").alias("iduser"),
            (F.col("k") % 25 + 1).alias("idcupon"), "ts")

    @cached_property
    def user_cupones(self) -> DataFrame:
        return self._coupon_events("signup").groupBy("iduser", "idcupon").agg(F.min("ts").alias("fecha_reclamacion"))

    @cached_property
    def canjes(self) -> DataFrame:
        """Redemption requests by coupon code."""
        return self._coupon_events("purchase").select(
            "idsolicitud", "iduser", F.concat(F.lit("Brand#"), F.col("idcupon")).alias("codigo"), "ts")

    @cached_property
    def cupones_usados(self) -> DataFrame:
        return self._coupon_events("error").groupBy("iduser", "idcupon").agg(F.min("ts").alias("fecha_uso"))

    @cached_property
    def visitas(self) -> DataFrame:
        return self._events_of("view").select("event_id", "ts")

    @cached_property
    def rol(self) -> DataFrame:
        return self.source("region").select(F.col("r_regionkey").alias("idrol"), F.col("r_name").alias("nomrol"))

    @cached_property
    def permiso(self) -> DataFrame:
        return self.source("nation").select(
            F.col("n_nationkey").alias("idpermiso"), F.col("n_name").alias("nompermiso"))

    @cached_property
    def rolxpermiso(self) -> DataFrame:
        return self.source("nation").select(
            F.col("n_regionkey").alias("idrol"), F.col("n_nationkey").alias("idpermiso"))

    @cached_property
    def detalle_entrega(self) -> DataFrame:
        nations = self.source("nation").join(self.source("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        buyers = (self.source("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
                  .select(F.col("c_custkey").alias("iduser"), F.col("r_name").alias("pais"),
                          F.col("c_name").alias("nombre"), F.col("n_name").alias("estado")))
        return (self.pedidos.select("idcompra", "iduser").join(buyers, "iduser")
                .select(F.col("idcompra").alias("identrega"), "idcompra", "pais", "nombre", "estado"))

    @cached_property
    def pagos(self) -> DataFrame:
        """Payment events: one CREATED per order, and a minute later one COMPLETED or DECLINED for orders that are
        finished or in part, sometimes under another user."""
        orders = self.source("orders")
        key, status = F.col("o_orderkey"), F.col("o_orderstatus")
        done = F.when(status == "F", "COMPLETED").when(status == "P", "DECLINED")
        buyer = F.when(key % 13 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
        base = [F.concat(F.lit("PP-"), key).alias("order_id"), F.col("o_totalprice").cast("decimal(14,2)").alias("total")]
        made = orders.select(
            *base, F.col("o_custkey").alias("iduser"), F.lit("CREATED").alias("status"), F.col("o_orderdate").alias("ts"),
            F.when(key % 2 == 0, "MXN").alias("currency"), F.lit("").alias("description"))
        paid = orders.where(done.isNotNull()).select(
            *base, buyer.alias("iduser"), done.alias("status"),
            (F.col("o_orderdate") + F.expr("INTERVAL 1 MINUTE")).alias("ts"),
            F.when(key % 5 == 0, "MXN").otherwise("USD").alias("currency"),
            F.when(key % 3 == 0, "Gracias").alias("description"))
        return made.unionByName(paid).withColumn("details", F.lit(None).cast("string"))

    @cached_property
    def product_changes(self) -> DataFrame:
        """Inserts, updates and deletes of products, some of them for ids that do not exist."""
        op = (F.when(F.col("event_type") == "purchase", "update").when(F.col("event_type") == "signup", "insert")
              .otherwise("delete"))
        return self._events_of("purchase", "signup", "error").select(
            (F.col("user_id") * 3 + F.col("k") * 29).alias("idproducto"), op.alias("op"),
            F.col("event_id").alias("seq"),
            F.concat(F.lit("v"), F.col("event_id")).alias("nomprod"), (F.col("k") % 5 * 5).alias("descuento"))


# The same tables in plain SQL, for an engine that sees the source tables as views.
ORACLE_TABLES = """
users AS (
  SELECT c_custkey AS iduser, c_name AS usuario, lower(c_name) || '@example.com' AS email,
         DATE '1945-01-01' + CAST(c_custkey*7919 % 27500 AS INT) AS fecha_nacimiento,
         CASE c_custkey % 3 WHEN 0 THEN 'hombre' WHEN 1 THEN 'mujer' ELSE 'otro' END AS sexo,
         'uploads/u' || (c_custkey % 7) || '.jpg' AS foto,
         n_name AS estado, CASE WHEN c_custkey % 100 = 0 THEN 2 ELSE 1 END AS idrol,
         DATE '2022-01-01' + CAST(c_custkey*7919 % 730 AS INT) AS created_at
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
producto AS (
  SELECT p_partkey AS idproducto, p_partkey % 40 AS iduser, p_name AS nomprod, p_type AS clave,
         CAST(p_retailprice AS DECIMAL(12,2)) AS p_producto, (p_size % 5)*5 AS descuento,
         CAST(CAST(p_retailprice AS DECIMAL(12,2)) * CAST(100-(p_size % 5)*5 AS DECIMAL(5,0))
              * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(14,4)) AS p_final,
         CASE WHEN p_size % 2 = 0 THEN 'personalizado' ELSE 'no_personalizado' END AS tipo_personalizacion,
         'uploads/' || p_brand || '.jpg' AS foto,
         DATE '2020-01-01' + CAST(p_partkey*31 % 900 AS INT) AS created_at
  FROM part),
lineas AS (
  SELECT l_orderkey AS idcompra,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                            l_quantity, l_extendedprice, l_shipdate) - 1 AS pos,
         l_partkey AS idproducto, CAST(l_quantity AS INT) AS cantidad,
         CASE l_returnflag WHEN 'A' THEN 'S' WHEN 'N' THEN 'M' ELSE 'L' END AS talla,
         CASE WHEN l_linestatus = 'F' THEN 'personalizado' ELSE 'no_personalizado' END AS tipo_personalizacion,
         CAST(l_extendedprice AS DECIMAL(14,2)) AS total_producto
  FROM lineitem),
pedidos AS (
  SELECT o_orderkey AS idcompra, o_custkey AS iduser, CAST(o_totalprice AS DECIMAL(14,2)) AS total,
         o_orderdate AS fecha
  FROM orders),
compra AS (
  SELECT l.idcompra*100 + l.pos AS idcompra, l.total_producto AS total, p.fecha, p.iduser, l.idproducto, l.cantidad
  FROM lineas l JOIN pedidos p ON l.idcompra = p.idcompra),
solicitudes AS (
  SELECT idcompra, CASE WHEN idcompra % 97 = 0 THEN -1 ELSE iduser END AS iduser, fecha,
         CASE WHEN idcompra % 3 = 0 THEN 'Brand#' || (1 + idcompra % 25) END AS codigocupon
  FROM pedidos),
eventos AS (
  SELECT event_id, ts, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
comentarios AS (
  SELECT event_id AS idcomentario, k AS idproducto, user_id AS iduser, event_type AS comentario,
         CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(1 + event_id % 5 AS INT) END AS calificacion, ts AS fecha
  FROM eventos WHERE event_type IN ('view', 'click')),
cupones AS (
  SELECT DISTINCT CAST(substr(p_brand,7) AS INT) AS idcupon, p_brand AS codigo,
         5*(1+CAST(substr(p_brand,7) AS INT) % 4) AS porcentaje,
         10 + CAST(substr(p_brand,7) AS INT) % 7 AS usos_maximos,
         CAST(substr(p_brand,7) AS INT) % 5 AS usos_actuales,
         CAST(substr(p_brand,7) AS INT) % 6 <> 0 AS activo,
         DATE '2024-01-10' + CAST(substr(p_brand,7) AS INT) AS fecha_expiracion
  FROM part),
user_cupones AS (
  SELECT user_id AS iduser, 1 + k % 25 AS idcupon, min(ts) AS fecha_reclamacion
  FROM eventos WHERE event_type = 'signup' GROUP BY 1, 2),
canjes AS (
  SELECT event_id AS idsolicitud, user_id AS iduser, 1 + k % 25 AS idcupon, 'Brand#' || (1 + k % 25) AS codigo, ts
  FROM eventos WHERE event_type = 'purchase'),
cupones_usados AS (
  SELECT user_id AS iduser, 1 + k % 25 AS idcupon, min(ts) AS fecha_uso
  FROM eventos WHERE event_type = 'error' GROUP BY 1, 2),
visitas AS (SELECT event_id, ts FROM eventos WHERE event_type = 'view'),
rolxpermiso AS (SELECT n_regionkey AS idrol, n_nationkey AS idpermiso FROM nation),
permiso AS (SELECT n_nationkey AS idpermiso, n_name AS nompermiso FROM nation),
rol AS (SELECT r_regionkey AS idrol, r_name AS nomrol FROM region),
detalle_entrega AS (
  SELECT o_orderkey AS identrega, o_orderkey AS idcompra, r_name AS pais, c_name AS nombre, n_name AS estado
  FROM orders JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
pagos AS (
  SELECT 'PP-' || o_orderkey AS order_id, o_custkey AS iduser, CAST(o_totalprice AS DECIMAL(14,2)) AS total,
         'CREATED' AS status, o_orderdate AS ts, CASE WHEN o_orderkey % 2 = 0 THEN 'MXN' END AS currency,
         '' AS description
  FROM orders
  UNION ALL
  SELECT 'PP-' || o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN o_custkey + 1 ELSE o_custkey END,
         CAST(o_totalprice AS DECIMAL(14,2)),
         CASE WHEN o_orderstatus = 'F' THEN 'COMPLETED' ELSE 'DECLINED' END, o_orderdate + INTERVAL 1 MINUTE,
         CASE WHEN o_orderkey % 5 = 0 THEN 'MXN' ELSE 'USD' END, CASE WHEN o_orderkey % 3 = 0 THEN 'Gracias' END
  FROM orders WHERE o_orderstatus IN ('F', 'P')),
cambios AS (
  SELECT user_id * 3 + k * 29 AS idproducto,
         CASE event_type WHEN 'purchase' THEN 'update' WHEN 'signup' THEN 'insert' ELSE 'delete' END AS op,
         event_id AS seq, 'v' || event_id AS nomprod, k % 5 * 5 AS descuento
  FROM eventos WHERE event_type IN ('purchase', 'signup', 'error'))
"""
