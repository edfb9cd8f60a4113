"""Sales, customer and visit reports over flat tables.

Money is summed in DECIMAL. Reports that show names group by id first, so that the shuffle carries
one row per id and map task, whatever the skew, and join the name afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mostrador.functions.scalars import (
    complete_years, moment, month_label, month_start, month_text, percent, under_collation)

AGE_BANDS = ((10, 15), (16, 20), (21, 35), (36, 50), (51, 70))
WIDE_AGE_BANDS = ((10, 20), (21, 35), (36, 50), (51, 80))


def yearly_summary(compra: DataFrame) -> DataFrame:
    """Orders, money, mean and share of all money by year."""
    per_year = compra.groupBy(F.year("fecha").alias("Año")).agg(
        F.count("*").alias("Count"), F.sum("total").alias("Sum"), F.avg("total").alias("Avg"))
    # The window sees one row per calendar year; a second pass over the orders would cost far more.
    grand_total = F.sum("Sum").over(Window.partitionBy())
    return per_year.withColumn("Porcentaje", percent(F.col("Sum"), grand_total, 2)).orderBy("Año")


def sales_by_product_year(compra: DataFrame, producto: DataFrame, comentarios: DataFrame | None = None,
                          compat: bool = False) -> DataFrame:
    """Money by product name and year.

    ``compat`` counts every order once per comment on its product (once when there is none).
    """
    sales = compra.groupBy("idproducto", F.year("fecha").alias("Año")).agg(F.sum("total").alias("Total"))
    if compat:
        comments = comentarios.groupBy("idproducto").agg(F.count("*").alias("_n"))
        sales = sales.join(comments, "idproducto", "left").withColumn(
            "Total", F.col("Total") * F.coalesce("_n", F.lit(1)))
    return (sales.join(producto.select("idproducto", F.col("nomprod").alias("Nombre_Producto")),
                       "idproducto", "left")
            .groupBy("Nombre_Producto", "Año").agg(F.sum("Total").alias("Total"))
            .orderBy(F.desc("Nombre_Producto"), F.desc("Año")))


def _by_month(df: DataFrame, column: str, *measures: Column) -> DataFrame:
    return df.groupBy(month_start(column).alias("_month")).agg(*measures)


def monthly_revenue(orders: DataFrame) -> DataFrame:
    """Money by month, for flat or basket orders."""
    return (_by_month(orders, "fecha", F.sum("total").alias("total_compras"))
            .select(month_text(F.col("_month")).alias("mes"), "total_compras").orderBy("mes"))


def monthly_orders(orders: DataFrame) -> DataFrame:
    """Number of orders by month, for flat or basket orders."""
    return (_by_month(orders, "fecha", F.count("*").alias("total_ordenes"))
            .select(month_text(F.col("_month")).alias("mes"), "total_ordenes").orderBy("mes"))


def order_value_totals(compras: DataFrame) -> DataFrame:
    """Sum and mean (one decimal) of order totals, as one row."""
    return compras.agg(F.sum("total").alias("total_dinero_compras"),
                       F.round(F.avg("total"), 1).alias("media_dinero_compras"))


def users_by(users: DataFrame, column: str, values=None, count_name: str = "cantidad",
             collation: str | None = None) -> DataFrame:
    """Users per value of a column, optionally only for the listed values."""
    key = under_collation(F.col(column), collation)
    chosen = users if values is None else users.where(key.isin(list(values)))
    return chosen.groupBy(key.alias(column)).agg(F.count("*").alias(count_name))


def age_histogram(users: DataFrame, as_of, bands=AGE_BANDS) -> DataFrame:
    """Users in each inclusive age band, as one wide row. Ages outside every band are not counted."""
    age = complete_years(F.col("fecha_nacimiento"), moment(as_of))
    ages = users.select(age.alias("_age"))
    return ages.agg(*[F.sum(F.when(F.col("_age").between(low, high), 1).otherwise(0)).alias(f"{low}-{high}")
                      for low, high in bands])


def new_users_by_month(users: DataFrame) -> DataFrame:
    """New users per month, labelled like "March 2024", in time order."""
    return (_by_month(users, "created_at", F.count("*").alias("total_nuevos")).orderBy("_month")
            .select(month_label(F.col("_month")).alias("mes"), "total_nuevos"))


def products_per_user(users: DataFrame, producto: DataFrame) -> DataFrame:
    """Products listed by each user name, users with none included."""
    listed = producto.groupBy("iduser").agg(F.count("idproducto").alias("_n"))
    return (users.select("iduser", "user").join(listed, "iduser", "left")
            .groupBy(F.col("user").alias("nombre_usuario"))
            .agg(F.sum(F.coalesce("_n", F.lit(0))).alias("total_productos"))
            .orderBy(F.desc("total_productos"), "nombre_usuario"))


def count_where(df: DataFrame, condition: Column | None = None, name: str = "total") -> DataFrame:
    """Number of rows, or of rows meeting a condition, as one row."""
    return (df if condition is None else df.where(condition)).agg(F.count("*").alias(name))


def visits_by_month(visitas_por_mes: DataFrame) -> DataFrame:
    return visitas_por_mes.select("mes", "numero_de_visitas").orderBy("mes")


def visits_total(visitas_por_mes: DataFrame) -> DataFrame:
    return visitas_por_mes.agg(F.sum("numero_de_visitas").alias("total_visitas"))


def top_states(users: DataFrame, n: int = 5) -> DataFrame:
    """States with most users and their share of all users."""
    everyone = users.agg(F.count("*")).scalar()
    return (users.groupBy("estado").agg(F.count("*").alias("total_usuarios"))
            .withColumn("porcentaje", percent(F.col("total_usuarios").cast("decimal(20,0)"),
                                              everyone.cast("decimal(20,0)"), 1))
            .orderBy(F.desc("total_usuarios"), "estado").limit(n))


def best_sellers(compra: DataFrame, producto: DataFrame, n: int = 5) -> DataFrame:
    """Products (by name and photo) in most orders."""
    sold = compra.groupBy("idproducto").agg(F.count("*").alias("_n"))
    return (sold.join(producto.select("idproducto", "nomprod", "foto"), "idproducto")
            .groupBy("foto", "nomprod").agg(F.sum("_n").alias("total_ventas"))
            .orderBy(F.desc("total_ventas"), "nomprod", "foto").limit(n))


def top_coupons(cupones_usados: DataFrame, cupones: DataFrame, n: int = 5) -> DataFrame:
    """Coupon codes used most."""
    used = cupones_usados.groupBy("idcupon").agg(F.count("idcupon").alias("_n"))
    return (used.join(cupones.select("idcupon", F.col("codigo").alias("nombre_codigo")), "idcupon")
            .groupBy("nombre_codigo").agg(F.sum("_n").alias("cantidad_usados"))
            .orderBy(F.desc("cantidad_usados"), "nombre_codigo").limit(n))


def top_coupon_users(cupones_usados: DataFrame, users: DataFrame, n: int = 5) -> DataFrame:
    """Users who used most coupons."""
    used = cupones_usados.groupBy("iduser").agg(F.count("idcupon").alias("_n"))
    return (used.join(users.select("iduser", F.col("user").alias("nombre_usuario"),
                                   F.col("foto").alias("foto_usuario")), "iduser")
            .groupBy("nombre_usuario", "foto_usuario").agg(F.sum("_n").alias("cantidad_usados"))
            .orderBy(F.desc("cantidad_usados"), "nombre_usuario", "foto_usuario").limit(n))


def top_rated(producto: DataFrame, comentarios: DataFrame, n: int = 3) -> DataFrame:
    """Products with the highest plain mean rating; products without comments do not appear."""
    means = comentarios.groupBy("idproducto").agg(
        F.avg("calificacion").alias("promedio_calificacion"))
    return (producto.select("idproducto", "nomprod").join(means, "idproducto")
            .orderBy(F.desc("promedio_calificacion"), "idproducto").limit(n))


def newest_users(users: DataFrame, n: int = 8) -> DataFrame:
    return users.orderBy(F.desc("created_at"), "iduser").limit(n)
