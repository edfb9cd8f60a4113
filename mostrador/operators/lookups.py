"""Bulk lookups, parent checks and the joined listings of orders, details, roles and comments.

Dimension sides carry no broadcast hint: Spark broadcasts them below its size threshold and
otherwise uses a sort-merge join whose skewed partitions adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _keys(df: DataFrame, on) -> DataFrame:
    """The distinct keys of a table. Reduced before the shuffle, so a key that fills a third of it costs nothing."""
    return df.select(*([on] if isinstance(on, str) else on)).distinct()


def lookup(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    """Rows whose key is listed."""
    return df.join(_keys(keys, on), on, "left_semi")


def lookup_missing(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    """Listed keys that have no row."""
    return keys.join(_keys(df, on), on, "left_anti")


def require_parent(df: DataFrame, parent: DataFrame, on) -> tuple[DataFrame, DataFrame]:
    """Rows whose parent exists, and the others."""
    return df.join(_keys(parent, on), on, "left_semi"), df.join(_keys(parent, on), on, "left_anti")


def order_details(compra_detalle: DataFrame) -> DataFrame:
    return compra_detalle.select("idcompra", "idproducto", "cantidad", "total")


def order_listing(compra: DataFrame, users: DataFrame, producto: DataFrame) -> DataFrame:
    """Flat orders with product name and the buyer's e-mail."""
    return (compra.join(users.select("iduser", F.col("email").alias("usuario")), "iduser")
            .join(producto.select("idproducto", F.col("nomprod").alias("producto")), "idproducto")
            .select("idcompra", "total", "fecha", "producto", "usuario", "cantidad"))


def user_purchases(compra: DataFrame, producto: DataFrame, keys: DataFrame) -> DataFrame:
    """What the listed users bought, with product name and photo."""
    names = producto.select("idproducto", F.col("nomprod").alias("producto"), F.col("foto").alias("productoFoto"))
    return (lookup(compra, keys, "iduser").join(names, "idproducto")
            .select("iduser", "producto", "productoFoto", "cantidad", "total"))


def detail_lines(compra_detalle: DataFrame, producto: DataFrame, keys: DataFrame) -> DataFrame:
    """Detail rows of the listed orders with product names."""
    names = producto.select("idproducto", F.col("nomprod").alias("producto"))
    return (lookup(compra_detalle, keys, "idcompra").join(names, "idproducto")
            .select("idcompra", "producto", "cantidad", "total"))


def role_permissions(rolxpermiso: DataFrame, permiso: DataFrame, keys: DataFrame) -> DataFrame:
    """Permissions of the listed roles."""
    return (lookup(rolxpermiso, keys, "idrol")
            .join(permiso.select("idpermiso", F.col("nompermiso").alias("nombre_permiso")), "idpermiso")
            .select("idrol", "idpermiso", "nombre_permiso"))


def product_comments(comentarios: DataFrame, users: DataFrame, keys: DataFrame) -> DataFrame:
    """Comments on the listed products with their authors, newest first."""
    authors = users.select("iduser", "user", F.col("foto").alias("userFoto"))
    return (lookup(comentarios, keys, "idproducto").join(authors, "iduser")
            .select("idproducto", "comentario", "fecha", "calificacion", "user", "userFoto")
            .orderBy(F.desc("fecha"), "idproducto", "user"))
