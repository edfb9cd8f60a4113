"""Product lists that carry a mean rating.

Comments are summed to one row per product before the join, so a product with very many comments
costs one row per map task instead of a fan-out. Filters on products come first and reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mostrador.functions.ranks import sliced_rank
from mostrador.functions.scalars import contains_text, ratio, under_collation
from mostrador.operators.lookups import lookup

RATINGS = (1, 2, 3, 4, 5)
SLICE_BITS = 10


def _stars():
    """The rating where it is a whole number from 1 to 5, else 0."""
    return F.when(F.col("calificacion").isin(*RATINGS), F.col("calificacion")).otherwise(0)


def rating_summary(comentarios: DataFrame) -> DataFrame:
    """Per product: how often each rating was given, all comments, and their mean over all comments."""
    counts = [F.sum(F.when(F.col("calificacion") == r, 1).otherwise(0)).alias(str(r)) for r in RATINGS]
    return (comentarios.groupBy("idproducto")
            .agg(*counts, F.count("*").alias("TOTAL"), F.sum(_stars()).alias("_stars"))
            .withColumn("calificacion_final", ratio(F.col("_stars"), F.col("TOTAL"), 2)).drop("_stars"))


def with_rating(products: DataFrame, comments: DataFrame) -> DataFrame:
    """Products with ``calificacion_final``: mean over comments that have a rating, 0 when there are none."""
    rated = comments.groupBy("idproducto").agg(
        F.sum(_stars()).alias("_stars"), F.count("calificacion").alias("_n"))
    mean = F.coalesce(ratio(F.col("_stars"), F.col("_n"), 2), F.lit(0).cast("decimal(14,2)"))
    return (products.join(rated, "idproducto", "left")
            .select(*[products[c] for c in products.columns], mean.alias("calificacion_final")))


def _chosen_with_rating(chosen: DataFrame, comments: DataFrame) -> DataFrame:
    """The same for a choice of products: only their comments are summed and shuffled."""
    return with_rating(chosen, lookup(comments, chosen.select("idproducto"), "idproducto"))


def _with_owner(rated: DataFrame, users: DataFrame) -> DataFrame:
    owners = users.select("iduser", F.col("user").alias("nombre_usuario"))
    return rated.join(owners, "iduser", "left")


def _of_kind(products: DataFrame, kind: str) -> DataFrame:
    return products.where(F.col("tipo_personalizacion") == kind)


def plain_products(products: DataFrame, comments: DataFrame, users: DataFrame,
                   owners: DataFrame | None = None) -> DataFrame:
    """Products that are not personalised, with their owner's name; optionally of the listed owners."""
    chosen = _of_kind(products, "no_personalizado")
    rated = (with_rating(chosen, comments) if owners is None
             else _chosen_with_rating(lookup(chosen, owners, "iduser"), comments))
    return _with_owner(rated, users)


def personalised_of_owners(products: DataFrame, comments: DataFrame, users: DataFrame,
                           owners: DataFrame) -> DataFrame:
    """Personalised products of the listed owners, with the owner's name."""
    chosen = lookup(_of_kind(products, "personalizado"), owners, "iduser")
    return _with_owner(_chosen_with_rating(chosen, comments), users)


def personalised_products(products: DataFrame, comments: DataFrame) -> DataFrame:
    return with_rating(_of_kind(products, "personalizado"), comments)


def newest_products(products: DataFrame, comments: DataFrame, n: int = 4) -> DataFrame:
    """The newest products that are not personalised. The rating plays no part, so the choice comes first."""
    newest = _of_kind(products, "no_personalizado").orderBy(F.desc("created_at"), "idproducto").limit(n)
    return _chosen_with_rating(newest, comments).orderBy(F.desc("created_at"), "idproducto")


def discounted(products: DataFrame) -> DataFrame:
    return products.where(F.col("descuento") > 0)


def discounted_products(products: DataFrame, comments: DataFrame) -> DataFrame:
    return with_rating(discounted(products), comments)


def products_by_id(products: DataFrame, comments: DataFrame, keys: DataFrame) -> DataFrame:
    return with_rating(lookup(products, keys, "idproducto"), lookup(comments, keys, "idproducto"))


def search_products(products: DataFrame, text: str, comments: DataFrame | None = None,
                    discounted_only: bool = False, raw_pattern: bool = False) -> DataFrame:
    """Products whose name contains ``text``, in any letter case; with rating when comments are given."""
    found = products.where(contains_text(F.col("nomprod"), text, raw_pattern))
    found = discounted(found) if discounted_only else found
    return found if comments is None else _chosen_with_rating(found, comments)


def products_of_category(products: DataFrame, comments: DataFrame, clave: str,
                         discounted_only: bool = False) -> DataFrame:
    chosen = products.where(F.col("clave") == clave)
    return _chosen_with_rating(discounted(chosen) if discounted_only else chosen, comments)


def distinct_keys(products: DataFrame, discounted_only: bool = False, collation: str | None = None) -> DataFrame:
    """Category keys in use."""
    chosen = discounted(products) if discounted_only else products
    if collation:
        return chosen.groupBy(under_collation(F.col("clave"), collation).alias("_key")).agg(
            F.min("clave").alias("clave")).select("clave")
    return chosen.select("clave").distinct()


def related_products(products: DataFrame, anchors: DataFrame, k: int = 4, seed: int = 0,
                     comments: DataFrame | None = None) -> DataFrame:
    """Up to ``k`` random products of a category for each anchor (idproducto, clave), never the anchor itself.

    With rating when comments are given.

    Every category is put in one seeded random order and an anchor takes the ``k`` products after its
    own place, wrapping around: each other product is equally likely, the choice repeats for a seed, and
    no anchor is paired with more than ``k`` products however large its category.
    """
    # 60 bits of a digest, which other engines can compute as well.
    digest = F.substring(F.md5(F.concat_ws(":", F.col("idproducto").cast("string"), F.lit(str(seed)))), 1, 15)
    spot = F.conv(digest, 16, 10).cast("bigint")
    ranked = sliced_rank(products.select("idproducto", "clave"), ["clave"], F.shiftright(spot, 60 - SLICE_BITS),
                         [spot, F.col("idproducto")])
    own = ranked.select("clave", "idproducto", F.col("rank").alias("_own"))
    sizes = products.groupBy("clave").agg(F.count("*").alias("_size"))
    placed = anchors.select("idproducto", "clave").join(sizes, "clave").join(own, ["clave", "idproducto"], "left")
    start = F.coalesce(F.col("_own") + 1, F.pmod(spot, "_size"))
    available = F.when(F.col("_own").isNull(), F.col("_size")).otherwise(F.col("_size") - 1)
    wanted = F.sequence(F.lit(0), F.least(available, F.lit(k)).cast("int") - 1)
    steps = (placed.where(available > 0)
             .select("clave", F.col("idproducto").alias("idancla"), "_size", start.alias("_start"),
                     F.explode(wanted).alias("_step"))
             .select("clave", "idancla", F.pmod(F.col("_start") + F.col("_step"), "_size").alias("rank")))
    return (steps.join(ranked.drop("size"), ["clave", "rank"])
            .select("idancla", "idproducto")
            .join(products if comments is None else with_rating(products, comments), "idproducto"))
