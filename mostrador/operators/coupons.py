"""Coupon claims, eligibility, rule-based grants and capped redemption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mostrador.functions.ranks import first_within_quota
from mostrador.functions.scalars import clock_seconds, moment
from mostrador.operators.lookups import lookup

# The shop's grant rules and welcome code.
GRANT_RULES = [
    ("One Piece", 3, "ONEPIECE5"),
    ("Dragon Ball", 2, "SAIYAN2"),
    ("Dragon Ball", 3, "DRAGON2024"),
]
WELCOME_CODE = "NUEVOU53R"


def grant_rules(spark: SparkSession, rules=None) -> DataFrame:
    return spark.createDataFrame(GRANT_RULES if rules is None else rules,
                                 "clave STRING, cantidadRequerida INT, codigoCupon STRING")


def _running(as_of) -> Column:
    """Active and not past the end; the end itself still counts."""
    return F.col("activo") & (F.col("fecha_expiracion").cast("timestamp_ntz") >= moment(as_of))


def claimed_coupons(cupones: DataFrame, user_cupones: DataFrame, cupones_usados: DataFrame,
                    keys: DataFrame) -> DataFrame:
    """Coupons the listed users claimed, with the date of use if used."""
    uses = cupones_usados.select("iduser", "idcupon", "fecha_uso")
    return (lookup(user_cupones, keys, "iduser").join(cupones, "idcupon")
            .join(uses, ["idcupon", "iduser"], "left")
            .select("iduser", *cupones.columns, "fecha_reclamacion", "fecha_uso"))


def checkout_coupons(cupones: DataFrame, as_of) -> DataFrame:
    """Coupons accepted at checkout, which neither checks claims nor consumes a use."""
    return cupones.where(_running(as_of) & (F.col("usos_maximos") > 0))


def eligible(requests: DataFrame, cupones: DataFrame, user_cupones: DataFrame, cupones_usados: DataFrame,
             as_of) -> DataFrame:
    """Requests (idsolicitud, iduser, codigo, ts) for a running coupon with uses left, claimed and not yet used.

    ``as_of`` may be a column of the requests, to judge each request at its own time. Where several coupons share
    a code, a request takes the one with the lowest id among those that suit it.
    """
    offers = cupones.where("usos_maximos > usos_actuales").select(
        "codigo", "idcupon", "porcentaje", "usos_maximos", "usos_actuales", "activo", "fecha_expiracion")
    good = (requests.join(offers, "codigo").where(_running(as_of)).drop("activo", "fecha_expiracion")
            .join(user_cupones.select("iduser", "idcupon"), ["iduser", "idcupon"], "left_semi")
            .join(cupones_usados.select("iduser", "idcupon"), ["iduser", "idcupon"], "left_anti"))
    coupon = ("idcupon", "porcentaje", "usos_maximos", "usos_actuales")
    return good.groupBy(*requests.columns).agg(F.min(F.struct(*coupon)).alias("_coupon")).select(
        *requests.columns, "_coupon.*")


def offers_of_users(cupones: DataFrame, user_cupones: DataFrame, cupones_usados: DataFrame) -> DataFrame:
    """For each user and code the claimed and unused coupons with uses left, the lowest id first.

    A list has as many entries as coupons share the code.
    """
    open_ = cupones.where("activo AND usos_maximos > usos_actuales").select("codigo", "idcupon", "fecha_expiracion")
    return (user_cupones.select("iduser", "idcupon").distinct().join(open_, "idcupon")
            .join(cupones_usados.select("iduser", "idcupon"), ["iduser", "idcupon"], "left_anti").groupBy("iduser", "codigo")
            .agg(F.sort_array(F.collect_list(F.struct("idcupon", "fecha_expiracion"))).alias("_offers")))


def suitable_offer(as_of) -> Column:
    """Of a request's offers the first that has not expired."""
    return F.get(F.filter("_offers", lambda o: o["fecha_expiracion"].cast("timestamp_ntz") >= moment(as_of)), 0)


def _arrival_slots() -> list[Column]:
    """About an hour, and the second, of arrival, then the exact time and a block of request ids."""
    second = F.coalesce(clock_seconds(F.col("ts")), F.lit(0))
    return [F.shiftright(second, 12), second, F.struct("ts", F.shiftright("idsolicitud", 16).alias("block"))]


def first_by_quota(waiting: DataFrame, cupones: DataFrame) -> DataFrame:
    """Of each user's first requests (iduser, idcupon, ts, idsolicitud) those the coupon has uses left for, by arrival."""
    quota = cupones.select("idcupon", "codigo", "porcentaje",
                           (F.col("usos_maximos") - F.col("usos_actuales")).alias("_remaining"))
    accepted = first_within_quota(waiting.join(quota, "idcupon"), "idcupon", "_remaining", _arrival_slots(),
                                  [F.col("ts"), F.col("idsolicitud")])
    return accepted.select("idsolicitud", "iduser", "idcupon", "codigo", "porcentaje", "ts")


def redeem(requests: DataFrame, cupones: DataFrame, user_cupones: DataFrame, cupones_usados: DataFrame,
           as_of) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accept requests in order of arrival while the coupon has uses left, one per user.

    Gives (accepted requests, new use rows, new use counts). Same result as one request at a time:
    a refused request consumes nothing, so only each user's first eligible request matters, and of
    those the first ``usos_maximos - usos_actuales`` of a coupon win, by time and then id.
    """
    good = eligible(requests, cupones, user_cupones, cupones_usados, as_of)
    first = good.groupBy("iduser", "idcupon").agg(F.min(F.struct("ts", "idsolicitud")).alias("_first"))
    accepted = first_by_quota(first.select("iduser", "idcupon", "_first.*"), cupones)
    new_uses = accepted.select("iduser", "idcupon", F.col("ts").alias("fecha_uso"))
    added = accepted.groupBy("idcupon").agg(F.count("*").alias("_added"))
    new_counts = cupones.join(added, "idcupon").select(
        "idcupon", (F.col("usos_actuales") + F.col("_added")).cast("int").alias("usos_actuales"))
    return accepted, new_uses, new_counts


def grant_coupons(priced_lines: DataFrame, rules: DataFrame, cupones: DataFrame, user_cupones: DataFrame,
                  cupones_usados: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Coupons earned by units of a category within one order, as (grants, missing).

    A user gets a code once, and not at all if ever claimed or used before. ``missing`` lists earned
    codes for which no active coupon exists.
    """
    units = (lookup(priced_lines.select("idcompra", "iduser", "clave", "cantidad"), rules, "clave")
             .groupBy("idcompra", "iduser", "clave").agg(F.sum("cantidad").alias("_units")))
    earned = (units.join(rules, "clave").where(F.col("_units") >= F.col("cantidadRequerida"))
              .select("iduser", F.col("codigoCupon").alias("codigo")).distinct())
    # Only the rules' few codes matter, so claims and uses are reduced to these before they are shuffled.
    wanted = rules.select(F.col("codigoCupon").alias("codigo")).distinct()
    codes = cupones.select("idcupon", "codigo").join(wanted, "codigo", "left_semi")
    pairs = user_cupones.select("iduser", "idcupon").unionByName(cupones_usados.select("iduser", "idcupon"))
    had = pairs.join(codes, "idcupon").select("iduser", "codigo")
    new = earned.join(had, ["iduser", "codigo"], "left_anti")
    active = cupones.where("activo").groupBy("codigo").agg(F.min("idcupon").alias("idcupon"))
    return (new.join(active, "codigo").select("iduser", "idcupon", "codigo"),
            new.join(active, "codigo", "left_anti").select("iduser", "codigo"))


def record_use(requests: DataFrame, cupones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Use rows for requests (iduser, codigo, ts) without any check but that the code exists, and the others."""
    codes = cupones.groupBy("codigo").agg(F.min("idcupon").alias("idcupon"))
    return (requests.join(codes, "codigo").select("iduser", "idcupon", F.col("ts").alias("fecha_uso")),
            requests.join(cupones, "codigo", "left_anti"))


def welcome_coupons(new_users: DataFrame, cupones: DataFrame, code: str = WELCOME_CODE) -> DataFrame:
    """The welcome coupon for every new user, if it is active."""
    coupon = cupones.where((F.col("codigo") == code) & F.col("activo")).agg(F.min("idcupon")).scalar()
    return new_users.select("iduser", coupon.alias("idcupon")).where("idcupon IS NOT NULL")
