"""Keyed change batches, counters, and intake of users and comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mostrador.functions.scalars import is_set, month_start, month_text

DEFAULT_PHOTO = "uploads/default.jpg"
CUSTOMER, ADMINISTRATOR = 1, 2


def visit_counts(visits: DataFrame, column: str = "ts") -> DataFrame:
    """Visits per month of an event table."""
    return (visits.groupBy(month_start(column).alias("_month")).agg(F.count("*").alias("numero_de_visitas"))
            .select(month_text(F.col("_month")).alias("mes"), "numero_de_visitas"))


def visit_counts_from_text(visits: DataFrame, column: str = "fecha_visita") -> DataFrame:
    """The same for dates held as text: the month is its first seven characters, whatever they are."""
    return visits.groupBy(F.substring(column, 1, 7).alias("mes")).agg(F.count("*").alias("numero_de_visitas"))


def merge_counts(stored: DataFrame, added: DataFrame) -> DataFrame:
    """Stored monthly counters with new ones added."""
    return (stored.select("mes", "numero_de_visitas").unionByName(added.select("mes", "numero_de_visitas"))
            .groupBy("mes").agg(F.sum("numero_de_visitas").alias("numero_de_visitas")))


def prepare_users(raw: DataFrame, role: int = CUSTOMER) -> DataFrame:
    """New user rows with their role and, where no photo was sent, the default photo; no password leaves here."""
    photo = F.when(is_set(F.col("foto")), F.col("foto")).otherwise(DEFAULT_PHOTO)
    return raw.drop("password", "remember_token").withColumn("foto", photo).withColumn("idrol", F.lit(role))


def rating_fits(compat: bool = False) -> Column:
    """Whether a comment's rating is a whole number from 1 to 5; ``compat`` lets a missing one and fractions pass."""
    rating = F.col("calificacion")
    inside = rating.between(1, 5)
    return F.coalesce((rating.isNull() | inside) if compat else (inside & (rating % 1 == 0)), F.lit(False))


def ingest_comments(new: DataFrame, existing: DataFrame, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """New comments to keep, and the refused ones with the reason; one comment per product and user.

    ``new`` has a unique ``idcomentario``. Ratings must be whole numbers from 1 to 5; ``compat`` lets a
    missing rating and fractions pass. Of several comments in the batch the earliest counts.
    """
    pair = ["idproducto", "iduser"]
    fits = rating_fits(compat)
    seen = existing.select(*pair, F.lit(True).alias("_seen")).distinct()
    earliest = (new.where(fits).groupBy(*pair)
                .agg(F.min_by(F.col("idcomentario"), F.struct("fecha", "idcomentario")).alias("idcomentario")))
    winners = earliest.join(seen, pair, "left").select("idcomentario", F.coalesce("_seen", F.lit(False)).alias("_seen"))
    # Joined by the unique id, so that a pair with very many comments spreads over all tasks.
    judged = new.withColumn("_fits", fits).join(winners, "idcomentario", "left")
    ok = judged.where(F.col("_seen") == F.lit(False)).select(*new.columns)
    losers = judged.where(F.col("_seen").isNull() | F.col("_seen"))
    reason = (F.when(~F.col("_fits"), "rating_out_of_range")
              .when(F.col("_before").isNotNull(), "already_commented").otherwise("repeated_in_batch"))
    rejects = (losers.join(seen.withColumnRenamed("_seen", "_before"), pair, "left")
               .select(*new.columns, reason.alias("reason")))
    return ok, rejects


def apply_changes(table: DataFrame, changes: DataFrame, key, op_col: str = "op",
                  order_col: str = "seq") -> tuple[DataFrame, DataFrame]:
    """The table after a batch of ``insert``, ``update`` and ``delete`` rows, and the changes that matched nothing.

    The result is that of the changes one by one in ``order_col`` order, which is unique within a key: an insert on
    a key that exists and an update or delete of one that does not change nothing and are reported, as
    ``key_exists``, ``no_such_key`` or, for any other operation, ``unknown_op``. Changes may hold only some of the
    table's columns: the others keep their value on update and are NULL on insert. An update reaches every row of
    its key. Two mergeable sums reduce the batch to one row per key, so many changes of one key cost no single task
    and the table is not shuffled as long as that is small enough for Spark to broadcast; only the report walks
    through the changes of a key in order.
    """
    key = [key] if isinstance(key, str) else list(key)
    columns = [c for c in table.columns if c in changes.columns and c not in key]
    asked = changes if columns else changes.withColumn("_none", F.lit(None).cast("string"))
    row = F.struct(*(columns or ["_none"]))
    op, order = F.col(op_col), F.col(order_col)
    present = table.select(*key).join(changes.select(*key), key, "left_semi").distinct().withColumn("_present", F.lit(True))
    ends = changes.groupBy(*key).agg(F.max(F.when(op == "delete", order)).alias("_deleted")).join(present, key, "left")
    # What counts comes after the last delete. Where there is none, a key of the table lives on and inserts do nothing.
    since = F.col("_deleted").isNull() | (order > F.col("_deleted"))
    lives = F.col("_deleted").isNull() & F.col("_present").isNotNull()
    inserted, updated = (op == "insert") & since & ~lives, (op == "update") & since
    net = asked.join(ends, key).groupBy(*key).agg(
        F.max("_deleted").alias("_deleted"), F.min(F.when(inserted, order)).alias("_inserted"),
        F.max(F.when(updated, order)).alias("_updated"),
        F.min_by(row, F.when(inserted, order)).alias("_insert"), F.max_by(row, F.when(updated, order)).alias("_update"))
    touched = table.join(net, key, "left")
    kept = touched.where("_deleted IS NULL").select(*[
        F.when(F.col("_updated").isNotNull(), F.col(f"_update.{c}")).otherwise(F.col(c)).alias(c)
        if c in columns else F.col(c) for c in table.columns])
    changed_since = F.col("_updated") > F.col("_inserted")
    started = net.where("_inserted IS NOT NULL").select(*[
        F.col(c) if c in key
        else F.when(changed_since, F.col(f"_update.{c}")).otherwise(F.col(f"_insert.{c}")).alias(c) if c in columns
        else F.lit(None).cast(table.schema[c].dataType).alias(c) for c in table.columns])
    before = Window.partitionBy(*key).orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    made = F.last(F.when(op == "insert", True).when(op == "delete", False), ignorenulls=True).over(before)
    exists = F.coalesce("_made", "_present", F.lit(False))
    reason = (F.when(~F.coalesce(op.isin("insert", "update", "delete"), F.lit(False)), "unknown_op")
              .when((op == "insert") & exists, "key_exists").when((op != "insert") & ~exists, "no_such_key"))
    unmatched = (changes.withColumn("_made", made).join(present, key, "left")
                 .select(*changes.columns, reason.alias("reason")).where("reason IS NOT NULL"))
    return kept.unionByName(started), unmatched


def replace_role_permission(rolxpermiso: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Set the permission on every row of the listed roles (idrol, idpermiso, seq); roles without rows are reported.

    Rows whose permission is missing are left out, as the shop front refuses them.
    """
    valid = changes.where("idpermiso IS NOT NULL").withColumn("op", F.lit("update"))
    table, unmatched = apply_changes(rolxpermiso, valid, "idrol")
    return table, unmatched.select("idrol").distinct()


def delete_pairs(rolxpermiso: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove the listed (idrol, idpermiso) pairs; pairs that do not exist are reported."""
    key = ["idrol", "idpermiso"]
    pairs = pairs.select(*key).distinct()
    return rolxpermiso.join(pairs, key, "left_anti"), pairs.join(rolxpermiso.select(*key).distinct(), key, "left_anti")
