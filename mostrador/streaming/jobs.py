"""Streaming forms of visit counting, order and comment intake, coupon redemption and payment state.

Every job stores what a micro-batch adds in a partition named by its query and batch. A batch that is tried
again after a lost executor or a restart replaces its own partition, so each request counts once; what other
queries stored before a checkpoint was replaced counts too. Nothing is kept in the driver between batches.

What has to be remembered for ever lies in Spark's state store (comments and redemptions, by key) or in small
versioned tables (coupon counters, payment marks), so a batch does not read what was stored before it. The state
grows with the keys: on a cluster use the RocksDB provider, as :data:`mostrador.session.SETTINGS` does.

Jobs take what has arrived and end, unless another ``trigger`` is given, such as ``{"processingTime": "1 minute"}``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from mostrador.functions.scalars import clock_seconds, month_text
from mostrador.operators.changes import rating_fits
from mostrador.operators.coupons import first_by_quota, grant_coupons, offers_of_users, suitable_offer
from mostrador.operators.pricing import (
    accepted_parts, checked_orders, delivery_rows, marks_state, merge_marks, payment_marks, payment_rejects, personalisation_rows,
    refused_keys)
from mostrador.sources.tables import (
    CORRUPT, batch_owner, committed, commit_batch, read_batches, shuffles_removed, split_corrupt, write_batch)
from mostrador.sources.versions import Versions, children, remove

ACCEPTED = "idsolicitud BIGINT, iduser BIGINT, idcupon BIGINT, codigo STRING, porcentaje {percent}, ts TIMESTAMP_NTZ"
GRANTS = "iduser BIGINT, idcupon BIGINT, codigo STRING"
ONCE = {"availableNow": True}
#: Batches after which the payment marks are merged into a new version.
MERGED_AFTER = 8
#: Order requests that are priced at a time, and into how many slices a batch is cut at most. Ids refused up to which Spark may
#: broadcast them.
SLICE, SLICES, FEW_IDS = 400_000, 4, 200_000


def daily_visits(visits: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Streaming visits per closed day; visits later than ``lateness`` are dropped.

    A watermark needs a zoned timestamp and day windows are cut in UTC, so the clock time is taken as UTC
    whatever the session zone is.
    """
    day = F.floor(F.unix_seconds(F.col("_day.start")) / 86400).cast("int")
    return (visits.select(F.timestamp_seconds(clock_seconds(F.col("ts"))).alias("ts"))
            .withWatermark("ts", lateness).groupBy(F.window("ts", "1 day").alias("_day"))
            .agg(F.count("*").alias("numero_de_visitas"))
            .select(F.date_from_unix_date(day).alias("dia"), "numero_de_visitas"))


def start_daily_visits(visits: DataFrame, out: str, checkpoint: str, lateness: str = "1 day",
                       trigger: dict | None = None) -> StreamingQuery:
    return (daily_visits(visits, lateness).writeStream.outputMode("append").format("parquet")
            .option("path", out).option("checkpointLocation", checkpoint).trigger(**(trigger or ONCE)).start())


def monthly_rollup(days: DataFrame) -> DataFrame:
    """Stored days to months. A month is not a fixed-length window, so this step is a batch query."""
    return (days.groupBy(F.trunc("dia", "month").alias("_month")).agg(
        F.sum("numero_de_visitas").alias("numero_de_visitas"))
        .select(month_text(F.col("_month")).alias("mes"), "numero_de_visitas"))


DAYS = "dia DATE, numero_de_visitas BIGINT"


def start_every_visit(visits: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Count visits per day for ever: a visit that comes late corrects its day.

    The state has one row per day, so it needs no watermark. Each batch stores the new counts of the days it changed;
    :func:`days_of_every_visit` reads the last one of each.
    """
    seconds = clock_seconds(F.col("ts"))
    days = visits.groupBy(F.date_from_unix_date(F.floor(seconds / 86400).cast("int")).alias("dia")).agg(
        F.count("*").alias("numero_de_visitas"))
    return (days.writeStream.outputMode("update").foreachBatch(lambda batch, batch_id: write_batch(batch, out, batch_id))
            .option("checkpointLocation", checkpoint).trigger(**(trigger or ONCE)).start())


def days_of_every_visit(spark: SparkSession, out: str) -> DataFrame:
    """Visits per day so far. Counts only grow, so the last one is the greatest; a replaced checkpoint counts its source anew."""
    return read_batches(spark, out, DAYS).groupBy("dia").agg(F.max("numero_de_visitas").alias("numero_de_visitas"))


def _each_batch(stream: DataFrame, handle, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    return (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or ONCE)).start())


def _kept(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` added to what lies at ``path``, which is given. Packed files take a fraction of cached rows that spill."""
    rows.write.mode("append").parquet(path, compression="zstd")
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def earlier_orders(requests: DataFrame, out: str, batch_id: int) -> DataFrame:
    """The ids of earlier committed orders (idcompra) that lie in the range of these requests' ids.

    The range is pushed to the Parquet scan, so files and row groups outside it are not read: where ids ascend, as
    issued ids do, a batch of new orders reads none of the old ones, and one sent again those beside it.
    """
    first, last = requests.agg(F.min("idcompra"), F.max("idcompra")).first()
    before = committed(requests.sparkSession, out, "orders", "idcompra BIGINT", before=batch_id)
    return before.where(F.col("idcompra").between(first, last))


def start_order_intake(orders: DataFrame, users: DataFrame, products: DataFrame, coupons: DataFrame, as_of,
                       out: str, checkpoint: str, rules: DataFrame | None = None,
                       user_cupones: DataFrame | None = None, cupones_usados: DataFrame | None = None,
                       trigger: dict | None = None) -> StreamingQuery:
    """Price order requests and store what a checkout writes.

    Below ``out``: orders, details, lines, rejects and corrupt; delivery and personalisation where the requests
    carry them; and, when ``rules`` are given with the claims and uses, the coupon grants. ``as_of`` may be a column
    of the requests, such as their arrival time, to judge coupons at each request's own time.

    A batch is stored below ``checkpoint`` while it is worked on, and priced in SLICES of the ids, so that the shuffle files of one
    slice are gone before the next begins.

    A request whose id an earlier batch has accepted is refused as ``repeated_order``, so one that is sent again makes no
    second order; see :func:`earlier_orders` for what is read for that. A batch counts once all its parts are there: read them by
    :func:`mostrador.sources.tables.committed`, which leaves out batches without their commit record.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark, work = batch.sparkSession, f"{checkpoint}/intake"
        remove(spark, work)  # of a try that was lost
        try:
            with shuffles_removed(spark):
                store(_kept(batch, f"{work}/requests"), batch_id, work)
        finally:
            remove(spark, work)

    def store(batch: DataFrame, batch_id: int, work: str) -> None:
        spark, good = batch.sparkSession, batch
        if CORRUPT in batch.columns:
            good, corrupt = split_corrupt(batch)
            write_batch(corrupt, f"{out}/corrupt", batch_id)
        before = earlier_orders(good, out, batch_id)
        again = good.select("idcompra").join(before, "idcompra", "left_semi").distinct()
        refused = _kept(refused_keys(good, taken=again), f"{work}/refused")
        if refused.count() > FEW_IDS:
            refused = refused.hint("merge")
        slices = max(1, min(SLICES, -(-good.count() // SLICE)))
        place = F.pmod(F.xxhash64("idcompra", F.lit(slices)), F.lit(slices))
        for i in range(slices):
            checked = _kept(checked_orders(good.where(place == i), users, products, coupons, as_of, refused), f"{work}/checked")
        remove(spark, f"{work}/requests")
        priced, lines, rejects = accepted_parts(checked)
        parts = {"lines": lines, "rejects": rejects}
        accepted = checked.where("reason IS NULL")
        if "detalleEntrega" in checked.columns:
            parts["delivery"] = delivery_rows(accepted)
        if "detallePersonalizacion" in checked.columns:
            parts["personalisation"] = personalisation_rows(accepted.withColumnRenamed("lineas", "productos"))
        if rules is not None:
            granted = committed(spark, out, "grants", GRANTS, before=batch_id)
            claims = user_cupones.select("iduser", "idcupon").unionByName(granted.select("iduser", "idcupon"))
            parts["grants"], parts["missing_grants"] = grant_coupons(lines, rules, coupons, claims, cupones_usados)
        write_batch(priced, f"{out}/orders", batch_id)
        stored = spark.read.schema(priced.schema).parquet(f"{out}/orders/query_id={batch_owner(spark)}/batch_id={batch_id}")
        parts["details"] = stored.select(F.col("idcompra").alias("iddetalle"), *[
            c for c in ("idcompra", "productos", "total", "codigoCupon") if c in stored.columns])
        for name, part in parts.items():
            write_batch(part, f"{out}/{name}", batch_id)
        commit_batch(spark, out, batch_id, ["orders", *parts])

    return _each_batch(orders, handle, checkpoint, trigger)


def start_comment_intake(comments: DataFrame, existing: DataFrame, out: str, checkpoint: str,
                         compat: bool = False, trigger: dict | None = None) -> StreamingQuery:
    """Keep one comment per product and user in ``out``/comments, the others in ``out``/rejects.

    The rule has no time limit: the state store remembers every pair that has a comment, so a batch is not compared with
    what was stored before, only with ``existing`` and what other queries stored. Of a pair that is new in a batch the
    earliest comment that fits counts, of equal ones the first read.
    """
    pair = ["idproducto", "iduser"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in comments.schema)
    names = comments.columns
    # Beside the rows, one row with nothing but its pair for each pair that no earlier batch had.
    opened = comments.where(rating_fits(compat)).select(*pair).dropDuplicates(pair).withColumn("_opened", F.lit(True))
    marked = comments.withColumn("_opened", F.lit(False)).unionByName(opened, allowMissingColumns=True)

    def handle(batch: DataFrame, batch_id: int) -> None:
        others = read_batches(batch.sparkSession, f"{out}/comments", schema, before=0)
        known = existing.select(*pair).unionByName(others.select(*pair)).distinct().withColumn("_before", F.lit(True))
        batch = batch.withColumn("_row", F.monotonically_increasing_id()).persist()
        new = batch.where("_opened").select(*pair).join(known, pair, "left_anti").select(
            *[F.col(c).alias(f"_{c}") for c in pair], F.lit(True).alias("_new"))
        same = F.expr(" and ".join(f"{c} <=> _{c}" for c in pair))  # a NULL product or user is one like any other
        rows = batch.where("not _opened").withColumn("_fits", rating_fits(compat)).join(new, same, "left").persist()
        first = rows.where("_fits and _new").groupBy(*pair).agg(
            F.min(F.struct("fecha", "idcomentario", "_row")).alias("_first")).select("_first._row", F.lit(True).alias("_won"))
        judged = rows.join(first, "_row", "left")
        try:
            reason = (F.when(~F.col("_fits"), "rating_out_of_range")
                      .when(F.col("_new").isNull(), "already_commented").otherwise("repeated_in_batch"))
            write_batch(judged.where("_won").select(*names), f"{out}/comments", batch_id)
            write_batch(judged.where("_won is null").select(*names, reason.alias("reason")), f"{out}/rejects", batch_id)
        finally:
            rows.unpersist()
            batch.unpersist()

    return _each_batch(marked, handle, checkpoint, trigger)


def start_redemption(requests: DataFrame, cupones: DataFrame, user_cupones: DataFrame, cupones_usados: DataFrame,
                     as_of, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Redeem coupons batch by batch; accepted requests go to ``out``.

    The state store holds each user's first suitable request for a coupon; later ones are not looked at again. Of the first ones of a batch
    those win that the coupon still has uses for, in order of arrival, counted by a table with one row per coupon, of
    which each batch writes the next version below ``checkpoint``. Stored requests are read only once, when a
    replaced checkpoint has to start from what other queries accepted.
    """
    percent = cupones.schema["porcentaje"].dataType.simpleString()
    schema = ACCEPTED.format(percent=percent)
    offers = offers_of_users(cupones, user_cupones, cupones_usados)
    asked = requests.join(offers, ["iduser", "codigo"]).withColumn("_offer", suitable_offer(as_of)).where("_offer IS NOT NULL")
    # One time for all rows of a batch: a key is new when it has been seen at no other.
    firsts = asked.withColumn("_now", F.current_timestamp()).groupBy("iduser", F.col("_offer.idcupon").alias("idcupon")).agg(
        F.min(F.struct("ts", "idsolicitud")).alias("_first"), F.min("_now").alias("_since"), F.max("_now").alias("_last"))

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        others = read_batches(spark, out, schema, before=0).select("iduser", "idcupon")
        new = (batch.where("_since = _last").select("iduser", "idcupon", "_first.*")
               .join(others, ["iduser", "idcupon"], "left_anti"))
        versions = Versions(spark, f"{checkpoint}/counts")
        last = versions.latest(before=batch_id)
        used = others.groupBy("idcupon").agg(F.count("*").alias("_used")) if last is None else versions.read(last)
        accepted = first_by_quota(new, cupones.join(used, "idcupon", "left").withColumn(
            "usos_actuales", F.col("usos_actuales") + F.coalesce("_used", F.lit(0))).drop("_used"))
        write_batch(accepted, out, batch_id)
        added = spark.read.schema(schema).parquet(f"{out}/query_id={batch_owner(spark)}/batch_id={batch_id}")
        versions.write(used.unionByName(added.groupBy("idcupon").agg(F.count("*").alias("_used"))).groupBy("idcupon").agg(
            F.sum("_used").alias("_used")), batch_id)

    return (firsts.writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or ONCE)).start())


def _marks_of(spark: SparkSession, root: str, upto: int | None = None) -> DataFrame | None:
    """The marks that one query has stored: its last version and what its batches have added since."""
    versions = Versions(spark, root)
    last = versions.latest(None if upto is None else upto + 1)
    added = [n for n in (int(c.removeprefix("batch_id=")) for c in children(spark, f"{root}/added"))
             if (last is None or n > last) and (upto is None or n <= upto)
             and "_SUCCESS" in children(spark, f"{root}/added/batch_id={n}")]
    parts = ([] if last is None else [versions.read(last)]) + [spark.read.parquet(f"{root}/added/batch_id={n}") for n in added]
    if not parts:
        return None
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return merge_marks(whole)


def start_payment_log(events: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Store payment events and, of each batch, what they mean for the state: the marks of :func:`payment_marks`.

    After MERGED_AFTER batches the marks are merged into a new version and those before the last one go. A batch that
    failed between its log and its marks is tried again and replaces both.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        root = f"{out}/_marks/{batch_owner(spark)}"
        batch = batch.persist()
        try:
            write_batch(batch, out, batch_id)
            payment_marks(batch).write.mode("overwrite").parquet(f"{root}/added/batch_id={batch_id}")
        finally:
            batch.unpersist()
        if (batch_id + 1) % MERGED_AFTER == 0:
            versions = Versions(spark, root)
            before = versions.latest(before=batch_id)
            versions.write(_marks_of(spark, root, batch_id), batch_id)
            for name in children(spark, f"{root}/added"):
                if before is not None and int(name.removeprefix("batch_id=")) <= before:
                    remove(spark, f"{root}/added/{name}")

    return _each_batch(events, handle, checkpoint, trigger)


def current_payments(spark: SparkSession, out: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """State of the payments, read off the stored marks, and refused events, read off the log against these."""
    stored = [_marks_of(spark, f"{out}/_marks/{query}") for query in children(spark, f"{out}/_marks")]
    log = read_batches(spark, out, schema)
    marks = payment_marks(log.where("false"))
    for found in stored:
        marks = marks if found is None else marks.unionByName(found)
    marks = merge_marks(marks)
    return marks_state(marks), payment_rejects(log, marks)
