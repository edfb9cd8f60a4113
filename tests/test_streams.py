"""Streams in several batches, with a late event, a restart and a repeated batch, against the batch operators."""

import pytest
from pyspark.sql import functions as F

from conftest import DATA
from mostrador.operators import changes, coupons, pricing
from mostrador.plans import queries
from mostrador.plans.shop import AS_OF, Shop
from mostrador.sources import tables
from mostrador.sources.versions import children
from mostrador.streaming import jobs


@pytest.fixture
def shop(spark):
    return Shop(spark, DATA)


def add(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def stream(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def ids(df, column):
    return sorted(r[0] for r in df.select(column).collect())


def batches(path, spark):
    return spark.read.parquet(path).select("batch_id").distinct().count()


def test_visits_late_event_and_restart(spark, make, shop, tmp_path, rows):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    visits = shop.visitas
    add(visits, source)

    def run():
        jobs.start_daily_visits(stream(spark, visits.schema, source), out, state).awaitTermination()
        return dict(rows(spark.read.schema("dia DATE, numero_de_visitas BIGINT").parquet(out)))

    by_day = dict(rows(visits.groupBy(F.col("ts").cast("date")).count()))
    last = visits.agg(F.max("ts")).first()[0]
    first_run = run()
    assert first_run == {d: n for d, n in by_day.items() if (last.date() - d).days >= 2}
    late = "2024-01-02 05:00:00"
    add(make("event_id BIGINT, ts TIMESTAMP_NTZ", "event_id, ts", (1, "2024-02-20 00:00:00"), (2, late)), source)
    assert run() == by_day  # the January days are closed now, and the late visit of 2 January is not in them
    days = spark.read.schema("dia DATE, numero_de_visitas BIGINT").parquet(out)
    assert rows(jobs.monthly_rollup(days)) == rows(changes.visit_counts(visits))


def test_order_intake_equals_batch(spark, shop, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    line = "ARRAY<STRUCT<idproducto: BIGINT, cantidad: INT, talla: STRING, tipo_personalizacion: STRING>>"
    requests = shop.order_requests.withColumn("productos", F.from_json("productos", line))
    requests.repartition(3).write.json(source)
    spark.createDataFrame([("{broken",)], "value STRING").coalesce(1).write.mode("append").text(source)

    def start():
        orders = tables.parse_orders(spark.readStream.option("maxFilesPerTrigger", 2).text(source))
        jobs.start_order_intake(orders, shop.users, shop.producto, shop.cupones, AS_OF, out, state).awaitTermination()

    start()
    start()  # nothing new: nothing changes
    expected = pricing.price_orders(shop.order_requests, shop.users, shop.producto, shop.cupones, AS_OF)
    for name, part in zip(("orders", "lines", "rejects"), expected):
        stored = spark.read.parquet(f"{out}/{name}").select(part.columns)
        assert stored.count() == part.count()
        assert stored.exceptAll(part).isEmpty()
    assert batches(f"{out}/orders", spark) >= 2
    assert ids(spark.read.parquet(f"{out}/corrupt"), tables.CORRUPT) == ["{broken"]


def test_a_checkout_writes_every_part(spark, make, tmp_path, rows):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    users = make("users", "iduser", (1,))
    goods = make("producto", "idproducto, p_final, clave", (10, 5, "One Piece"))
    offers = make("cupones", "idcupon, codigo, activo", (4, "ONEPIECE5", True))
    line = '{"idproducto": 10, "cantidad": 3, "tipo_personalizacion": "personalizado"}'
    for number, buyer in ((1, 1), (2, 1), (3, 9)):
        text = (f'{{"idcompra": {number}, "iduser": {buyer}, "fecha": "2024-01-01T10:00:00", "productos": [{line}], '
                f'"detalleEntrega": {{"pais": "MX"}}, "detallePersonalizacion": {{"lado_frontal": "x"}}}}')
        spark.createDataFrame([(text,)], "value STRING").coalesce(1).write.mode("append").text(source)
        jobs.start_order_intake(tables.read_orders(spark, source, streaming=True), users, goods, offers, AS_OF, out, state,
                                coupons.grant_rules(spark), make("user_cupones", "iduser"),
                                make("cupones_usados", "iduser")).awaitTermination()
    part = lambda name, *columns: rows(spark.read.parquet(f"{out}/{name}"), *columns)
    assert part("orders", "idcompra", "total") == [(1, 15.0), (2, 15.0)]
    assert part("rejects", "idcompra", "reason") == [(3, "unknown_user")]
    assert part("delivery", "idcompra", "pais") == [(1, "MX"), (2, "MX")]
    assert part("personalisation", "idcompra", "lado_frontal", "foto") == [(1, "x", ""), (2, "x", "")]
    assert part("grants", "iduser", "idcupon", "batch_id") == [(1, 4, 0)]


def test_comment_intake_over_batches(spark, make, tmp_path, rows):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    review = "idcomentario BIGINT, idproducto BIGINT, iduser BIGINT, comentario STRING, calificacion DECIMAL(3,1), fecha TIMESTAMP_NTZ"
    columns = "idcomentario, idproducto, iduser, calificacion, fecha"
    existing = make("comentarios", "idproducto, iduser", (9, 9))
    every = [[(1, 1, 1, 5, "2024-01-01"), (2, 9, 9, 5, "2024-01-01"), (3, 1, 2, 7, "2024-01-01")],
             [(4, 1, 1, 4, "2024-01-02"), (5, 1, 2, 4, "2024-01-02")],
             [(6, 1, 2, 4, "2024-01-03"), (7, 2, 2, 4, "2024-01-03"), (8, 2, 2, 4, "2024-01-03")]]
    for batch in every:
        add(make(review, columns, *batch), source)
        jobs.start_comment_intake(stream(spark, review, source), existing, out, state).awaitTermination()
    assert ids(spark.read.parquet(f"{out}/comments"), "idcomentario") == [1, 5, 7]
    ok, _ = changes.ingest_comments(spark.read.schema(review).parquet(source), existing)
    assert ids(ok, "idcomentario") == [1, 5, 7]
    assert dict(rows(spark.read.parquet(f"{out}/rejects"), "idcomentario", "reason")) == {
        2: "already_commented", 3: "rating_out_of_range", 4: "already_commented", 6: "already_commented",
        8: "repeated_in_batch"}


def test_redemption_over_batches_equals_batch(spark, shop, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    parts = [shop.canjes.where(c) for c in ("ts < '2024-01-08'", "ts >= '2024-01-08' AND ts < '2024-01-15'", "ts >= '2024-01-15'")]

    def run():
        jobs.start_redemption(stream(spark, shop.canjes.schema, source), shop.cupones, shop.user_cupones,
                              shop.cupones_usados, AS_OF, out, state).awaitTermination()
    for part in parts:
        add(part, source)
        run()
    expected, _, _ = coupons.redeem(shop.canjes, shop.cupones, shop.user_cupones, shop.cupones_usados, AS_OF)
    assert ids(spark.read.parquet(out), "idsolicitud") == ids(expected, "idsolicitud")
    assert batches(out, spark) == 3


def test_a_new_checkpoint_keeps_the_cap_and_the_store(spark, make, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    asks = "idsolicitud BIGINT, iduser BIGINT, codigo STRING, ts TIMESTAMP_NTZ"
    offers = make("cupones", "idcupon, codigo, porcentaje, activo, fecha_expiracion, usos_maximos, usos_actuales",
                  (4, "A", 10, True, "2025-01-01 00:00:00", 2, 0))
    claims = make("user_cupones", "iduser, idcupon", *[(u, 4) for u in range(1, 6)])

    def run(state, *users):
        add(make(asks, "idsolicitud, iduser, codigo, ts", *[(u, u, "A", f"2024-01-0{u} 00:00:00") for u in users]), source)
        jobs.start_redemption(stream(spark, asks, source), offers, claims, make("cupones_usados", "iduser"), "2024-01-20",
                              out, str(tmp_path / state)).awaitTermination()
    run("first", 1)
    run("first", 2)
    run("second", 4)
    assert ids(spark.read.parquet(out), "iduser") == [1, 2]


def test_a_repeated_batch_counts_once(spark, make, tmp_path, rows):
    path = str(tmp_path / "log")
    schema = "mes STRING, numero_de_visitas BIGINT"
    assert tables.read_batches(spark, path, schema).count() == 0
    for batch_id, count in ((0, 5), (1, 6), (1, 6)):
        tables.write_batch(make("visitas_por_mes", "mes, numero_de_visitas", ("2024-01", count)), path, batch_id)
    assert rows(tables.read_batches(spark, path, schema)) == [("2024-01", 5), ("2024-01", 6)]
    assert rows(tables.read_batches(spark, path, schema, before=1)) == [("2024-01", 5)]


def test_payments_over_batches(spark, shop, tmp_path, rows):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for status in ("CREATED", "COMPLETED", "DECLINED"):
        add(shop.pagos.where(F.col("status") == status), source)
        jobs.start_payment_log(stream(spark, shop.pagos.schema, source), out, state).awaitTermination()
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in shop.pagos.schema)
    for got, expected in zip(jobs.current_payments(spark, out, schema), pricing.payment_state(shop.pagos)):
        assert rows(got) == rows(expected)


def test_load_append_and_orders_as_text(spark, make, tmp_path, rows):
    users = make("users", "iduser, user, created_at", (1, "ana", "2024-01-01"))
    tables.append(users, str(tmp_path), "users")
    tables.append(users, str(tmp_path), "users")
    assert rows(tables.load(spark, str(tmp_path), "users"), "iduser", "user") == [(1, "ana")] * 2
    texts = spark.createDataFrame([
        ('{"idcompra": 1, "productos": [{"idproducto": "7", "cantidad": 2}, {"idproducto": 8}], "detalleEntrega": {"pais": "MX"}}',),
        ("{oops",), (" ",)], "value STRING")
    good, bad = tables.split_corrupt(tables.parse_orders(texts))
    assert rows(good.selectExpr("idcompra", "size(productos)", "productos[0].cantidad", "detalleEntrega.pais")) == [(1, 2, "2", "MX")]
    assert rows(bad) == [("{oops",)]
    texts.coalesce(1).write.text(str(tmp_path / "orders"))
    good, bad = tables.split_corrupt(tables.read_orders(spark, str(tmp_path / "orders")))
    assert ids(good, "idcompra") == [1] and rows(bad) == [("{oops",)] and bad.count() == 1


REVIEW = "idcomentario BIGINT, idproducto BIGINT, iduser BIGINT, comentario STRING, calificacion DECIMAL(3,1), fecha TIMESTAMP_NTZ"
EVENT = ("order_id STRING, status STRING, iduser BIGINT, total DECIMAL(14,2), currency STRING, description STRING, details STRING, "
         "ts TIMESTAMP_NTZ")


def test_comments_are_remembered_without_the_store(spark, make, tmp_path, rows):
    """The second run writes elsewhere, so what it refuses it knows from its state; a new checkpoint knows the store."""
    source, columns = str(tmp_path / "in"), "idcomentario, idproducto, iduser, comentario, calificacion, fecha"
    existing = make("comentarios", "idproducto, iduser")

    def run(out, state, *batch):
        add(make(REVIEW, columns, *batch), source)
        jobs.start_comment_intake(stream(spark, REVIEW, source), existing, str(tmp_path / out), str(tmp_path / state)).awaitTermination()
        read = lambda part: spark.read.parquet(str(tmp_path / out / part))
        return ids(read("comments"), "idcomentario"), dict(rows(read("rejects"), "idcomentario", "reason"))
    assert run("a", "first", (2, 1, 1, "x", 5, "2024-01-02"), (1, 1, 1, "y", 5, "2024-01-02"), (3, 1, None, "z", 4, None)) == (
        [1, 3], {2: "repeated_in_batch"})
    assert run("b", "first", (4, 1, 1, None, 4, "2023-01-01"), (5, 2, 1, "w", 3, "2024-01-03 00:00:00.5"), (6, 2, 1, "w", 3, "2024-01-03")) == (
        [6], {4: "already_commented", 5: "repeated_in_batch"})
    kept, refused = run("a", "second", (7, 2, 1, "new", 5, "2024-01-05"))  # all files again under a new checkpoint
    assert kept == [1, 3, 3, 6] and refused[1] == refused[4] == "already_commented"  # a NULL user matches no stored one


def test_redemption_counts_without_the_store(spark, make, tmp_path):
    source, asks = str(tmp_path / "in"), "idsolicitud BIGINT, iduser BIGINT, codigo STRING, ts TIMESTAMP_NTZ"
    offers = make("cupones", "idcupon, codigo, porcentaje, activo, fecha_expiracion, usos_maximos, usos_actuales",
                  (4, "A", 10, True, "2025-01-01 00:00:00", 3, 0), (5, "A", 10, True, "2025-01-01 00:00:00", 9, 0))
    claims = make("user_cupones", "iduser, idcupon", *[(u, 4) for u in range(1, 7)], (6, 5), (7, 5))

    def run(out, *requests):
        add(make(asks, "idsolicitud, iduser, codigo, ts", *requests), source)
        jobs.start_redemption(stream(spark, asks, source), offers, claims, make("cupones_usados", "iduser"), "2024-01-20",
                              str(tmp_path / out), str(tmp_path / "state")).awaitTermination()
        return sorted((r.idsolicitud, r.idcupon) for r in spark.read.parquet(str(tmp_path / out)).collect())
    assert run("a", (2, 1, "A", "2024-01-02"), (1, 1, "A", "2024-01-01"), (3, 9, "A", "2024-01-01")) == [(1, 4)]
    assert run("b", (4, 1, "A", "2024-01-03"), (5, 2, "A", "2024-01-04"), (6, 7, "A", "2024-01-04")) == [(5, 4), (6, 5)]
    assert run("c", (7, 4, "A", "2024-01-06"), (8, 3, "A", "2024-01-05"), (9, 6, "A", "2024-01-07")) == [(8, 4)]


def test_a_redemption_batch_that_failed_is_tried_again(spark, make, tmp_path, monkeypatch):
    source, asks = str(tmp_path / "in"), "idsolicitud BIGINT, iduser BIGINT, codigo STRING, ts TIMESTAMP_NTZ"
    offers = make("cupones", "idcupon, codigo, porcentaje, activo, fecha_expiracion, usos_maximos, usos_actuales",
                  (4, "A", 10, True, "2025-01-01 00:00:00", 2, 0))
    claims = make("user_cupones", "iduser, idcupon", *[(u, 4) for u in range(1, 7)])

    def run(*users):
        if users:
            add(make(asks, "idsolicitud, iduser, codigo, ts", *[(u, u, "A", f"2024-01-0{u}") for u in users]), source)
        jobs.start_redemption(stream(spark, asks, source), offers, claims, make("cupones_usados", "iduser"), "2024-01-20",
                              str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    write = jobs.Versions.write
    monkeypatch.setattr(jobs.Versions, "write", lambda *_: 1 / 0)
    with pytest.raises(Exception):
        run(1)
    monkeypatch.setattr(jobs.Versions, "write", write)
    run()
    run(2, 3)
    assert ids(spark.read.parquet(str(tmp_path / "out")), "iduser") == [1, 2]


def test_payment_marks_are_merged_and_survive_a_failure(spark, make, tmp_path, rows, monkeypatch):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    monkeypatch.setattr(jobs, "MERGED_AFTER", 2)
    columns, every = "order_id, status, iduser, total, ts", [
        [("a", "CREATED", 1, 5, "2024-01-01"), ("a", "CREATED", 1, 5, "2024-01-01"), ("b", "COMPLETED", 1, 5, "2024-01-01")],
        [("a", "COMPLETED", 1, 6, "2024-01-02"), ("c", None, 1, 6, "2024-01-02")], [("a", "CREATED", 1, 4, "2023-12-31")],
        [("b", "CREATED", 1, 7, "2024-01-03")], [("a", "COMPLETED", 1, 8, "2024-01-05"), ("d", "CREATED", None, 1, None)]]

    def run():
        jobs.start_payment_log(stream(spark, EVENT, source), out, state).awaitTermination()

    marks = jobs.payment_marks
    for i, batch in enumerate(every):
        add(make(EVENT, columns, *batch), source)
        if i in (1, 3):  # the log of the batch is stored, its marks are not
            monkeypatch.setattr(jobs, "payment_marks", lambda _: 1 / 0)
            with pytest.raises(Exception):
                run()
            monkeypatch.setattr(jobs, "payment_marks", marks)
        run()
        log = make(EVENT, columns, *[r for b in every[:i + 1] for r in b])
        for got, expected in zip(jobs.current_payments(spark, out, EVENT), pricing.payment_state(log)):
            assert rows(got) == rows(expected)
    (query,) = jobs.children(spark, f"{out}/_marks")
    assert jobs.children(spark, f"{out}/_marks/{query}") == ["added", "v=1", "v=3"]
    assert "batch_id=0" not in jobs.children(spark, f"{out}/_marks/{query}/added")


def test_an_order_sent_again_and_a_batch_without_its_record(spark, make, tmp_path, rows, monkeypatch):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    users, goods = make("users", "iduser", (1,)), make("producto", "idproducto, p_final, clave", (10, 5, "x"))

    def run(*numbers):
        for n in numbers:
            text = f'{{"idcompra": {n}, "iduser": 1, "fecha": "2024-01-01T10:00:00", "productos": [{{"idproducto": 10, "cantidad": 3}}]}}'
            spark.createDataFrame([(text,)], "value STRING").coalesce(1).write.mode("append").text(source)
        jobs.start_order_intake(tables.read_orders(spark, source, streaming=True), users, goods, make("cupones", "idcupon"),
                                AS_OF, out, state).awaitTermination()

    def read(part, schema):
        return rows(tables.committed(spark, out, part, schema))
    run(1)
    commit = jobs.commit_batch
    monkeypatch.setattr(jobs, "commit_batch", lambda *_: 1 / 0)
    with pytest.raises(Exception):
        run(1, 2)
    assert read("orders", "idcompra BIGINT") == read("lines", "idcompra BIGINT") == [(1,)] and read("rejects", "idcompra BIGINT") == []
    monkeypatch.setattr(jobs, "commit_batch", commit)
    run()
    assert read("orders", "idcompra BIGINT, total DECIMAL(16,2)") == [(1, 15.0), (2, 15.0)]
    assert read("rejects", "idcompra BIGINT, reason STRING") == [(1, "repeated_order")]
    assert read("lines", "idcompra BIGINT") == [(1,), (2,)]


def test_only_ids_beside_those_of_the_batch_are_read(spark, tmp_path):
    """20 batches of ascending ids: row groups of other ids are skipped, so what is read of the store stays flat."""
    out, ids = str(tmp_path / "out"), lambda *n: spark.createDataFrame([(i,) for i in n], "idcompra BIGINT")
    for batch in range(20):
        tables.write_batch(ids(*range(batch * 100, batch * 100 + 100)).coalesce(1), f"{out}/orders", batch)
        tables.commit_batch(spark, out, batch, ["orders"])

    def read(found):
        """Rows that the scan of the orders has read, by Spark's own count, which adds up over the runs of a plan."""
        tried = found._jdf.queryExecution().executedPlan()
        tried.executeCollect()
        plan, counts, todo = tried.toString(), [], [tried]
        while todo:
            node = todo.pop()
            if node.nodeName().startswith("AdaptiveSparkPlan"):
                todo.append(node.executedPlan())
            elif node.nodeName().endswith("QueryStage"):
                todo.append(node.plan())
            elif "Scan" in node.nodeName() and "idcompra" in node.toString():
                counts.append(node.metrics().apply("numOutputRows").value())
            todo.extend(node.children().apply(i) for i in range(node.children().size()))
        assert "GreaterThanOrEqual(idcompra" in plan and "LessThanOrEqual(idcompra" in plan
        return sum(counts)
    for batch, asked, expected, most in ((20, (2000, 2001), [], 0), (20, (1205, 1207), [1205, 1206, 1207], 100), (5, (405, 501), list(range(405, 500)), 200)):
        assert sorted(r[0] for r in jobs.earlier_orders(ids(*asked), out, batch).collect()) == expected
        assert read(jobs.earlier_orders(ids(*asked), out, batch)) <= most
    assert jobs.earlier_orders(ids(), out, 20).isEmpty() and jobs.earlier_orders(ids(None), out, 20).isEmpty()


def test_every_visit_counts_however_late(spark, make, tmp_path, rows):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    visit, every = "event_id BIGINT, ts TIMESTAMP_NTZ", [
        [(1, "2024-01-05 23:59:59"), (2, "2024-01-06 00:00:00")], [(3, "2024-03-01"), (4, "2024-01-05 00:00:00")], [(5, "2023-01-01")]]
    for batch in every:
        add(make(visit, "event_id, ts", *batch), source)
        jobs.start_every_visit(stream(spark, visit, source), out, state).awaitTermination()
    seen = make(visit, "event_id, ts", *[v for b in every for v in b])
    assert rows(jobs.days_of_every_visit(spark, out)) == rows(seen.groupBy(F.col("ts").cast("date").alias("dia")).count())
    assert rows(jobs.monthly_rollup(jobs.days_of_every_visit(spark, out))) == rows(changes.visit_counts(seen))


@pytest.fixture
def all_partitions(spark):
    """Small shuffles keep their partitions, so that the tables of the tests are cut as large ones are."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def sources(spark, out):
    """The files that a query wrote as its stream's source, beside its outputs."""
    return [name for name in children(spark, f"{out.removesuffix('/out')}/in") if name.startswith("part-")]


def test_orders_sent_again_are_written_by_many_tasks(spark, shop, all_partitions):
    out = queries._sent_again(shop)
    assert len(sources(spark, out)) > 2 * 2
    assert batches(f"{out}/commits", spark) == 2


def test_sources_of_streams_are_written_by_many_tasks(spark, make, tmp_path, rows):
    rows_ = make(REVIEW, "idcomentario, idproducto, iduser, calificacion, fecha", *[
        (i, i % 7, i % 5, 5, f"2024-01-{1 + i % 28:02}") for i in range(200)]).repartition(4)
    existing, out = make("comentarios", "idproducto, iduser"), str(tmp_path / "out")
    stream = queries._stored(rows_, str(tmp_path / "in"))
    assert len(sources(spark, out)) == 4
    jobs.start_comment_intake(stream, existing, out, str(tmp_path / "state")).awaitTermination()
    assert batches(f"{out}/comments", spark) == 1
    expected = ids(changes.ingest_comments(rows_, existing)[0], "idcomentario")
    assert ids(spark.read.parquet(f"{out}/comments"), "idcomentario") == expected
    out = str(tmp_path / "parts" / "out")
    queries._in_order(rows_, "fecha", str(tmp_path / "parts" / "in"), lambda stream: jobs.start_comment_intake(
        stream, existing, out, str(tmp_path / "parts" / "state")))
    assert len(sources(spark, out)) == 3 * 4
    assert spark.read.parquet(f"{out}/rejects").select("batch_id").distinct().count() == 3
    assert ids(spark.read.parquet(f"{out}/comments"), "idcomentario") == expected


def test_of_equal_comments_one_counts(spark, make, tmp_path, rows):
    """Rows repeated in full, keys of NULL, a comment of an older store and one that fits in no batch."""
    source, columns = str(tmp_path / "in"), "idcomentario, idproducto, iduser, comentario, calificacion, fecha"
    out, existing = str(tmp_path / "out"), make("comentarios", "idproducto, iduser", (9, 9), (None, 8))
    for batch in ([(1, 1, 1, "x", 5, "2024-01-02")] * 3 + [(2, None, 8, "y", 4, None)] * 2 + [(3, 9, 9, "z", 4, None), (4, 2, 2, "w", 7, None)],
                  [(2, None, 8, "y", 4, None), (1, 1, 1, "x", 9, "2024-01-02"), (5, 2, 2, "w", 3, "2024-01-03"), (None, 2, 2, "w", 3, "2024-01-02")]):
        make(REVIEW, columns, *batch).write.mode("append").parquet(source)
        jobs.start_comment_intake(spark.readStream.schema(REVIEW).parquet(source), existing, out, str(tmp_path / "state")).awaitTermination()
    read = lambda part: spark.read.parquet(f"{out}/{part}")
    assert rows(read("comments"), "idcomentario", "batch_id") == [(1, 0), (2, 0), (None, 1)]
    assert rows(read("rejects"), "idcomentario", "reason", "batch_id") == sorted([
        (1, "repeated_in_batch", 0), (1, "repeated_in_batch", 0), (2, "repeated_in_batch", 0), (3, "already_commented", 0),
        (4, "rating_out_of_range", 0), (2, "already_commented", 1), (1, "rating_out_of_range", 1), (5, "repeated_in_batch", 1)], key=repr)


def test_payments_come_in_two_batches_of_many_files(spark, shop, tmp_path, rows):
    out = str(tmp_path / "out")
    stream = queries._stored_in_two(shop.pagos, str(tmp_path / "in"))
    assert len(sources(spark, out)) == 4
    jobs.start_payment_log(stream, out, str(tmp_path / "state")).awaitTermination()
    sizes = [r["count"] for r in spark.read.parquet(out).groupBy("batch_id").count().orderBy("batch_id").collect()]
    assert len(sizes) == 2 and sizes[0] > sizes[1] and sum(sizes) == shop.pagos.count()


def test_order_requests_are_written_by_many_tasks(spark, shop, all_partitions):
    out = queries._intake(shop)
    assert len(sources(spark, out)) > 3
    assert batches(f"{out}/commits", spark) == 1


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


@pytest.mark.parametrize("start", [queries._intake, queries._sent_again])
def test_order_intake_leaves_nothing_but_its_parts(spark, shop, start, monkeypatch):
    """The requests are packed; shuffle files and what is kept while a batch is worked on go with it."""
    monkeypatch.setattr(jobs, "SLICE", 700)
    before = shuffle_files(spark)
    out = start(shop)
    work = out.removesuffix("/out")
    assert not shuffle_files(spark) - before
    assert "intake" not in jobs.children(spark, f"{work}/state")
    assert {n.rsplit(".", 1)[1] for n in jobs.children(spark, f"{work}/in") if n.startswith("part-")} == {"gz"}
    expected = pricing.price_orders(shop.order_requests, shop.users, shop.producto, shop.cupones, AS_OF)
    for name, part in zip(("orders", "lines"), expected):
        stored = spark.read.parquet(f"{out}/{name}").select(part.columns)
        assert stored.count() == part.count() and stored.exceptAll(part).isEmpty()


def test_slices_refuse_the_same_requests(spark, make, tmp_path, rows, monkeypatch):
    """Ids that repeat, that are missing and that came before, when every slice has a few requests."""
    monkeypatch.setattr(jobs, "SLICE", 3)
    monkeypatch.setattr(jobs, "FEW_IDS", 0)
    users, goods = make("users", "iduser", (1,)), make("producto", "idproducto, p_final, clave", (10, 5, "x"))
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for numbers in ([*range(6), 3, 5, 5, "null", "null"], [2, *range(4, 9), 8, "null"]):
        texts = [(f'{{"idcompra": {n}, "iduser": 1, "productos": [{{"idproducto": 10, "cantidad": 1}}]}}',) for n in numbers]
        spark.createDataFrame(texts, "value STRING").coalesce(1).write.mode("append").text(source)
        jobs.start_order_intake(tables.read_orders(spark, source, streaming=True), users, goods, make("cupones", "idcupon"),
                                AS_OF, out, state).awaitTermination()
    read = lambda part, *columns: rows(spark.read.parquet(f"{out}/{part}"), *columns)
    assert read("orders", "idcompra", "batch_id") == sorted([(0, 0), (1, 0), (2, 0), (4, 0), (5, 1), (6, 1), (7, 1)])
    assert read("details", "iddetalle") == [(n,) for n in (0, 1, 2, 4, 5, 6, 7)]
    refused = [(3, 0)] * 2 + [(5, 0)] * 3 + [(2, 1), (4, 1), (8, 1), (8, 1)]
    assert read("rejects", "idcompra", "batch_id", "reason") == sorted(
        [(*r, "repeated_order") for r in refused] + [(None, b, "missing_order_id") for b in (0, 0, 1)], key=repr)
