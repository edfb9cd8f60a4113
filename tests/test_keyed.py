"""Tables in buckets: what a batch rewrites, what readers see, what a lookup reads."""

import pytest

from mostrador.operators.changes import apply_changes
from mostrador.sources.keyed import KeyedTable
from mostrador.sources.versions import Versions, children

SCHEMA = "id BIGINT, name STRING"


@pytest.fixture
def table(spark, tmp_path):
    held = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "id", buckets=32)
    held.replace(spark.range(1000).selectExpr("id", "concat('n', id) AS name"))
    return held


def batch(spark, *rows):
    return spark.createDataFrame(rows, "id BIGINT, name STRING, op STRING, seq BIGINT")


def test_a_batch_rewrites_the_buckets_it_touches(spark, table, rows):
    before = table.read().cache()
    assert before.count() == 1000
    asked = batch(spark, (1, "x", "update", 1), (2, None, "delete", 2), (5000, "new", "insert", 3), (6000, None, "delete", 4),
                  (1, "y", "update", 5), (None, "nobody", "insert", 6), (3, "z", "insert", 7))
    expected, missing = apply_changes(before, asked, "id")
    old = table.folders()
    unmatched = table.apply(asked)
    assert rows(table.read()) == rows(expected)
    assert rows(unmatched, "id", "reason") == rows(missing, "id", "reason")
    changed = {b for b, v in table.folders().items() if old.get(b) != v}
    assert changed <= set(table.touched(asked)) and len(changed) <= 6
    written = [n for n in children(spark, f"{table.root}/data/v=1") if n.startswith("_bucket=")]
    assert len(written) == len(changed)


def test_readers_see_one_version_or_the_other(spark, table, rows, monkeypatch):
    first = table.read()
    whole = rows(first)
    write = Versions.write
    monkeypatch.setattr(Versions, "write", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        table.apply(batch(spark, (1, "x", "update", 1)))
    assert rows(table.read()) == whole  # files are there, the manifest is not
    monkeypatch.setattr(Versions, "write", write)
    table.apply(batch(spark, (1, "x", "update", 1)))
    assert rows(first) == whole and dict(rows(table.read()))[1] == "x"


def test_a_lookup_reads_the_buckets_asked(spark, table, rows):
    keys = spark.createDataFrame([(7,), (7,), (8,), (4000,), (None,)], "id BIGINT")
    got = table.lookup(keys)
    assert rows(got) == [(7, "n7"), (8, "n8")]
    assert len(got.inputFiles()) <= 4 < len(table.read().inputFiles())


def test_emptied_buckets_and_cleaning(spark, tmp_path, rows):
    held = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "id", buckets=4)
    assert held.read().count() == 0 and held.lookup(spark.range(3)).count() == 0
    held.replace(spark.createDataFrame([], SCHEMA))
    held.apply(batch(spark, (1, "a", "insert", 1), (2, "b", "insert", 2)))
    for i in range(4):
        held.apply(batch(spark, (1, f"a{i}", "update", 1)))
    held.apply(batch(spark, (2, None, "delete", 1)))
    held.clean()
    assert rows(held.read()) == [(1, "a3")]
    assert held.manifests.latest() == 6 and len(held.manifests.numbers()) == 3
