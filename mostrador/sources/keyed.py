"""Tables stored in buckets of their key: a change batch rewrites the buckets it touches, a lookup reads those it asks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mostrador.operators.changes import apply_changes
from mostrador.operators.lookups import lookup
from mostrador.sources.versions import Versions, children, remove


class KeyedTable:
    """A table below ``root`` whose rows lie in ``buckets`` folders by a hash of ``key``.

    Every batch writes the buckets that it touches anew, beside the old ones, and then a manifest that names the folder of
    each bucket. Readers follow the last manifest that is complete, so they see the table before a batch or after it. One
    writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str | list[str], buckets: int = 64):
        self.spark, self.root, self.schema, self.buckets = spark, root, schema, buckets
        self.key = [key] if isinstance(key, str) else list(key)
        self.manifests = Versions(spark, f"{root}/manifest")

    def bucket_of(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def folders(self) -> dict[int, int]:
        """The version in which each bucket with rows was written last: at most one entry per bucket."""
        last = self.manifests.latest()
        return {} if last is None else {r.bucket: r.version for r in self.manifests.read(last).collect()}

    def _read(self, folders: dict[int, int]) -> DataFrame:
        paths = [f"{self.root}/data/v={version}/_bucket={bucket}" for bucket, version in sorted(folders.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The whole table as of the last complete batch."""
        return self._read(self.folders())

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets that the keys lie in, at most ``buckets`` numbers."""
        return [r[0] for r in keys.select(self.bucket_of().alias("bucket")).distinct().collect()]

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys; other buckets are not read. Of several key columns all must match."""
        wanted = set(self.touched(keys))
        held = self._read({b: v for b, v in self.folders().items() if b in wanted})
        return lookup(held, keys, self.key[0]) if len(self.key) == 1 else held.join(keys.select(*self.key).distinct(), self.key, "left_semi")

    def _store(self, rows: DataFrame, touched: list[int] | None) -> None:
        last = self.manifests.latest()
        version = 0 if last is None else last + 1
        path = f"{self.root}/data/v={version}"
        (rows.withColumn("_bucket", self.bucket_of()).repartition("_bucket").sortWithinPartitions("_bucket", *self.key)
         .write.mode("overwrite").partitionBy("_bucket").parquet(path))
        written = {int(n.removeprefix("_bucket=")): version for n in children(self.spark, path) if n.startswith("_bucket=")}
        kept = {} if touched is None else {b: v for b, v in self.folders().items() if b not in set(touched)}
        named = self.spark.createDataFrame(sorted((kept | written).items()), "bucket INT, version INT")
        self.manifests.write(named.coalesce(1), version)

    def replace(self, rows: DataFrame) -> None:
        """Store the whole table."""
        self._store(rows, None)

    def apply(self, batch: DataFrame, op_col: str = "op", order_col: str = "seq") -> DataFrame:
        """Apply a change batch (see :func:`mostrador.operators.changes.apply_changes`) and give what matched nothing.

        Reads and writes only the buckets of the batch's keys. What is given is read off the old files, which stay
        until :meth:`clean`.
        """
        touched = self.touched(batch)
        folders = self.folders()
        held = self._read({b: folders[b] for b in touched if b in folders})
        table, unmatched = apply_changes(held, batch, self.key, op_col, order_col)
        self._store(table, touched)
        return unmatched

    def clean(self) -> None:
        """Remove the folders that no kept manifest names; not while someone still reads an older one."""
        used = {(r.version, r.bucket) for n in self.manifests.numbers() for r in self.manifests.read(n).collect()}
        for version in children(self.spark, f"{self.root}/data"):
            for bucket in children(self.spark, f"{self.root}/data/{version}"):
                if bucket.startswith("_bucket=") and (int(version.removeprefix("v=")), int(bucket.removeprefix("_bucket="))) not in used:
                    remove(self.spark, f"{self.root}/data/{version}/{bucket}")
