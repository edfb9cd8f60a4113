"""Small tables kept as numbered versions: a reader sees a whole version or the one before, never a mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: What Spark's writer leaves in a folder once all files are there.
DONE = "_SUCCESS"


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it does not exist."""
    files, where = _folder(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(where)) if files.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    files, where = _folder(spark, path)
    files.delete(where, True)


class Versions:
    """Versions of one table below ``root``, each in a folder ``v=<number>``.

    A version counts from the moment its writer has marked it done; one that a lost driver left half-written does not,
    and is written again by the next try. The last ``keep`` stay, for readers that have just looked.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        self.spark, self.root, self.keep = spark, root, keep

    def numbers(self) -> list[int]:
        found = (name.removeprefix("v=") for name in children(self.spark, self.root) if name.startswith("v="))
        return sorted(int(n) for n in found if DONE in children(self.spark, f"{self.root}/v={n}"))

    def latest(self, before: int | None = None) -> int | None:
        """The highest number, or the highest below ``before``."""
        return max((n for n in self.numbers() if before is None or n < before), default=None)

    def read(self, number: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/v={number}")

    def write(self, table: DataFrame, number: int) -> None:
        """Store a version; one that a batch tried before is replaced."""
        table.write.mode("overwrite").parquet(f"{self.root}/v={number}")
        for old in [n for n in self.numbers() if n < number][:-self.keep]:
            remove(self.spark, f"{self.root}/v={old}")
