"""Reading and writing tables and order requests."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from mostrador.sources.schemas import ORDER_REQUEST, TABLES

CORRUPT = "_corrupt_record"


def load(spark: SparkSession, directory: str, table: str) -> DataFrame:
    """One shop table stored as Parquet under ``directory/table``."""
    return spark.read.schema(TABLES[table]).parquet(f"{directory}/{table}")


def append(df: DataFrame, directory: str, table: str) -> None:
    """Add rows to a table."""
    df.write.mode("append").parquet(f"{directory}/{table}")


def batch_owner(spark: SparkSession) -> str:
    """The id of the streaming query that a micro-batch belongs to; a new checkpoint gives a new one."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Store one micro-batch in a partition of its query and batch, so that a retried batch replaces itself only."""
    owner = batch_owner(df.sparkSession)
    df.write.mode("overwrite").parquet(f"{path}/query_id={owner}/batch_id={batch_id}", compression="zstd")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written within leaves no shuffle files behind; else they stay until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def read_batches(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """All rows stored by :func:`write_batch`, or those of all but this query's batches from ``before`` on.

    Rows that other queries stored count too: a replaced checkpoint starts a new query on the same store.
    """
    try:
        rows = spark.read.schema(f"{schema}, query_id STRING, batch_id BIGINT").parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)  # nothing stored yet
    if before is not None:
        rows = rows.where((F.col("query_id") != batch_owner(spark)) | (F.col("batch_id") < before))
    return rows.drop("query_id", "batch_id")


def commit_batch(spark: SparkSession, root: str, batch_id: int, parts: list[str]) -> None:
    """Record that all parts of a micro-batch have been stored below ``root``; written last."""
    write_batch(spark.createDataFrame([(p,) for p in parts], "part STRING").coalesce(1), f"{root}/commits", batch_id)


def committed(spark: SparkSession, root: str, part: str, schema: str, before: int | None = None) -> DataFrame:
    """The rows of one part that committed batches stored, see :func:`read_batches`.

    A batch without its record, because it is still being written or its driver was lost, is left out of every part.
    """
    try:
        rows = spark.read.schema(f"{schema}, query_id STRING, batch_id BIGINT").parquet(f"{root}/{part}")
        done = spark.read.schema("part STRING, query_id STRING, batch_id BIGINT").parquet(f"{root}/commits")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    if before is not None:
        done = done.where((F.col("query_id") != batch_owner(spark)) | (F.col("batch_id") < before))
    batches = done.select("query_id", "batch_id").distinct()
    return rows.join(batches, ["query_id", "batch_id"], "left_semi").drop("query_id", "batch_id")


def read_orders(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Order requests from JSON-lines files, read once or as a stream; see :func:`parse_orders`."""
    reader = spark.readStream if streaming else spark.read
    return parse_orders(reader.text(path))


def parse_orders(texts: DataFrame, column: str = "value") -> DataFrame:
    """Order requests from a text column, as files and message queues deliver them.

    Text that does not parse is kept in ``_corrupt_record``; blank lines are skipped.
    """
    parsed = F.from_json(F.col(column), f"{ORDER_REQUEST}, {CORRUPT} STRING",
                         {"columnNameOfCorruptRecord": CORRUPT})
    # Unpacked by a generator, so that later tests on the fields do not make Spark parse again.
    return texts.where(F.trim(column) != "").select(F.inline(F.array(parsed)))


def split_corrupt(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable requests, and the raw text of the unreadable ones."""
    bad = F.col(CORRUPT).isNotNull()
    return orders.where(~bad).drop(CORRUPT), orders.where(bad).select(CORRUPT)


def work_dir(spark: SparkSession) -> str:
    """A fresh folder for this run below the shared folder named in ``spark.checkpoint.dir``.

    Where that is unset, as in tests, a new local folder is taken under a local master; under any other master that is
    an error, as executors would not share it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("name a folder that every executor can reach in spark.checkpoint.dir")
        shared = tempfile.mkdtemp(prefix="mostrador-")
    return f"{shared.rstrip('/')}/mostrador-{uuid.uuid4().hex}"
