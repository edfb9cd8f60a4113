"""What several operators of this package need: tables, the shared folder, components of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mostrador.sources.tables import work_dir

#: Document numbers up to which a list of them is broadcast, about 100 MB as a hash table.
BROADCAST_IDS = 4_000_000
#: Rows of a few numbers up to which a table is left for Spark to broadcast, about 25 MB.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; where that is unset, :func:`work_dir` allows a local one under a
    local master alone."""
    return work_dir(spark)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: later steps neither repeat its work nor
    depend on the executors that did it."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_shares(rows: DataFrame) -> DataFrame:
    """``rows`` for an equi-join that shuffles both sides, whatever Spark takes their size to be.

    Spark sizes rows that no shuffle has counted by the files below them: many rows that an explode makes of one, or values
    that repeat, take a hundred times that in the driver once broadcast.
    """
    return rows.hint("merge")


def unless_few(stored_rows: DataFrame) -> DataFrame:
    """Stored rows :func:`in_shares` where they are more than BROADCAST_ROWS."""
    return stored_rows if stored_rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else in_shares(stored_rows)


def plain_text(column: str | Column) -> Column:
    """The text of a row, empty where it is NULL."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def text_partitions(docs: DataFrame, column: str = "text", bytes_each: int = 8 << 20) -> int:
    """How many parts of about ``bytes_each`` bytes the texts of ``docs`` make."""
    total = docs.agg(F.sum(F.octet_length(column)).alias("n")).first().n or 0
    return int(total // bytes_each) + 1


def by_ids(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``rows`` joined (left_semi or left_anti) with stored ``ids`` on doc_id.

    The ids are counted: up to BROADCAST_IDS they go to the rows, beyond that both are shuffled.
    """
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, "doc_id", how)


def components(edges: DataFrame) -> DataFrame:
    """The smallest node that each end of an edge reaches: rows (node, component).

    ``edges`` has columns (a, b) in either direction. In each round a node takes the smallest label among its
    neighbours and then the label of that label, so long chains halve; each round is written to the shared folder.
    NULL ends link nothing; an empty table gives none.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select(
        "node", F.least("node", "near").alias("component")))
    many = labels.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS
    while True:
        labels = in_shares(labels) if many else labels
        around = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        nearer = labels.join(around, F.col("node") == F.col("a")).select(
            "node", "component", F.least("component", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("beyond"))
        moved = stored(nearer.join(in_shares(jump) if many else jump, "next").select(
            "node", F.least("next", "beyond").alias("component"),
            (F.least("next", "beyond") != F.col("component")).alias("moved")))
        labels = moved.select("node", "component")
        if moved.where("moved").isEmpty():
            return labels
