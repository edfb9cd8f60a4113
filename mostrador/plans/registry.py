"""Named queries over the shop tables, each with an equivalent SQL text where SQL can say it.

A query is registered with :func:`query`; its SQL is written on relational order lines, not on JSON
baskets, so that it checks the basket code instead of repeating it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from mostrador.plans.shop import ORACLE_TABLES, Shop


@dataclass(frozen=True)
class Query:
    run: Callable[[Shop], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register the decorated function of a Shop under ``name``."""
    def register(run):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(run, sql)
        return run
    return register


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and times as text, so that engines with other types show equal values."""
    def shown(field: T.StructField):
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, T.DateType):
            column = column.cast("string")
        elif isinstance(field.dataType, (T.TimestampNTZType, T.TimestampType)):
            # Not date_format, which would move zone-free times through the session zone.
            text = column.cast("string")
            column = F.when(text.contains("."), F.rpad(text, 26, "0")).otherwise(F.concat(text, F.lit(".000000")))
        return column.alias(field.name)
    return df.select(*[shown(field) for field in df.schema])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import mostrador.plans.queries  # noqa: F401  (fills QUERIES)

    def bind(entry: Query):
        return lambda spark, sf_dir: plain(entry.run(Shop(spark, sf_dir)))
    return {name: bind(entry) for name, entry in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    import mostrador.plans.queries  # noqa: F401
    return {name: f"WITH RECURSIVE {ORACLE_TABLES.strip()}\n{entry.sql.strip()}"
            for name, entry in QUERIES.items() if entry.sql}
