"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def moment(value) -> Column:
    """A point in time given as text, date, datetime or column, free of any session zone."""
    column = value if isinstance(value, Column) else F.lit(str(value))
    return column.cast("timestamp_ntz")


def clock_seconds(ts: Column) -> Column:
    """Whole seconds from 1970 to a zone-free time, by the clock: no session zone or summer time enters."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def month_start(column: str) -> Column:
    """First day of the month. Cheaper to group by than formatted text; format after grouping."""
    return F.trunc(F.col(column).cast("date"), "month")


def month_text(first_day: Column) -> Column:
    return F.date_format(first_day, "yyyy-MM")


def month_label(first_day: Column) -> Column:
    return F.date_format(first_day, "MMMM yyyy")


def complete_years(birth: Column, today: Column) -> Column:
    """Birthdays passed. Someone born on 29 February turns a year older on 1 March of a common year."""
    before_birthday = (F.month(today) * 100 + F.day(today)) < (F.month(birth) * 100 + F.day(birth))
    return F.year(today) - F.year(birth) - before_birthday.cast("int")


def ratio(total: Column, count: Column, digits: int) -> Column:
    """``total / count`` in decimal arithmetic, rounded half up; NULL when count is 0."""
    return F.round(F.try_divide(total.cast("decimal(20,2)"), count.cast("decimal(18,0)")), digits).cast(
        f"decimal(14,{digits})")


def percent(part: Column, whole: Column, digits: int) -> Column:
    """``part`` as a percentage of ``whole``. Refunds may bring the whole near 0 and a share far beyond 100."""
    return F.round(F.try_divide(part, whole) * 100, digits).try_cast(f"decimal(38,{digits})")


def exact_decimal(column: Column, kind: str) -> Column:
    """A number as a decimal type; NULL where that would round it or does not fit."""
    as_decimal = column.try_cast(kind)
    return F.when(as_decimal.cast("double") == column.try_cast("double"), as_decimal)


def contains_text(column: Column, text: str, raw_pattern: bool = False) -> Column:
    """Case-insensitive substring test; wildcards in ``text`` are literal unless ``raw_pattern``."""
    if not raw_pattern:
        for mark in ("\\", "%", "_"):
            text = text.replace(mark, "\\" + mark)
    return column.ilike(f"%{text}%")


def is_set(column: Column) -> Column:
    """Neither NULL nor empty text."""
    return F.coalesce(column != "", F.lit(False))


def under_collation(column: Column, collation: str | None) -> Column:
    """Compare text under a collation such as ``UNICODE_CI_AI``; binary when None."""
    return F.collate(column, collation) if collation else column
