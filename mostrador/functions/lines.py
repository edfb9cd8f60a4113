"""Order baskets stored as a JSON array of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LINE_FIELDS = ("idproducto", "cantidad", "talla", "tipo_personalizacion", "total_producto", "clave")

# Text fields keep both 3 and "3"; these are the types they are read as afterwards.
TYPED = {"idproducto": "bigint", "cantidad": "double", "total_producto": "decimal(20,6)"}


def parse_lines(basket: Column, fields=LINE_FIELDS) -> Column:
    """JSON text to an array of text structs holding only ``fields``. Unreadable text gives NULL.

    An element that is no object is a line of NULLs; only baskets with such an element are read element by element.
    """
    members = ", ".join(f"{name}: STRING" for name in fields)
    blank = F.struct(*[F.lit(None).cast("string").alias(name) for name in fields])
    one_by_one = F.transform(F.from_json(basket, "ARRAY<STRING>"),
                             lambda e: F.coalesce(F.from_json(e, f"STRUCT<{members}>"), blank))
    return F.coalesce(F.from_json(basket, f"ARRAY<STRUCT<{members}>>"), one_by_one)


def is_variant(df: DataFrame, column: str = "productos") -> bool:
    return df.schema[column].dataType.typeName() == "variant"


def as_variant(df: DataFrame, column: str = "productos") -> DataFrame:
    """``df`` with its JSON baskets parsed once into VARIANT, for storing.

    Text that is not JSON is kept as a VARIANT text, which is no list of lines and so counts as unreadable; NULL stays
    NULL.
    """
    return df.withColumn(column, F.coalesce(F.try_parse_json(F.col(column)), F.col(column).cast("variant")))


def elements(basket: Column) -> Column:
    """The elements of a VARIANT basket; a lone object is its only line, as in text. NULL for anything else."""
    alone = F.when(F.schema_of_variant(basket).startswith("OBJECT"), F.array(basket))
    return F.coalesce(F.try_variant_get(basket, "$", "ARRAY<VARIANT>"), alone)


def lines_of(df: DataFrame, fields=LINE_FIELDS, column: str = "productos") -> Column:
    """The lines of a basket column, whether it holds JSON text, VARIANT or is already an array.

    Of a VARIANT only ``fields`` are read, by their paths; numbers lose trailing zeros behind the point.
    """
    if is_variant(df, column):
        return F.transform(elements(F.col(column)), lambda e: F.struct(*[
            F.try_variant_get(e, f"$.{name}", "string").alias(name) for name in fields]))
    if df.schema[column].dataType.typeName() != "array":
        return parse_lines(F.col(column), fields)
    present = df.schema[column].dataType.elementType.fieldNames()
    return F.transform(F.col(column), lambda line: F.struct(*[
        (line[name] if name in present else F.lit(None)).cast("string").alias(name) for name in fields]))


def typed(line: Column, name: str) -> Column:
    value = line[name]
    return value.try_cast(TYPED[name]) if name in TYPED else value


def quantity(line: Column) -> Column:
    return line["cantidad"].try_cast("double")


def sum_quantities(lines: Column) -> Column:
    """Units over an array of lines; missing or unreadable quantities add nothing."""
    return F.aggregate(lines, F.lit(0.0), lambda total, line: total + F.coalesce(quantity(line), F.lit(0.0)))


def explode_lines(orders: DataFrame, fields=LINE_FIELDS, keep=None, outer: bool = False,
                  column: str = "productos") -> DataFrame:
    """One row per line with its 0-based ``pos`` and typed fields.

    ``keep`` names the order columns to carry (default: all but the basket). With ``outer``, orders
    without lines stay as one row whose ``pos`` is NULL, and ``readable`` and ``missing`` tell empty,
    unreadable and absent baskets apart.
    """
    keep = [c for c in orders.columns if c != column] if keep is None else list(keep)
    # Parsed in a step of its own, so that the JSON is read once however often the array is used. An inner
    # explode would make Spark test the parsed array in a filter too, and parse again for that.
    parsed = orders.select(*keep, F.col(column).isNull().alias("missing"),
                           lines_of(orders, fields, column).alias("_lines"))
    marks = [F.col("_lines").isNotNull().alias("readable"), F.col("missing")] if outer else []
    rows = parsed.select(*keep, *marks, F.posexplode_outer("_lines").alias("pos", "_line"))
    if not outer:
        rows = rows.where("pos IS NOT NULL")
    return rows.select(*keep, *(["readable", "missing"] if outer else []), "pos",
                       *[typed(F.col("_line"), name).alias(name) for name in fields])


def basket_problem(orders: DataFrame, column: str = "productos") -> Column:
    """Why a basket cannot be read, or NULL."""
    return (F.when(F.col(column).isNull(), "basket_missing")
            .when(lines_of(orders, ("idproducto",), column).isNull(), "basket_unreadable"))


def basket_rejects(orders: DataFrame, column: str = "productos") -> DataFrame:
    """Orders whose basket is missing or unreadable, or has a line without a product, with the reason.

    Reports count the other lines of the last kind.
    """
    nameless = F.exists(lines_of(orders, ("idproducto",), column), lambda line: line["idproducto"].isNull())
    orders = orders.withColumn("reason", F.coalesce(basket_problem(orders, column), F.when(nameless, "line_without_product")))
    return orders.where("reason IS NOT NULL")
