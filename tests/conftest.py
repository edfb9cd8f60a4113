import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from mostrador.session import tuned  # noqa: E402
from mostrador.sources.schemas import TABLES  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (tuned(SparkSession.builder).master("local[4]").appName("tests")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """Build a small DataFrame: ``make("users", "iduser, user", (1, "ana"))`` fills other columns with NULL."""
    def build(table, columns, *rows):
        types = dict(part.strip().split(" ", 1) for part in split_ddl(TABLES.get(table, table)))
        names = [c.strip() for c in columns.split(",")]
        full = [tuple(convert(types[name], dict(zip(names, row)).get(name)) for name in types) for row in rows]
        schema = ", ".join(f"{n} {'STRING' if castable(t) else t}" for n, t in types.items())
        df = spark.createDataFrame(full, schema)
        return df.selectExpr(*[f"cast(`{n}` as {t}) as `{n}`" for n, t in types.items()])
    return build


def split_ddl(ddl):
    parts, depth, start = [], 0, 0
    for i, c in enumerate(ddl):
        depth += c in "(<"
        depth -= c in ")>"
        if c == "," and depth == 0:
            parts.append(ddl[start:i])
            start = i + 1
    return parts + [ddl[start:]]


def castable(type_name):
    return type_name.strip().upper().split("(")[0] in ("DECIMAL", "DATE", "TIMESTAMP_NTZ")


def convert(type_name, value):
    return None if value is None else str(value) if castable(type_name) else value


@pytest.fixture
def rows():
    """Rows of a DataFrame as a sorted list of tuples, decimals as floats."""
    def collect(df, *columns):
        chosen = df.select(*columns) if columns else df
        return sorted((tuple(plain(v) for v in row) for row in chosen.collect()), key=repr)
    return collect


def plain(value):
    return float(value) if type(value).__name__ == "Decimal" else value
