"""COPY ... FROM: delimited text and JSON files into a table's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, columns: list[tuple[str, str]], header: bool = True, delimiter: str = ",", null: str = "") -> DataFrame:
    """A delimited file as the columns asked for: by name with a header, else by place; text that isn't of a column's type is NULL."""
    raw = spark.read.option("header", header).option("sep", delimiter).option("nullValue", null).option("quote", '"').option("escape", '"').option("multiLine", True)
    if header:
        df = raw.csv(path)
        by = {c.lower(): c for c in df.columns}
        return df.select(*[(F.col(f"`{by[n.lower()]}`") if n.lower() in by else F.lit(None).cast("string")).try_cast(t).alias(n) for n, t in columns])
    df = raw.schema(", ".join(f"`{n}` string" for n, _ in columns)).csv(path)
    return df.select(*[F.col(f"`{n}`").try_cast(t).alias(n) for n, t in columns])


def read_json(spark: SparkSession, path: str, columns: list[tuple[str, str]]) -> DataFrame:
    """JSON lines, or one JSON array of objects, as the columns asked for."""
    lines = spark.read.text(path, wholetext=False)
    first = lines.filter(F.trim("value") != "").head()
    array = first is not None and first[0].lstrip().startswith("[")
    df = spark.read.option("multiLine", array).schema(", ".join(f"`{n}` {t}" for n, t in columns)).json(path)
    return df.select(*[F.col(f"`{n}`") for n, _ in columns])
