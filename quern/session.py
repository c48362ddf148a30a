"""Sessions and tables: the settings the engine's semantics rest on, and Parquet tables as views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The driver's tables.
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(app: str = "quern", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; what the caller sets wins."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.cteRecursionLevelLimit": "10000",
        "spark.sql.parquet.aggregatePushdown": "true",
    } | conf
    builder = SparkSession.builder.appName(app)
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> None:
    """Temporary views over the Parquet tables of a folder; a view reads only what a query asks of it."""
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
