"""Registry of the engine's queries: name -> callable, and name -> oracle SQL.

Most are statements of the dialect that the engine rewrites; an oracle says the same in the oracle's own SQL, with the
dialect's meaning where the two differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.engine import Engine
from quern.session import TABLES, views

REGISTRY: dict = {}
ORACLES: dict = {}
_engines: dict[int, Engine] = {}
_folders: dict[int, str] = {}


def engine(spark: SparkSession, sf_dir: str | None = None) -> Engine:
    """The session's engine, with the folder's tables as views."""
    key = id(spark)
    if key not in _engines:
        _engines[key] = Engine(spark)
    if sf_dir and _folders.get(key) != sf_dir:  # the views of a folder stay until another folder's replace them
        views(spark, sf_dir, TABLES[:8] + ["documents", "embeddings"])
        _folders[key] = sf_dir
    return _engines[key]


def naive(df: DataFrame) -> DataFrame:
    """Timestamps without a zone, as the tables have them."""
    return df.select(*[F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name) if f.dataType.typeName() == "timestamp" else F.col(f"`{f.name}`") for f in df.schema])


def query(name: str, sql: str | None = None):
    """Register a callable under `name`, with oracle SQL for the same rows where there is one."""

    def keep(f):
        REGISTRY[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def statement(name: str, sql: str, oracle: str | None = None, checked: bool = True) -> None:
    """Register a statement of the dialect; without `oracle` the oracle reads the same text."""
    query(name, (oracle or sql) if checked else None)(lambda spark, sf_dir: naive(engine(spark, sf_dir).query(sql)))


def statements(pairs: dict) -> None:
    for name, x in pairs.items():
        statement(name, *((x,) if isinstance(x, str) else x))


def _load() -> None:
    from quern.queries import changes, relational, scalars, series, vectors, windows  # noqa: F401


def queries() -> dict:
    _load()
    return REGISTRY


def oracle_sql() -> dict:
    _load()
    return ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return REGISTRY["flagship"](spark, sf_dir)
