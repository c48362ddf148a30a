"""Exact nearest neighbours of a stated set of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import fn

#: Queries that travel together, and base rows that they meet in one place, about.
QUERIES, BASE = 256, 8192


def knn_join(queries: DataFrame, base: DataFrame, k: int, metric: str = "VEC_DISTANCE_L2", id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """q, <id>, r: the k nearest base rows of each query row but itself, ties to the smaller id.

    Blocks of queries meet blocks of base rows by an equality join on the base block, and a partial rank limit
    keeps k rows a query and task before the shuffle. A query row travels once to each base block, a base row never.
    """
    parts = max(1, -(-base.count() // BASE))
    groups = max(1, -(-queries.count() // QUERIES))
    asked = queries.select(F.struct(F.col(id_column).alias("q"), F.col(column).alias("v")).alias("x"), F.pmod(F.xxhash64(id_column), F.lit(groups)).alias("g"))
    asked = asked.groupBy("g").agg(F.collect_list("x").alias("xs")).select("xs", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("b"))
    rows = base.select(F.col(id_column).alias("_i"), F.col(column).alias("_v"), F.pmod(F.xxhash64(id_column), F.lit(parts)).alias("b"))
    pairs = rows.join(asked, "b").select("_i", "_v", F.explode("xs").alias("x")).select("_i", "_v", F.col("x.q").alias("q"), F.col("x.v").alias("_q")).filter("_i <> q")
    near = F.row_number().over(Window.partitionBy("q").orderBy(F.round(fn(metric, "_q", "_v"), 9), "_i"))
    return pairs.withColumn("r", near.cast("bigint")).filter(F.col("r") <= k).select("q", F.col("_i").alias(id_column), "r")
