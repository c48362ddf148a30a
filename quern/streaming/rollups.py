"""Time buckets over streams: the roll-ups of TIME_TRUNC, kept up as events arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rollup(events: DataFrame, width: str = "15 minutes", late: str = "1 hour", time: str = "ts", by: tuple[str, ...] = ("event_type",), value: str = "value") -> DataFrame:
    """bucket, the keys, n, total, low and high of each bucket; events later than the watermark are left out.

    Works on a stream and on a table alike: a bucket's partial sums are the only state, and it goes when the watermark
    has passed the bucket.
    """
    at = F.col(time).cast("timestamp")
    rows = events.withColumn("_at", at).withWatermark("_at", late)
    grouped = rows.groupBy(F.window("_at", width), *by)
    sums = grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"))
    return sums.select(F.col("window.start").alias("bucket"), *by, "n", "total", "low", "high")
