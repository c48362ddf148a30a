"""A streamed roll-up equals the one over the table."""

import os

import pytest
from pyspark.sql import functions as F

from quern.streaming.rollups import rollup

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_stream_equals_table(spark, tmp_path):
    table = spark.read.parquet(f"{DIR}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source = tmp_path / "in"
    table.repartition(3).write.parquet(str(source))
    stream = spark.readStream.schema(table.schema).parquet(str(source))
    q = rollup(stream, late="30 days").writeStream.format("memory").queryName("rolled").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda r: (r.bucket, r.event_type, r.n, round(r.total, 6), r.low, r.high)
    assert sorted(map(key, spark.table("rolled").collect())) == sorted(map(key, rollup(table).collect()))
