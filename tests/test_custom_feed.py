"""A feed of the caller's own as a data source: windows, schema contract, offsets over restarts."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marketframe.session import work_dir
from marketframe.sources.custom import LandedFolder, feed_source

DDL = "contract string, ts timestamp, close decimal(20,8), volume bigint"


def land(spark, path, *days, ddl=DDL, contract="ESH24"):
    rows = [(contract, datetime(2024, 1, d) + timedelta(hours=h), None, d * 100 + h) for d in days for h in range(24)]
    df = spark.createDataFrame(rows, ddl).withColumn("day", F.to_date("ts"))
    df.repartition(3).write.mode("append").partitionBy("day").parquet(path)


def test_windows_and_schema(spark):
    path = work_dir(spark, "feed")
    land(spark, path, 1, 2, 3)
    spark.dataSource.register(feed_source(LandedFolder(path, DDL), "landed_test"))
    whole = spark.read.format("landed_test").load()
    assert whole.count() == 72 and whole.rdd.getNumPartitions() > 3
    got = spark.read.format("landed_test").option("starts", "2024-01-01T22:00:00").option("ends", "2024-01-02T02:00:00").load()
    assert sorted(r.volume for r in got.collect()) == [122, 123, 200, 201]
    assert spark.read.format("landed_test").option("starts", "2025-01-01").load().count() == 0
    spark.dataSource.register(feed_source(LandedFolder(work_dir(spark, "none"), DDL), "landed_none"))
    assert spark.read.format("landed_none").load().count() == 0


@pytest.mark.parametrize(("schema", "says"), [
    (DDL.replace("close", "settle"), "missing"),
    (DDL.replace("volume bigint", "volume timestamp"), "column volume is no"),
])
def test_a_feed_that_breaks_its_schema_fails(spark, schema, says):
    path = work_dir(spark, "feed")
    land(spark, path, 1)
    spark.dataSource.register(feed_source(LandedFolder(path, schema), "landed_bad"))
    with pytest.raises(Exception, match="columns of the feed" if says == "missing" else says):
        spark.read.format("landed_bad").load().collect()


def test_required_columns_are_not_null(spark):
    path = work_dir(spark, "feed")
    land(spark, path, 1, contract=None)
    spark.dataSource.register(feed_source(LandedFolder(path, DDL), "landed_null"))
    with pytest.raises(Exception, match="null in required column contract"):
        spark.read.format("landed_null").load().collect()


def test_a_stream_goes_on_from_its_checkpoint(spark):
    path, sink, ckpt = (work_dir(spark, x) for x in ("feed", "sink", "ckpt"))

    def run(final=False):
        spark.dataSource.register(feed_source(LandedFolder(path, DDL, final), "landed_stream"))
        query = spark.readStream.format("landed_stream").load().writeStream.format("parquet").option("path", sink).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(r.volume for r in spark.read.schema(DDL).parquet(sink).collect())

    every = lambda *days: [d * 100 + h for d in days for h in range(24)]
    land(spark, path, 1, 2)
    assert run() == every(1)  # the last day may go on
    assert run() == every(1)
    land(spark, path, 3, 4)
    assert run() == every(1, 2, 3)
    assert run(final=True) == every(1, 2, 3, 4)
