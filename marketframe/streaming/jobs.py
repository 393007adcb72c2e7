"""Streaming jobs. Each returns a started query; checkpoints and sinks are folders given by the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..dims import Policy
from ..operators import consensus, performance
from ..sources import archive

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state of arbitrary size lives in RocksDB, not on the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def _start(df: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    return (
        df.writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def keyed_stream(out: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Rows of a keyed state: folders ``late=false`` and ``late=true`` under the sink."""
    use_rocksdb(out.sparkSession)
    return (
        out.writeStream.format("parquet").partitionBy("late").outputMode("append").option("path", sink).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def ingest_bars(quotes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Feed the archive. No watermark: a revision is kept however late it comes, a repeat never is."""

    def store(batch: DataFrame, _: int) -> None:
        archive.write_bars(batch, path)

    return quotes.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def consensus_stream(quotes: DataFrame, policy: Policy, sink: str, checkpoint: str, timeout: str = "2 hours") -> StreamingQuery:
    """Verdict per bar once the timeout has passed: verified, disputed, or incomplete for lack of sources."""
    out = consensus.bar_consensus(quotes.withWatermark("ts", timeout), policy)
    return _start(out, sink, checkpoint)


def bars_from_ticks(ticks: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    """Tumbling OHLCV bars of ticks (contract, ts, event_id, px); works on streams and tables."""
    order = F.struct("ts", "event_id")
    src = ticks.withWatermark("ts", late) if ticks.isStreaming else ticks
    return src.groupBy("contract", F.window("ts", width).alias("w")).agg(
        F.min_by("px", order).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", order).alias("close"),
        F.count(F.lit(1)).alias("volume"),
    ).select("contract", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def tick_bar_stream(ticks: DataFrame, width: str, sink: str, checkpoint: str, late: str = "1 hour") -> StreamingQuery:
    return _start(bars_from_ticks(ticks, width, late), sink, checkpoint)


def decay_stream(sessions: DataFrame, store: str, verdicts: str, checkpoint: str) -> StreamingQuery:
    """After each batch of sessions, new verdicts for the sleeves it touched.

    A batch reads its own sessions and the summaries that the batch before it left, one row per sleeve; old
    sessions are not read again. Sessions no later than what a sleeve's summary already covers go to
    ``store/late``. Every batch writes folders named after its number, so a repeated batch replaces itself.
    """

    def judge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{store}/new/batch={number}")
        fresh = spark.read.schema(batch.schema).parquet(f"{store}/new/batch={number}")
        state = f"{store}/summaries"
        if number == 0:
            summaries = performance.sleeve_summaries(fresh)
        else:
            before = spark.read.parquet(f"{state}/batch={number - 1}")
            covered = fresh.join(before.select("strategy_id", "until"), "strategy_id", "left")
            late = F.coalesce(F.col("d") <= F.col("until"), F.lit(False))
            covered.filter(late).drop("until").write.mode("overwrite").parquet(f"{store}/late/batch={number}")
            summaries = performance.merge_summaries(before, performance.sleeve_summaries(covered.filter(~late).drop("until")))
        summaries.write.mode("overwrite").parquet(f"{state}/batch={number}")
        now = spark.read.parquet(f"{state}/batch={number}").join(fresh.select("strategy_id").distinct(), "strategy_id", "left_semi")
        performance.summary_verdicts(now).write.mode("overwrite").parquet(f"{verdicts}/batch={number}")

    return sessions.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
