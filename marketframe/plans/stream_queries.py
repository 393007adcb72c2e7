"""Registered queries: streaming jobs run to the end of a landed folder, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import positions as pos
from ..session import cut_lineage, work_dir
from ..sources import archive
from ..streaming import jobs, state
from . import feed_queries as fq
from .quote_queries import WIDE3, _BARS_SELECT, _bars_sql
from .stat_queries import A21_SQL
from .trade_queries import SESSION, SESSION_LIMITS, W8_SQL, W10_SESSIONS_SQL, W10_SQL, v_f
from .views import present, sql, v_quotes, v_ret, v_ticks

_FLAT = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def _deliver(spark, df, column, cuts, start, flush=None):
    """Land ``df`` as one delivery per range of ``column``, oldest first, and run the job after each.

    A delivery is as many files as Spark writes; every run takes up the same checkpoint. ``flush`` is a
    last delivery that moves the watermark past the data, so that the last windows come out too.
    """
    path = work_dir(spark, "landing")
    at = F.col(column)
    bounds = [None, *(F.lit(c).cast(df.schema[column].dataType) for c in cuts), None]
    parts = [df.filter((at >= lo if lo is not None else F.lit(True)) & (at < hi if hi is not None else F.lit(True))) for lo, hi in zip(bounds, bounds[1:])]
    for part in parts + ([flush] if flush is not None else []):
        part.write.mode("append").parquet(path)
        query = start(spark.readStream.schema(df.schema).parquet(path))
        query.awaitTermination()
        if query.exception():
            raise query.exception()


def _later(df, **changes):
    """One row a week after the last of ``df``."""
    last = df.agg(F.max("ts").alias("__ts"), F.first(F.struct(*df.columns), ignorenulls=True).alias("__row"))
    return last.select("__row.*", "__ts").withColumns({"ts": F.col("__ts") + F.expr("INTERVAL 7 DAYS"), **{k: F.lit(v) for k, v in changes.items()}}).select(*df.columns)


DAYS = ["2024-01-08 00:00:00", "2024-01-16 00:00:00", "2024-01-24 00:00:00"]
YEARS = ["1997-01-01", "1999-01-01", "2000-06-01"]


def st1(spark, sf):
    q = v_quotes(spark, sf).withColumn("oi", F.lit(None).cast("bigint")).select(*fq.BAR_COLS)
    late = q.filter("day(ts) = 2").withColumn("sha", F.sha2(F.concat("sha", F.lit("revised")), 256)).withColumn("as_of", F.col("as_of") + F.expr("INTERVAL 27 DAYS"))
    path, ckpt = work_dir(spark, "archive"), work_dir(spark, "ckpt")
    _deliver(spark, q.unionByName(late), "as_of", DAYS, lambda stream: jobs.ingest_bars(stream, path, ckpt))
    # replayed from the start: nothing new
    _deliver(spark, q, "as_of", [], lambda stream: jobs.ingest_bars(stream, path, work_dir(spark, "ckpt")))
    return present(archive.stored(spark, f"{path}/bars").groupBy("contract", F.dayofmonth("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sha").alias("hashes")))


def st2(spark, sf):
    q = v_quotes(spark, sf)
    sink, ckpt = work_dir(spark, "sink"), work_dir(spark, "ckpt")
    _deliver(spark, q, "ts", DAYS, lambda stream: jobs.consensus_stream(stream, WIDE3, sink, ckpt), _later(q, contract="flush"))
    out = spark.read.parquet(sink)
    return present(out.select("contract", "ts", "outcome", "open", "high", "low", "close", "volume", "n_sources", "tier", "sources", "run_hash"))


def st3(spark, sf):
    t = v_ticks(spark, sf)
    sink, ckpt = work_dir(spark, "sink"), work_dir(spark, "ckpt")
    _deliver(spark, t, "ts", DAYS, lambda stream: jobs.tick_bar_stream(stream, "15 minutes", sink, ckpt), _later(t, contract="flush"))
    return present(spark.read.parquet(sink))


ST3_SQL = sql(
    """WITH b AS (SELECT contract, to_timestamp((CAST(floor(epoch(ts)) AS BIGINT) // 900) * 900) AT TIME ZONE 'UTC' AS ts, ts AS t, event_id, px FROM v_ticks),
    g AS (SELECT contract, ts, arg_min(px, (t, event_id))::DOUBLE AS open, max(px)::DOUBLE AS high, min(px)::DOUBLE AS low, arg_max(px, (t, event_id))::DOUBLE AS close, count(*) AS volume FROM b GROUP BY 1, 2)
    SELECT contract, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, open, high, low, close, volume FROM g"""
)


#: Fills come up to so many days after the day they are of; deliveries follow the day they come.
LAG_DAYS, DELAY, WIDTH = 45, "60 days", 120 * state.DAY


def _flat_fills(fills, *columns):
    """Fills with plain ordering columns, event time, and the day they arrive; days of one account arrive mixed."""
    lag = F.pmod(F.xxhash64("fill_key"), F.lit(LAG_DAYS)).cast("int")
    flat = fills.select("account", "root", "d", "qty", *columns, *[F.col(f"fill_key.{c}").alias(c) for c in _FLAT], F.date_add("d", lag).alias("arrives"))
    return flat.withColumn("ts", F.col("d").cast("timestamp"))


def _deliver_mixed(spark, rows, start):
    """Deliver by day of arrival, and at last a row a year later of an account of its own, which moves the watermark.

    The rows are written first: each delivery then reads a table instead of deriving all rows again.
    """
    rows = cut_lineage(rows, "deliveries")
    last = rows.agg(F.max("ts").alias("__ts"), F.first(F.struct(*rows.columns), ignorenulls=True).alias("__row"))
    flush = last.select("__row.*", "__ts").withColumns({"account": F.lit(-1).cast("bigint"), "ts": F.col("__ts") + F.expr("INTERVAL 1 YEAR")}).select(*rows.columns)
    _deliver(spark, rows, "arrives", YEARS, start, flush)


def st4(spark, sf):
    sink, ckpt = work_dir(spark, "sink"), work_dir(spark, "ckpt")
    jobs.use_rocksdb(spark)
    fills = _flat_fills(v_f(spark, sf), "price", F.col("multiplier").cast("double").alias("multiplier"))
    _deliver_mixed(spark, fills, lambda stream: jobs.keyed_stream(state.position_stream(stream, ["d", *_FLAT], delay=DELAY, width=WIDTH), sink, ckpt))
    out = spark.read.parquet(sink).filter("NOT late")
    return present(out.select("account", "root", "d", "qty", "net", F.round(F.col("avg_price") + 1e-7, 4).alias("avg_price"), F.round(F.col("realised") + 0.001, 1).alias("realised")))


def _latch(spark, sf, limits, session=None):
    sink, ckpt = work_dir(spark, "sink"), work_dir(spark, "ckpt")
    jobs.use_rocksdb(spark)
    log = _flat_fills(pos.average_cost(v_f(spark, sf)), "net", "gain")
    _deliver_mixed(spark, log, lambda stream: jobs.keyed_stream(state.latch_stream(stream, ["d", *_FLAT], *limits, delay=DELAY, width=WIDTH, session=session), sink, ckpt))
    return spark.read.parquet(sink).filter("NOT late")


def st5(spark, sf):
    return present(_latch(spark, sf, (5e6, 2e7, 60)).groupBy("account", "verdict").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("first"), F.max("d").alias("last")))


def st5_sessions(spark, sf):
    out = _latch(spark, sf, SESSION_LIMITS, F.expr(SESSION))
    return present(out.groupBy("account", "session", "verdict").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("first"), F.max("d").alias("last")))


def st6(spark, sf):
    s = v_ret(spark, sf).select("strategy_id", "d", (F.col("r") * 1000).cast("decimal(18,6)").alias("pnl"))
    verdicts, sessions, ckpt = work_dir(spark, "verdicts"), work_dir(spark, "sessions"), work_dir(spark, "ckpt")
    _deliver(spark, s, "d", YEARS, lambda stream: jobs.decay_stream(stream, sessions, verdicts, ckpt))
    v = spark.read.parquet(verdicts)
    cols = [c for c in v.columns if c not in ("strategy_id", "batch")]
    return present(v.groupBy("strategy_id").agg(F.max_by(F.struct(*cols), "batch").alias("x")).select("strategy_id", "x.*"))


QUERIES = {
    "ST1_stream_ingest": st1, "ST2_stream_consensus": st2, "ST3_stream_tick_bars": st3, "ST4_stream_positions": st4, "ST5_stream_loss_latch": st5, "ST5_stream_session_latch": st5_sessions, "ST6_stream_decay": st6,
}

ORACLES = {
    "ST1_stream_ingest": sql("""WITH q AS (SELECT contract, day(ts) AS day, CASE WHEN day(ts) = 2 THEN 2 ELSE 1 END AS k FROM v_quotes)
        SELECT contract, day, sum(k)::BIGINT AS n, sum(k)::BIGINT AS hashes FROM q GROUP BY 1, 2"""),
    "ST2_stream_consensus": sql(_bars_sql(WIDE3) + _BARS_SELECT),
    "ST3_stream_tick_bars": ST3_SQL, "ST4_stream_positions": W8_SQL, "ST5_stream_loss_latch": W10_SQL, "ST5_stream_session_latch": W10_SESSIONS_SQL, "ST6_stream_decay": A21_SQL,
}
