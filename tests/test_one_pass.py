"""Fills are sorted once for their cost, and a stream's deliveries are written once."""

from __future__ import annotations

from datetime import date, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from marketframe import dims
from marketframe.operators import orders, positions
from marketframe.plans import stream_queries, trade_queries


def test_average_cost_needs_no_window_over_fills(spark):
    rows = [(1, "ES", date(2024, 1, 1) + timedelta(days=k // 3), k, [2, -1, -3, 1, 2][k % 5], Decimal(100 + k)) for k in range(300)]
    fills = spark.createDataFrame(rows, "account long, root string, d date, fill_key long, qty long, price decimal(20,8)").withColumn("multiplier", F.lit(Decimal(50)).cast("decimal(20,8)"))
    got = positions.average_cost(fills)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    net, avg, realised, want = 0, 0.0, 0.0, []
    for _, _, _, _, qty, price in rows:
        after, p = net + qty, float(price)
        if net * qty < 0:
            realised += (p - avg) * min(abs(net), abs(qty)) * (1 if net > 0 else -1) * 50
            avg = avg if after * net > 0 else p if after else 0.0
        else:
            avg = (avg * abs(net) + p * abs(qty)) / abs(after)
        net = after
        want.append((net, round(avg, 6), round(realised, 4)))
    assert [(r.net, round(r.avg_price, 6), round(r.realised, 4)) for r in got.orderBy("n_fill").collect()] == want


def test_deliveries_are_derived_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(stream_queries, "_deliver", lambda spark, df, *a: seen.append(df))
    fills = spark.range(5).select(F.col("id").alias("account"), F.current_timestamp().alias("ts"))
    stream_queries._deliver_mixed(spark, fills, None)
    assert "Range" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()


def test_bands_share_one_reading_of_the_fills(spark):
    rows = [("ESH24", side, kind, Decimal(10 + i), i) for i, (side, kind) in enumerate((s, k) for s in ("buy", "sell") for k in ("MKT", "LMT", "STP"))]
    fills = spark.createDataFrame(rows, "contract string, side string, order_type string, fill_price decimal(20,8), order_id long")
    bands = [band for band, _ in dims.SLIPPAGE_BANDS]
    got = {(r.order_id, r.band): r.slipped_price for r in orders.apply_slippage(fills, bands).collect()}
    assert got == {(r.order_id, b): r.slipped_price for b in bands for r in orders.apply_slippage(fills, b).collect()}
    assert len(got) == len(rows) * len(bands)
    plan = trade_queries.p7(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # fills are found once, in partitions of a given number that adaptive execution does not merge
    assert plan.count("RepartitionByExpression") == 2
