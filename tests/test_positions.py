"""Hand-computed fills: partial closes, flips, rolls, running values across segments."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marketframe.operators import positions as pos
from marketframe.operators.ordered import best_so_far, quantiles, segmented, trailing, value_ranks

D = dt.date


def _fills(spark, rows, extra=""):
    df = spark.createDataFrame(rows, "account bigint, root string, d date, k bigint, qty bigint, price double" + extra)
    return df.withColumn("price", F.col("price").cast("decimal(20,8)")).withColumn("fill_key", F.struct("k")).withColumn("multiplier", F.lit(10).cast("decimal(20,8)"))


def test_partial_close_and_flip(spark):
    f = _fills(spark, [
        (1, "ES", D(2020, 1, 1), 1, 2, 100.0), (1, "ES", D(2020, 1, 2), 2, 2, 110.0), (1, "ES", D(2020, 2, 1), 3, -1, 120.0),
        (1, "ES", D(2020, 2, 2), 4, -5, 90.0), (1, "ES", D(2020, 3, 1), 5, 2, 80.0),
    ])
    rows = {r["k"]: r for r in pos.average_cost(f).orderBy("d").select("fill_key.k", "net", "avg_price", "realised", "gain").collect()}
    assert [rows[k]["net"] for k in range(1, 6)] == [2, 4, 3, -2, 0]
    assert [round(rows[k]["avg_price"], 6) for k in range(1, 6)] == [100, 105, 105, 90, 0]
    # +15 on one, then -15 on three, then +10 on two, times ten
    assert [round(rows[k]["gain"], 6) for k in range(1, 6)] == [0, 0, 150, -450, 200]
    assert round(rows[5]["realised"], 6) == -100
    t = {r["trade_no"]: float(r["pnl"]) for r in pos.trade_ledger(f).collect()}
    assert t == {0: -300.0, 1: 200.0}


def test_roll_legs_do_not_end_a_trade(spark):
    rows = [
        (1, "ES", D(2020, 1, 1), 1, 2, 100.0, False), (1, "ES", D(2020, 3, 1), 2, -2, 108.0, True),
        (1, "ES", D(2020, 3, 1), 3, 2, 111.0, True), (1, "ES", D(2020, 4, 1), 4, -2, 115.0, False),
    ]
    t = pos.trade_ledger(_fills(spark, rows, ", is_roll boolean")).collect()
    assert len(t) == 1 and float(t[0]["pnl"]) == (8 + 4) * 2 * 10


def test_long_never_flat_position_matches_a_plain_loop(spark):
    rnd = random.Random(3)
    rows, net, avg, want = [], 0, 0.0, []
    for k in range(700):
        qty = rnd.choice([1, 2, 3]) if net < 5 or rnd.random() < 0.5 else -rnd.choice([1, 2, 3])
        price = 50 + rnd.random() * 10
        avg = (avg * net + price * qty) / (net + qty) if qty > 0 else avg
        net += qty
        rows.append((1, "ES", D(2020, 1, 1) + dt.timedelta(days=k // 3), k, qty, round(price, 2)))
    f = _fills(spark, rows)
    got = {r["k"]: r["avg_price"] for r in pos.average_cost(f, levels=2).select("fill_key.k", "avg_price").collect()}
    net, avg = 0, 0.0
    for _, _, _, k, qty, price in rows:
        avg = (avg * net + price * qty) / (net + qty) if qty > 0 else avg
        net += qty
        assert got[k] == pytest.approx(avg, rel=1e-9)


def test_segmented_equals_a_plain_window(spark):
    rnd = random.Random(5)
    rows = [(k % 3, k, rnd.choice([None, rnd.random()]), rnd.randint(-5, 5)) for k in range(400)]
    df = spark.createDataFrame(rows, "key int, t int, v double, q int")
    from pyspark.sql import Window

    w = Window.partitionBy("key").orderBy("t")
    r = w.rowsBetween(Window.unboundedPreceding, 0)
    plain = df.select("key", "t", F.sum("q").over(r).alias("s"), F.max("v").over(r).alias("m"), F.lag("v").over(w).alias("l"),
                      F.last("v", ignorenulls=True).over(r).alias("z"), F.row_number().over(w).cast("long").alias("n"))
    cut = segmented(df, ["key"], ["t"], F.floor(F.col("t") / 7), {
        "s": ("sum", F.col("q")), "m": ("max", F.col("v")), "l": ("lag", F.col("v")), "z": ("last", F.col("v")), "n": ("row_number", None)})
    assert sorted(map(tuple, cut.select("key", "t", "s", "m", "l", "z", "n").collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_decimal_running_sum_keeps_its_scale(spark):
    df = spark.createDataFrame([(1, t, "0.0000000001") for t in range(4)], "key int, t int, q string").withColumn("q", F.col("q").cast("decimal(18,10)"))
    out = segmented(df, ["key"], ["t"], F.floor(F.col("t") / 2), {"s": ("sum", F.col("q"))}).orderBy("t").collect()
    assert [float(r["s"]) for r in out] == [1e-10, 2e-10, 3e-10, 4e-10]


def test_trailing_blocks_overlap_correctly(spark):
    df = spark.range(1, 101).select(F.lit(1).alias("key"), F.col("id").alias("n"))
    out = {r["n"]: r["s"] for r in trailing(df, ["key"], "n", 5, {"s": F.sum("n")}, block=8).collect()}
    assert len(out) == 100 and all(out[n] == sum(range(max(1, n - 4), n + 1)) for n in out)


def test_best_so_far_looks_backward_only(spark):
    p = spark.createDataFrame([("a", 5.0), ("a", 50.0), ("a", 1.0), ("b", 9.0)], "key string, at double")
    f = spark.createDataFrame([("a", 5.0, "x"), ("a", 5.0, "y"), ("a", 40.0, "z"), ("a", 60.0, "w")], "key string, t double, v string")
    got = best_so_far(p, f, ["key"], F.col("at"), F.col("t"), F.struct("t", "v"), 10.0)
    assert {(r["key"], r["at"]): (r["found"]["v"] if r["found"] else None) for r in got.collect()} == {
        ("a", 5.0): "y", ("a", 50.0): "z", ("a", 1.0): None, ("b", 9.0): None}


def test_quantiles_of_repeated_values(spark):
    import numpy as np

    vals = [0.0] * 50 + [-1.5, 2.0, 3.25, 1e-9, -1e-9] * 3
    df = spark.createDataFrame([(1, v) for v in vals], "key int, v double")
    q = quantiles(value_ranks(df, ["key"], "v"), ["key"], "v", {"a": F.lit(0.05), "b": F.lit(0.5), "c": F.lit(0.93)}).collect()[0]
    assert [q["a"], q["b"], q["c"]] == pytest.approx(list(np.quantile(vals, [0.05, 0.5, 0.93])))


def test_finer_segments_change_nothing(spark):
    rnd = random.Random(8)
    rows = [(1, "ES", D(2020, 1, 1) + dt.timedelta(days=k // 9), k, rnd.choice([-3, -2, -1, 1, 2, 3]), 50 + rnd.random()) for k in range(300)]
    f = _fills(spark, rows)
    day = lambda d: F.unix_date(d)
    month = sorted(map(tuple, pos.trade_ledger(f).select("trade_no", "pnl").collect()))
    assert month == sorted(map(tuple, pos.trade_ledger(f, day).select("trade_no", "pnl").collect())) and month


def test_stops_cost_rows_only_while_a_position_is_held(spark):
    """Flat stretches give no rows; the last fill of a day counts; open positions last to the last bar."""
    from datetime import date, timedelta

    at = lambda n: date(2024, 1, 1) + timedelta(days=n)
    states = [(1, "ES", at(3), 1, 2, 100.0), (1, "ES", at(3), 2, 3, 101.0), (1, "ES", at(5), 3, 0, None), (1, "ES", at(380), 4, -1, 90.0), (2, "CL", at(0), 5, 1, 50.0), (3, "GC", at(9), 6, 1, 50.0), (4, None, at(0), 7, 1, 50.0)]
    bars = [("ES", at(n), 95.0 + n % 2) for n in range(390) if n != 4] + [("CL", at(20), 40.0), ("GC", at(2), 1.0)]
    s = spark.createDataFrame(states, "account long, root string, d date, fill_key long, net long, avg_price double")
    b = spark.createDataFrame(bars, "root string, d date, close double")
    got = sorted((r.account, (r.d - at(0)).days, r.net, r.stop) for r in pos.stop_loss_flags(s, b, 0.05).collect())
    assert got == [(1, 3, 3, False)] + [(1, n, -1, True) for n in range(380, 390)] + [(2, 20, 1, True)]
    held = pos.held_weeks(s, b.groupBy("root").agg({"d": "max"}).withColumnRenamed("max(d)", "__end"))
    assert held.filter("account = 1").count() <= 4
