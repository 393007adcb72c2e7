"""Tables that change over time in place of constants."""

from __future__ import annotations

import datetime as dt

import pytest

from marketframe import dims
from marketframe.operators import orders, sizing

FACTS = [("ES", dt.date(2024, 1, 1), 100.0), ("ES", dt.date(2024, 3, 1), 50.0), ("ES", dt.date(2024, 3, 1), 70.0), ("CL", dt.date(2024, 2, 1), 10.0)]


def table(spark, rows=FACTS):
    return spark.createDataFrame(rows, "root string, valid_from date, margin double")


def test_the_fact_in_force(spark):
    days = [("ES", dt.date(2024, 1, 1)), ("ES", dt.date(2024, 2, 29)), ("ES", dt.date(2024, 3, 1)), ("ES", dt.date(2024, 3, 1)), ("CL", dt.date(2026, 1, 1))]
    got = dims.with_facts_as_of(spark.createDataFrame(days, "root string, d date"), table(spark), ["margin"], "d").collect()
    assert sorted((r.root, r.d, r.margin) for r in got) == sorted((*k, m) for k, m in zip(days, [100.0, 100.0, 70.0, 70.0, 10.0], strict=True))


@pytest.mark.parametrize("row", [("ES", dt.date(2023, 12, 31)), ("GC", dt.date(2024, 5, 1)), (None, dt.date(2024, 5, 1)), ("ES", None)])
def test_no_fact_fails(spark, row):
    with pytest.raises(Exception, match="no facts for root"):
        dims.with_facts_as_of(spark.createDataFrame([row], "root string, d date"), table(spark), ["margin"], "d").collect()


def test_no_rows(spark):
    assert dims.with_facts_as_of(spark.createDataFrame([], "root string, d date"), table(spark, []), ["margin"], "d").count() == 0


def test_sizing_and_slippage(spark):
    signals = spark.createDataFrame([("ES", dt.date(2024, 2, 1), 1.0, 1000.0, 1.0), ("ES", dt.date(2024, 4, 1), 1.0, 1000.0, 1.0)], "root string, d date, kelly double, equity double, price double")
    got = sizing.size_positions(signals, margins=table(spark)).select("d", "margin_contracts").collect()
    assert {r.d.month: r.margin_contracts for r in got} == {2: 5, 4: 7}
    fills = [("ESH24", "buy", "MKT", 10.0, dt.date(2024, 2, 1)), ("ESH24", "sell", "STP", 10.0, dt.date(2024, 4, 1)), ("ESH24", "sell", "LMT", 10.0, dt.date(2024, 4, 1))]
    slips = spark.createDataFrame([("ES", dt.date(2024, 1, 1), 0.25, 2), ("ES", dt.date(2024, 3, 1), 0.5, 3)], "root string, valid_from date, tick double, ticks int")
    made = spark.createDataFrame(fills, "contract string, side string, order_type string, fill_price double, filled_at date")
    assert sorted(r.slipped_price for r in orders.apply_slippage(made, slips=slips).collect()) == [8.5, 10.0, 10.5]
