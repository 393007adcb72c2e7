"""Inputs beyond the registered tables: null keys, long chains, revisions, odd symbols."""

from __future__ import annotations

import math
import os
import re
import uuid

import pytest
from pyspark.sql import functions as F

from marketframe import dims
from marketframe.operators import consensus, ordered, positions, resample
from marketframe.session import work_dir
from marketframe.sources import archive


def test_running_columns_keep_null_keys_and_orders(spark):
    rows = [("a", 1, 1), ("a", 12, 2), ("a", None, 4), (None, 1, 8), (None, 25, 16), (None, None, 32)]
    df = spark.createDataFrame(rows, "k string, t int, v long")
    got = ordered.segmented(df, ["k"], ["t"], F.floor(F.col("t") / 10), {"s": ("sum", F.col("v")), "p": ("lag", F.col("v"))})
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [("a", None, 4, 4, None), ("a", 1, 1, 5, 4), ("a", 12, 2, 7, 1), (None, None, 32, 32, None), (None, 1, 8, 40, 32), (None, 25, 16, 56, 8)], key=str
    )


def test_points_without_key_or_time_stay(spark):
    points = spark.createDataFrame([("a", 5), ("a", None), (None, 5), ("b", 9)], "k string, t int")
    facts = spark.createDataFrame([("a", 1, 10), (None, 1, 99), ("a", None, 98)], "k string, t int, v int")
    got = ordered.best_so_far(points, facts, ["k"], F.col("t"), F.col("t"), F.struct("t", "v"), 3.0)
    assert {(r.k, r.t, r.found and r.found.v) for r in got.collect()} == {("a", 5, 10), ("a", None, None), (None, 5, None), ("b", 9, None)}


def test_infinite_values_have_ranks(spark):
    inf = math.inf
    df = spark.createDataFrame([("a", v) for v in (1.0, -inf, inf, 2.0, inf)], "k string, v double")
    got = {r.v: (r.hi, r.n) for r in ordered.value_ranks(df, ["k"], "v").collect()}
    assert got == {-inf: (1, 5), 1.0: (2, 5), 2.0: (3, 5), inf: (5, 5)}


def test_average_cost_of_a_chain_that_never_goes_flat(spark):
    n = 20_000
    fills = spark.range(n).select(
        F.lit(1).cast("long").alias("account"), F.lit("ES").alias("root"), F.date_add(F.lit("2020-01-01"), (F.col("id") / 40).cast("int")).alias("d"), F.col("id").alias("fill_key"),
        F.when(F.col("id") == 0, 100).when(F.col("id") % 2 == 1, 50).otherwise(-50).cast("long").alias("qty"),
        (100 + F.col("id") % 7).cast("decimal(20,8)").alias("price"), F.lit(1).cast("decimal(10,2)").alias("multiplier"),
    )
    got = {r.fill_key: r.avg_price for r in positions.average_cost(fills).select("fill_key", "avg_price").collect()}
    net, avg = 0, 0.0
    for i in range(n):
        qty, price = (100 if i == 0 else 50 if i % 2 else -50), 100 + i % 7
        avg = (avg * net + price * qty) / (net + qty) if qty > 0 else avg
        net += qty
        assert got[i] == pytest.approx(avg, rel=1e-9)


def test_revisions_of_one_source_are_one_vote(spark):
    rows = [("ESH24", "2024-01-02", float(v), "final", s, t, f"2024-01-02 2{h}:00:00", f"{s}{h}") for s, t, v, h in [("x", 1, 10, 1), ("x", 1, 11, 2), ("x", 1, 11, 3)]]
    ddl = "contract string, as_of_date string, settle double, settle_state string, source_id string, tier int, as_of string, sha string"
    states = {s: s for s in dims.SETTLE_STATES}
    quotes = spark.createDataFrame([(*r[:3], next(iter(states)), *r[4:]) for r in rows], ddl)
    quotes = quotes.withColumns({"as_of_date": F.to_date("as_of_date"), "as_of": F.to_timestamp("as_of"), "settle": F.col("settle").cast("decimal(20,8)")})
    got = consensus.settle_consensus(quotes, dims.policy_for("default", "settle")).first()
    assert got.n_sources == 1 and got.outcome == "incomplete" and got.sources == ["x"]


def test_a_symbol_without_month_code_is_stored_once_and_read_back(spark):
    path = work_dir(spark, "archive")
    bar = spark.sql("SELECT 'BTCUSD' AS contract, timestamp'2024-01-02 00:00:00' AS ts, '1d' AS resolution, 1.5D AS close, 'h' AS sha, timestamp'2024-01-03 00:00:00' AS as_of")
    assert [archive.write_bars(bar, path).rows_written for _ in range(3)] == [1, 0, 0]
    assert archive.read_bars(spark, path, "BTCUSD", "1d", "2024-01-01", "2024-02-01").count() == 1


def test_stored_keys_are_read_from_touched_partitions_only(spark):
    path = os.path.join(work_dir(spark, "archive"), uuid.uuid4().hex)
    rows = [(f"ES{c}24", f"{y}-01-02 00:00:00", "1d", 1.0, f"{c}{y}", "2024-01-03 00:00:00") for c in "HM" for y in (2022, 2023, 2024)]
    bars = spark.createDataFrame(rows, "contract string, ts string, resolution string, close double, sha string, as_of string").withColumns({"ts": F.to_timestamp("ts"), "as_of": F.to_timestamp("as_of")})
    archive.write_bars(bars, path)
    batch = archive.with_bar_parts(bars.filter("year(ts) = 2023"))
    new = archive.new_rows(batch, archive.stored(spark, f"{path}/bars"), archive.BAR_KEY, archive.BAR_PARTS)
    assert re.search(r"year#\d+ (=|IN) .*2023", new._jdf.queryExecution().optimizedPlan().toString())
    assert new.count() == 0


def test_archive_queries_cannot_write(spark, tmp_path):
    assert archive.query(spark, "WITH x AS (SELECT 1 AS a) SELECT a FROM x -- note\n;").count() == 1
    for text in (f"INSERT OVERWRITE DIRECTORY '{tmp_path}/x' USING parquet SELECT 1", "CREATE TEMPORARY VIEW z AS SELECT 1"):
        with pytest.raises(Exception, match="PARSE_SYNTAX_ERROR"):
            archive.query(spark, text)
    assert not (tmp_path / "x").exists()


def test_draws_fill_more_than_one_partition(spark):
    sizes = spark.createDataFrame([(0, 50, 3)], "family int, n long, strategies long")
    parts = resample.stationary_indices(sizes, 200, 5, 7).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 1 and sum(r["count"] for r in parts) == 200 * 50
