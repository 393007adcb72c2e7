"""Literal cases: calendars, as-of rules, consensus edge cases, parsers, normal functions."""

from __future__ import annotations

import datetime as dt
from statistics import NormalDist

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketframe import dims
from marketframe.functions import clock, contracts as sym
from marketframe.functions.normal import normal_cdf, normal_ppf
from marketframe.functions.text import clean_number, iso_utc
from marketframe.operators import calendar as cal
from marketframe.operators import consensus, crossval, performance, pit, resample, sizing, validate
from marketframe.sources import archive, feeds, settlement_pages
from marketframe.session import work_dir

D = dt.date
SHA = "a" * 64


def test_normal_functions_match_the_standard_library(spark):
    z = [-8.5, -3.0, -0.5, 0.0, 0.1, 1.96, 7.2, 9.0]
    p = [1e-12, 1e-4, 0.02, 0.3, 0.5, 0.77, 0.999, 1 - 1e-10]
    df = spark.createDataFrame(list(zip(z, p)), "z double, p double")
    for r in df.select("z", "p", normal_cdf(F.col("z")).alias("c"), normal_ppf(F.col("p")).alias("q")).collect():
        assert r["c"] == pytest.approx(NormalDist().cdf(r["z"]), abs=1e-14)
        assert r["q"] == pytest.approx(NormalDist().inv_cdf(r["p"]), rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("year,day", [(1961, D(1961, 4, 2)), (1981, D(1981, 4, 19)), (1954, D(1954, 4, 18)), (2000, D(2000, 4, 23)), (2024, D(2024, 3, 31)), (2038, D(2038, 4, 25)), (2049, D(2049, 4, 18)), (2076, D(2076, 4, 19))])
def test_easter(spark, year, day):
    assert spark.range(1).select(cal.easter(F.lit(year))).collect()[0][0] == day


def test_calendar_overrides(spark):
    span = spark.createDataFrame([(D(2021, 12, 1), D(2022, 7, 31))], "lo date, hi date")
    base = {r["d"]: r["is_open"] for r in cal.exchange_calendar(span).collect()}
    assert not base[D(2021, 12, 31)] and not base[D(2022, 6, 20)] and not base[D(2022, 4, 15)] and base[D(2022, 7, 5)]
    shut = spark.createDataFrame([(D(2022, 7, 5),)], "d date")
    opened = spark.createDataFrame([(D(2022, 7, 3),)], "d date")
    moved = {r["d"]: r["is_open"] for r in cal.exchange_calendar(span, shut, opened).collect()}
    assert not moved[D(2022, 7, 5)] and moved[D(2022, 7, 3)]
    with pytest.raises(Exception, match="both forced"):
        cal.exchange_calendar(span, shut, shut).collect()


def test_contract_symbols(spark):
    df = spark.createDataFrame([("ESZ49",), ("6EH50",), ("CLF00",), ("bad",)], "s string")
    s = F.col("s")
    rows = [tuple(r) for r in df.select(sym.contract_root(s), sym.contract_month(s), sym.contract_year(s)).collect()]
    assert rows == [("ES", 12, 2049), ("6E", 3, 1950), ("CL", 1, 2000), (None, None, None)]
    ok = spark.createDataFrame([("ESZ24",), ("CLZ99",), ("GCM21",)], "s string")
    assert sorted(r["next_symbol"] for r in cal.next_contract(ok, "s").collect()) == ["CLF00", "ESH25", "GCQ21"]
    with pytest.raises(Exception, match="no cycle"):
        cal.next_contract(spark.createDataFrame([("ESF24",)], "s string"), "s").collect()


def test_windows_follow_daylight_saving(spark):
    df = spark.createDataFrame([("2024-01-15 14:30:00",), ("2024-07-15 13:30:00",), ("2024-07-15 20:00:00",), ("2024-07-16 03:00:00",)], "t string")
    t = F.col("t").cast("timestamp")
    rows = [tuple(r) for r in df.select(clock.is_regular_hours(t), clock.in_window(t, "22:00:00", "04:00:00")).collect()]
    assert rows == [(True, False), (True, False), (False, False), (False, True)]


def test_iso_text(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-01 00:00:00.120",)], "t string")
    assert [r[0] for r in df.select(iso_utc(F.col("t").cast("timestamp"))).collect()] == ["2024-01-01T00:00:00+00:00", "2024-01-01T00:00:00.120000+00:00"]


def _quotes(spark, prices, tiers=(2, 3, 4, 6)):
    rows = [("ESH24", D(2024, 1, 2), f"s{i}", t, str(p), "final", dt.datetime(2024, 1, 2, 22), SHA) for i, (p, t) in enumerate(zip(prices, tiers))]
    df = spark.createDataFrame(rows, "contract string, as_of_date date, source_id string, tier int, settle string, settle_state string, as_of timestamp, sha string")
    return df.withColumn("settle", F.col("settle").cast("decimal(20,8)"))


@pytest.mark.parametrize("prices,band,outcome,value", [
    ((100, 100, 100, 7), "NORMAL", "verified", 100), ((100, 100, 101, 100), "NORMAL", "disagreement", None), ((100, 102, 105), "WIDE", "verified", 102),
    ((100, 102, 110), "WIDE", "disagreement", None), ((100, 100), "NORMAL", "incomplete", None), ((0, 0, 0), "WIDE", "verified", 0), ((0, 0, 1), "WIDE", "disagreement", None)])
def test_settle_consensus(spark, prices, band, outcome, value):
    r = consensus.settle_consensus(_quotes(spark, prices), dims.Policy("p", "fail_closed", 3, band)).collect()[0]
    assert r["outcome"] == outcome and (r["settle"] is None if value is None else float(r["settle"]) == value)


def test_run_hash_ignores_row_order(spark):
    q = _quotes(spark, (100, 100, 100))
    p = dims.policy_for("default", "settle")
    a = consensus.settle_consensus(q, p).collect()[0]["run_hash"]
    b = consensus.settle_consensus(q.orderBy(F.col("source_id").desc()), p).collect()[0]["run_hash"]
    assert a == b and len(a) == 64


def test_future_settle_is_never_returned(spark):
    rows = [("ESH24", D(2024, 1, d), s, "final" if d < 3 else "preliminary", f"{d}" * 64) for d, s in ((1, "a"), (2, "b"), (3, "c"))] + [("ESH24", D(2024, 1, 2), "z", "preliminary", "9" * 64)]
    s = spark.createDataFrame(rows, "contract string, as_of_date date, tag string, settle_state string, sha string")
    p = spark.createDataFrame([("ESH24", D(2024, 1, 2)), ("ESH24", D(2023, 12, 31)), ("ESH24", D(2024, 6, 1))], "contract string, as_of_date date")
    got = {r["as_of_date"]: (r["found"]["tag"] if r["found"] else None) for r in pit.latest_settle(s, p, ["contract"]).collect()}
    assert got == {D(2024, 1, 2): "b", D(2023, 12, 31): None, D(2024, 6, 1): "c"}


def test_weekend_snapshot_fails(spark):
    df = spark.createDataFrame([(D(2024, 1, 6),)], "d date")
    with pytest.raises(Exception, match="weekend"):
        df.select(pit.cot_known_at(F.col("d"))).collect()


def test_archive_keeps_revisions_and_skips_repeats(spark):
    path = work_dir(spark, "t")
    rows = [("ESH24", dt.datetime(2024, 1, 31, 23), "1h", 1, "src", dt.datetime(2024, 2, 1), SHA), ("ESH24", dt.datetime(2024, 2, 1, 0), "1h", 1, "src", dt.datetime(2024, 2, 1), SHA)]
    schema = "contract string, ts timestamp, resolution string, volume bigint, source_id string, as_of timestamp, sha string"
    a = spark.createDataFrame(rows + rows[:1], schema)
    assert archive.write_bars(a, path) == archive.WriteResult(2, 1)
    assert archive.write_bars(a, path) == archive.WriteResult(0, 3)
    assert archive.write_bars(a.withColumn("sha", F.lit("b" * 64)), path) == archive.WriteResult(2, 1)
    half = archive.read_bars(spark, path, "ESH24", "1h", "2024-01-31 00:00:00", "2024-02-01 00:00:00").count()
    both = archive.read_bars(spark, path, "ESH24", "1h", "2024-01-31 00:00:00", "2024-02-01 00:00:00", True).count()
    assert (half, both) == (2, 4)
    assert archive.read_bars(spark, work_dir(spark, "none"), "ESH24", "1h", "2024-01-31 00:00:00", "2024-02-01 00:00:00").count() == 0


def test_archive_read_prunes_partitions(spark):
    path = work_dir(spark, "t")
    rows = [("ESH24", dt.datetime(2024, m, 3), "1h", 1, "s", dt.datetime(2024, 9, 1), SHA) for m in range(1, 7)]
    archive.write_bars(spark.createDataFrame(rows, "contract string, ts timestamp, resolution string, volume bigint, source_id string, as_of timestamp, sha string"), path)
    df = archive.read_bars(spark, path, "ESH24", "1h", "2024-02-01 00:00:00", "2024-02-20 00:00:00")
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "PartitionFilters" in plan and "PushedFilters" in plan and df.count() == 1


PAGE = "<html><span class='status-value'>{status}</span><table id='x'><tr><td>1</td></tr></table><table class='a cmeTable'><thead><tr>{heads}</tr></thead><tbody>{rows}</tbody></table></html>"


def test_settlement_page(spark):
    heads = "".join(f"<th> {h} </th>" for h in settlement_pages.HEADERS)
    row = "<tr>" + "".join(f"<td>{x}</td>" for x in ("MAR 24", "5,000.25", "--", "4,990.00", "-", "+1.50", "<b>5,001</b>.75", "1,200", "---")) + "</tr>"
    none = row.replace("<b>5,001</b>.75", "n/a").replace("MAR", "JUN")
    html = PAGE.format(status="FINAL prices", heads=heads, rows=row + none)
    pages = spark.createDataFrame([(1, "ES", D(2024, 1, 2), dt.datetime(2024, 1, 2, 23), html), (2, "ES", D(2024, 1, 3), dt.datetime(2024, 1, 3, 23), html.replace("Settle", "Close"))],
                                  "page_id bigint, root string, as_of_date date, as_of timestamp, html string")
    good, bad = settlement_pages.parse_pages(pages)
    r = good.collect()
    assert len(r) == 1 and r[0]["contract"] == "ESH24" and float(r[0]["settle"]) == 5001.75 and float(r[0]["high"]) == 5001.75
    assert (r[0]["settle_state"], float(r[0]["change"]), r[0]["volume_est"], r[0]["oi_prior"]) == ("final", 1.5, 1200, 0)
    assert [tuple(x) for x in bad.collect()] == [(2, "header drift")]


def test_numbers(spark):
    df = spark.createDataFrame([("+1,234.50",), ("---",), ("x",)], "s string")
    assert [None if r[0] is None else float(r[0]) for r in df.select(clean_number(F.col("s"))).collect()] == [1234.5, None, None]


def test_short_venue_row_fails(spark):
    doc = spark.createDataFrame([("k", "BTCUSD", "[[1704067200000, 1, 2, 0.5, 1.5]]", dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 3))],
                                "venue string, contract string, payload string, as_of timestamp, starts timestamp, ends timestamp")
    with pytest.raises(Exception, match="short bar row"):
        feeds.venue_bars(doc, "1h").collect()


def test_rules_split_and_require(spark):
    rows = [(1, "ESH24", dt.datetime(2024, 1, 1), "buy", 1, "LMT", None, None), (2, "ESH24", dt.datetime(2024, 1, 1), "buy", 1, "MKT", None, None)]
    df = spark.createDataFrame(rows, "order_id int, contract string, ts timestamp, side string, quantity int, order_type string, limit_price double, stop_price double")
    good, bad = validate.split(df, "order")
    assert [r["order_id"] for r in good.collect()] == [2] and bad.collect()[0]["broken"] == ["limit price missing"]
    with pytest.raises(Exception, match="limit price missing"):
        validate.require(df, "order").collect()
    assert validate.schema_drift(df, "order_id int, side int, gone string") == {"missing": ["gone"], "added": ["contract", "limit_price", "order_type", "quantity", "stop_price", "ts"], "changed": ["side"]}


def test_sizing_ties_and_unknown_root(spark):
    df = spark.createDataFrame([("ES", 0.0, 1e6, 5000.0), ("ES", 100.0, 1e6, 5000.0)], "root string, kelly double, equity double, price double")
    rows = sizing.size_positions(df).orderBy("kelly").collect()
    assert [(r["binding"], r["contracts"]) for r in rows] == [("no_edge", 0), ("leverage", 12)]
    with pytest.raises(Exception, match="no constants"):
        sizing.size_positions(df.withColumn("root", F.lit("??"))).collect()


def _panel(spark, rows):
    return spark.createDataFrame(rows, "family int, strategy_id int, i bigint, r double")


def test_identical_strategies_are_never_overfit(spark):
    import random

    r = random.Random(1)
    base = [r.gauss(0, 1) for _ in range(64)]
    res = crossval.overfitting_probability(_panel(spark, [(0, s, i, x) for s in range(4) for i, x in enumerate(base)]), 8).collect()[0]
    assert res["pbo"] == 0 and res["splits"] == 70


def test_planted_edge_is_found_and_draws_do_not_depend_on_partitions(spark):
    import random

    r = random.Random(2)
    rows = [(0, s, i, r.gauss(0.6 if s == 2 else 0.0, 1)) for s in range(4) for i in range(80)]
    p = _panel(spark, rows)
    m = resample.draw_means(p, 1000, 5, 1)
    assert resample.superior_ability(p, m).collect()[0]["p_value"] < 0.05
    assert [x["strategy_id"] for x in resample.stepdown(p, m).filter("reject").collect()] == [2]
    a = resample.reality_check(p, m).collect()[0]["p_value"]
    q = p.repartition(3)
    assert resample.reality_check(q, resample.draw_means(q, 1000, 5, 1)).collect()[0]["p_value"] == a
    with pytest.raises(Exception, match="not dense"):
        resample.draw_means(p.filter("NOT (strategy_id = 1 AND i = 7)"), 1000, 5, 1).collect()


def test_survival_falls_with_leverage(spark):
    import random

    r = random.Random(4)
    p = _panel(spark, [(0, 0, i, r.gauss(0.0, 0.02)) for i in range(120)])
    rows = resample.survival(p, [0.0, 1.0, 4.0, 60.0], 40, 200, 0.3, 5, 9).orderBy("leverage").collect()
    s = [x["survival"] for x in rows]
    assert s[0] == 1 and s == sorted(s, reverse=True) and s[-1] < 0.1


def test_ruin_latches(spark):
    e = spark.createDataFrame([(1, D(2020, 1, 1) + dt.timedelta(days=i), v) for i, v in enumerate([100.0, 110.0, -5.0, 50.0, 60.0])], "strategy_id int, d date, equity double")
    assert [round(r["r"], 6) for r in performance.equity_returns(e).orderBy("d").collect()] == [0.1, -1.0, 0.0, 0.0]
    with pytest.raises(Exception, match="stay positive"):
        performance.performance(e, 252.0).collect()


def test_user_metric_in_splits(spark):
    @F.pandas_udf("double")
    def total(v: pd.Series) -> float:
        return float(v.sum())

    p = _panel(spark, [(0, s, i, float(s + i % 3)) for s in range(2) for i in range(16)])
    out = crossval.overfitting_with_metric(p, total, 4).collect()
    assert len(out) == 2 * 6 and all(x["ins"] is not None and x["oos"] is not None for x in out)


def test_unknown_settle_state_fails(spark):
    df = spark.createDataFrame([("odd",)], "s string")
    with pytest.raises(Exception, match="unknown settle state"):
        df.select(consensus.state_rank(F.col("s"))).collect()
