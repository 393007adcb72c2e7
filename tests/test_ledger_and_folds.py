"""The ledger's table of last states, and folds by prefix sums."""

from __future__ import annotations

import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marketframe.operators import crossval as cv
from marketframe.session import work_dir
from marketframe.sources import ledger

DDL = "sleeve string, session_date date, qualified boolean, contracts bigint, entry_price decimal(20,8), exit_price decimal(20,8), session_pnl decimal(18,6), cost decimal(18,6)"


def sessions(spark, *rows):
    return spark.createDataFrame([(s, date(2024, 1, 1) + timedelta(days=d), True, 1, None, None, Decimal(p), Decimal(1)) for s, d, p in rows], DDL)


def totals(df):
    return sorted((r.sleeve, r.session_date.day, int(r.cumulative_pnl)) for r in df.collect())


def test_an_append_reads_the_last_states(spark):
    path = work_dir(spark, "ledger")
    ledger.record_sessions(sessions(spark, ("a", 0, 5), ("a", 1, -2), ("b", 0, 7)), path)
    # what the log says of the past is not asked again: only its files after the known append are read
    state, batch, _ = ledger.last_sessions(spark, path)
    assert batch == 0 and totals(state) == [("a", 2, 3), ("b", 1, 7)]
    plan = state._jdf.queryExecution().toString()
    assert "json" not in plan.lower()
    got = ledger.record_sessions(sessions(spark, ("a", 2, 1), ("c", 4, 4)), path)
    assert totals(got) == [("a", 3, 4), ("c", 5, 4)]
    assert totals(ledger.last_sessions(spark, path)[0]) == [("a", 3, 4), ("b", 1, 7), ("c", 5, 4)]
    assert totals(ledger.read_ledger(spark, path)) == [("a", 1, 5), ("a", 2, 3), ("a", 3, 4), ("b", 1, 7), ("c", 5, 4)]
    with pytest.raises(Exception, match="session date is not after"):
        ledger.record_sessions(sessions(spark, ("b", 0, 1)), path)
    assert totals(ledger.record_sessions(sessions(spark, ("b", 0, 1), ("b", 9, 1)), path, strict=False)) == [("b", 10, 8)]


def test_a_job_that_ends_between_its_two_writes(spark, monkeypatch):
    path = work_dir(spark, "ledger")
    ledger.record_sessions(sessions(spark, ("a", 0, 5)), path)
    with monkeypatch.context() as m:
        m.setattr(ledger, "_keep_state", lambda *a: None)
        ledger.record_sessions(sessions(spark, ("a", 1, 6), ("b", 1, 1)), path)
    assert totals(ledger.record_sessions(sessions(spark, ("a", 2, 7), ("b", 2, 1)), path)) == [("a", 3, 18), ("b", 3, 2)]
    assert ledger.record_sessions(sessions(spark), path).count() == 0
    assert totals(ledger.last_sessions(spark, path)[0]) == [("a", 3, 18), ("b", 3, 2)]


@pytest.mark.parametrize(("mode", "kw"), [("anchored", {"min_train": 5}), ("rolling", {"train": 7, "step": 3})])
def test_fold_means_by_prefix_equal_those_of_rows(spark, mode, kw):
    rnd = random.Random(6)
    rows = [(f, s, i, None if rnd.random() < 0.1 or s == 2 else rnd.uniform(-0.1, 0.1)) for f, n in (("x", 40), ("y", 23)) for s in (1, 2, 3) for i in range(n)]
    panel = spark.createDataFrame(rows, "family string, strategy_id int, i long, r double")
    folds = cv.walk_forward(spark.createDataFrame([("x", 40), ("y", 23)], "family string, n long"), 4, mode, **kw)
    keys = ["family", "fold", "strategy_id", "role"]
    by_rows = cv.assign_walk_forward(panel, folds).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean"))
    read = lambda df: {tuple(r[k] for k in keys): (r.n, None if r["mean"] is None else round(r["mean"], 10)) for r in df.collect()}
    assert read(cv.walk_forward_means(panel, folds)) == read(by_rows)
