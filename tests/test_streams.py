"""Event-time order in keyed state: mixed deliveries, rows that come too late, sessions, one very busy account."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marketframe.session import work_dir
from marketframe.streaming import jobs, state

FILL = "account long, root string, d date, qty long, price double, multiplier double, seq long, ts timestamp"
LOG = "account long, d date, qty long, net long, gain double, seq long, ts timestamp"
T0 = datetime(2024, 1, 1)


def run(spark, ddl, deliveries, make):
    """All rows of the sink after the deliveries, each its own run on the same checkpoint."""
    path, sink, ckpt = (work_dir(spark, x) for x in ("landing", "sink", "ckpt"))
    jobs.use_rocksdb(spark)
    for rows in deliveries:
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(path)
        query = jobs.keyed_stream(make(spark.readStream.schema(ddl).parquet(path)), sink, ckpt)
        query.awaitTermination()
    return spark.read.parquet(sink).withColumn("late", F.col("late").cast("boolean")).collect()


def fill(seq, qty, price, hour, account=1, root="ES"):
    at = T0 + timedelta(hours=hour)
    return (account, root, at.date(), qty, float(price), 50.0, seq, at)


def plain_positions(fills):
    net, avg, out = 0, 0.0, []
    for _, _, _, qty, price, *_ in sorted(fills, key=lambda f: f[6]):
        after = net + qty
        if net * qty >= 0:
            avg = (avg * abs(net) + price * abs(qty)) / abs(after)
        elif after * net <= 0:
            avg = price if after else 0.0
        net = after
        out.append((net, round(avg, 9)))
    return out


def test_mixed_deliveries_fold_in_order(spark):
    rnd = random.Random(3)
    fills = [fill(k, rnd.choice([-3, -2, -1, 1, 2, 3]), 100 + rnd.random(), k) for k in range(300)]
    mixed = sorted(fills, key=lambda f: f[6] + rnd.randrange(40))
    end = [fill(10**6, 1, 1, 24 * 60, account=9)]
    got = run(spark, FILL, [mixed[:120], mixed[120:200], mixed[200:], end], lambda s: state.position_stream(s, ["seq"], delay="48 hours", width=3_600_000 * 7))
    rows = [r for r in got if not r.late]
    assert len(rows) == 300 and {r.account for r in got} == {1}
    # the sink has no order of its own: compare by the fills' days and what they lead to
    want = plain_positions(fills)
    assert sorted((r.net, round(r.avg_price, 9)) for r in rows) == sorted(want)


def test_too_late_changes_nothing(spark):
    first = [fill(k, 1, 100, k) for k in range(5)] + [fill(99, 1, 1, 24 * 30, account=9)]
    late = [fill(2, 7, 500, 2)]
    got = run(spark, FILL, [first, late, [fill(6, -5, 110, 24 * 31), fill(100, 1, 1, 24 * 90, account=9)]], lambda s: state.position_stream(s, ["seq"], delay="1 hour"))
    mine = [r for r in got if r.account == 1]
    assert [(r.qty, r.net, r.late) for r in mine if r.late] == [(7, None, True)]
    assert sorted(r.net for r in mine if not r.late) == [0, 1, 2, 3, 4, 5]
    assert [r.trade_pnl for r in mine if r.trade_pnl is not None] == [5 * 10 * 50.0]


def test_sessions_start_over(spark):
    def row(seq, day, qty, net, gain, account=1):
        return (account, date(2024, 1, day), qty, net, float(gain), seq, datetime(2024, 1, day))

    log = [row(1, 2, 1, 1, -600), row(2, 2, 1, 2, 0), row(3, 2, 1, 3, 0), row(4, 2, -1, 2, 0), row(5, 3, 1, 3, 100), row(6, 3, 9, 12, 0), row(7, 3, 1, 4, 0)]
    end = [row(99, 28, 1, 1, 0, account=9)]
    make = lambda session: lambda s: state.latch_stream(s, ["seq"], 500, 10_000, 10, delay="1 hour", session=session)
    verdicts = lambda rows: sorted((str(r.d), r.verdict) for r in rows)
    apart = run(spark, LOG, [log[4:], log[:4], end], make(F.col("d")))
    # the second delivery is of days before the watermark, but nothing of theirs was folded yet
    assert verdicts(r for r in apart if not r.late) == [("2024-01-02", "allowed"), ("2024-01-02", "halted"), ("2024-01-02", "loss_limit"), ("2024-01-02", "reduce"), ("2024-01-03", "allowed"), ("2024-01-03", "allowed"), ("2024-01-03", "max_contracts")]
    whole = run(spark, LOG, [log, end], make(None))
    assert verdicts(r for r in whole if r.verdict == "halted") == [("2024-01-02", "halted")] + [("2024-01-03", "halted")] * 3


def test_held_pieces_are_per_bucket(spark):
    """One account with all rows: what is folded at once is a bucket."""
    n = 6000
    fills = [fill(k, 1 if k % 2 else -1, 100, k / 20) for k in range(n)]
    end = [fill(10**6, 1, 1, 24 * 365, account=9)]
    got = run(spark, FILL, [fills[n // 2 :], fills[: n // 2], end], lambda s: state.position_stream(s, ["seq"], delay="30 days", width=3_600_000 * 24))
    assert sum(not r.late for r in got) == n and {r.net for r in got} == {-1, 0}


@pytest.mark.parametrize("width", [1000, 10**12])
def test_width_changes_no_result(spark, width):
    fills = [fill(k, [2, -1, -2, 3][k % 4], 100 + k, k * 5) for k in range(24)]
    end = [fill(10**6, 1, 1, 24 * 40_000, account=9)]
    got = run(spark, FILL, [fills[::2], fills[1::2], end], lambda s: state.position_stream(s, ["seq"], delay="3650 days", width=width))
    assert sorted((r.net, round(r.avg_price, 9)) for r in got if not r.late) == sorted(plain_positions(fills))


def test_decay_reads_no_old_sessions(spark):
    """Three batches, one with late sessions: verdicts are those of all sessions at once, old rows are not read."""
    import os
    import shutil

    from marketframe.operators import performance

    rnd = random.Random(6)
    ddl = "strategy_id long, d date, pnl decimal(18,6)"
    rows = [(s, date(2024, 1, 1) + timedelta(days=k), round(rnd.gauss(0.2 if s else -0.3, 3), 6)) for s in range(3) for k in range(150)]
    rows = [(s, d, Decimal(str(x))) for s, d, x in rows]
    cut = [date(2024, 2, 1), date(2024, 4, 20)]
    parts = [[r for r in rows if r[1] < cut[0] and r[0] < 2], [r for r in rows if cut[0] <= r[1] < cut[1]], [r for r in rows if r[1] >= cut[1]] + [(1, date(2024, 1, 5), Decimal("-999"))]]
    path, store, verdicts, ckpt = (work_dir(spark, x) for x in ("landing", "store", "verdicts", "ckpt"))
    for part in parts:
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(path)
        query = jobs.decay_stream(spark.readStream.schema(ddl).parquet(path), store, verdicts, ckpt)
        query.awaitTermination()
        if os.path.isdir(f"{store}/new/batch=0"):  # the first batch's sessions cannot be read again
            shutil.move(f"{store}/new/batch=0", f"{store}/gone")
    kept = [r for p in parts for r in p if r[2] != -999]
    want = performance.decay_verdicts(spark.createDataFrame(kept, ddl)).collect()
    last = max(int(f.split("=")[1]) for f in os.listdir(verdicts) if f.startswith("batch="))
    got = spark.read.parquet(f"{verdicts}/batch={last}").collect()
    form = lambda rs: sorted((r.strategy_id, r.n_sessions, float(r.cumulative), round(r.full_sharpe, 8), round(r.rolling_sharpe, 8), float(r.max_drawdown), r.verdict) for r in rs)
    assert form(got) == form(want)
    assert [r.pnl for r in spark.read.parquet(f"{store}/late/batch={last}").collect()] == [-999]
