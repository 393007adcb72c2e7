"""Statistics by mergeable state against plain loops: series, draws and splits."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from marketframe.operators import crossval as cv
from marketframe.operators import resample as rs
from marketframe.operators.mergeable import MAX_DRAWDOWN, Statistic, draw_states, series_states

#: first and last return of a run: order matters, and nothing can be undone
ENDS = Statistic(lambda r: F.struct(r.alias("a"), r.alias("z")), lambda a, b: F.struct(a["a"].alias("a"), b["z"].alias("z")), lambda s: s["a"] * 10 + s["z"])


def plain_drawdown(returns):
    level, peak, worst = 1.0, 1.0, 0.0
    for r in returns:
        level *= max(1 + r, 0.0)
        peak = max(peak, level)
        worst = max(worst, 1 - level / peak)
    return worst


PLAIN = {"drawdown": (MAX_DRAWDOWN, plain_drawdown), "ends": (ENDS, lambda x: x[0] * 10 + x[-1])}


def panel(spark, lengths):
    rnd = random.Random(4)
    rows = [(f, s, i, rnd.choice([rnd.gauss(0, 0.05), 0.0, -1.0 if rnd.random() < 0.001 else 0.01])) for f, n in enumerate(lengths) for s in range(2) for i in range(n)]
    rnd.shuffle(rows)
    series = {}
    for f, s, _, r in sorted(rows):
        series.setdefault((f, s), []).append(r)
    return spark.createDataFrame(rows, "family int, strategy_id int, i long, r double"), series


@pytest.mark.parametrize("name", PLAIN)
def test_series(spark, name):
    statistic, plain = PLAIN[name]
    p, series = panel(spark, (1, 2, 700))
    got = {(r.family, r.strategy_id): r.v for r in series_states(p, rs.KEYS, statistic).select(*rs.KEYS, statistic.value(F.col("state")).alias("v")).collect()}
    assert got.keys() == series.keys()
    assert all(abs(got[k] - plain(series[k])) < 1e-9 for k in series)


@pytest.mark.parametrize(("name", "scheme"), [("drawdown", "stationary"), ("ends", "moving"), ("drawdown", "fixed")])
def test_draws(spark, name, scheme):
    statistic, plain = PLAIN[name]
    p, series = panel(spark, (7, 300))
    sizes = rs.family_sizes(p)
    indices = {"stationary": rs.stationary_indices, "moving": rs.moving_indices, "fixed": rs.fixed_indices}[scheme](sizes, 6, 5, 3).collect()
    blocks = {"stationary": rs.stationary_blocks, "moving": rs.moving_blocks, "fixed": rs.fixed_blocks}[scheme](sizes, 6, 5, 3)
    places = {}
    for r in sorted(indices, key=lambda r: r.step):
        places.setdefault((r.family, r.b), []).append(r.i)
    got = {(r.family, r.strategy_id, r.b): r.v for r in draw_states(p, blocks, statistic).select(*rs.KEYS, "b", statistic.value(F.col("state")).alias("v")).collect()}
    want = {(f, s, b): plain([series[f, s][i] for i in at]) for (f, b), at in places.items() for s in range(2)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("name", PLAIN)
def test_splits(spark, name):
    statistic, plain = PLAIN[name]
    p, series = panel(spark, (29,))
    got = {(r.strategy_id, r.mask): (r.ins, r.oos) for r in cv.overfitting_splits(p, 4, metric=statistic).collect()}
    size = 29 // 4
    assert len(got) == 2 * 6
    for s, chosen in itertools.product(range(2), itertools.combinations(range(4), 2)):
        half = lambda own: [r for g in range(4) if (g in chosen) == own for r in series[0, s][g * size : (g + 1) * size]]  # noqa: E731, B023
        want = plain(half(True)), plain(half(False))
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[s, sum(1 << g for g in chosen)], want, strict=True))


def test_no_rows(spark):
    p, _ = panel(spark, ())
    assert series_states(p, rs.KEYS, MAX_DRAWDOWN).count() == 0
