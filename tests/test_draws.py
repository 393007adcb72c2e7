"""Draws as runs against draws as positions: the same sums, whatever the scheme, the block and the wrap."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from marketframe.operators import resample as rs

SCHEMES = {"stationary": (rs.stationary_indices, rs.stationary_blocks), "moving": (rs.moving_indices, rs.moving_blocks), "fixed": (rs.fixed_indices, rs.fixed_blocks)}


def panel(spark, n=(7, 43)):
    rnd = random.Random(2)
    rows = [(f, s, i, rnd.choice([0.0, rnd.gauss(0, 1e-3), rnd.gauss(0, 1e5)])) for f, k in enumerate(n) for s in range(3) for i in range(k)]
    return spark.createDataFrame(rows, "family int, strategy_id int, i long, r double")


@pytest.mark.parametrize("scheme", SCHEMES)
@pytest.mark.parametrize("block", [1, 5, 7])
def test_runs_and_positions_agree(spark, scheme, block):
    p = panel(spark)
    sizes = rs.family_sizes(p)
    by_index, by_run = SCHEMES[scheme]
    sums = {"s": F.col("r"), "l": F.greatest(-F.col("r"), F.lit(0.0))}
    want = {(r.family, r.b, r.strategy_id): (r.s, r.l) for r in rs.draw_sums(p, by_index(sizes, 40, block, 9), sums).collect()}
    got = {(r.family, r.b, r.strategy_id): (r.s, r.l) for r in rs.block_sums(p, by_run(sizes, 40, block, 9), sums).collect()}
    assert got.keys() == want.keys() and len(got) == 2 * 40 * 3
    assert all(abs(a - b) < 1e-6 for k in want for a, b in zip(got[k], want[k], strict=True))
    runs = by_run(sizes, 40, block, 9)
    assert {r[0] for r in runs.groupBy("family", "b").agg((F.sum("len") == F.max("n")).alias("ok")).select("ok").collect()} == {True}


def test_no_loss_is_exactly_none(spark):
    """Differences of prefix sums must not leave traces where nothing was lost."""
    rows = [(0, 0, i, 0.1 + i / 7 if i < 20 else -0.3) for i in range(40)]
    p = spark.createDataFrame(rows, "family int, strategy_id int, i long, r double")
    runs = spark.createDataFrame([(0, 40, 0, 0, 3, 15)], "family int, n long, b int, step long, first long, len long")
    got = rs.block_sums(p, runs, {"l": F.greatest(-F.col("r"), F.lit(0.0))}).first()
    assert got.l == 0.0


@pytest.mark.parametrize("block", [2, 30])
def test_survival_paths(spark, block):
    """Runs longer than a piece and runs over the end, against a walk over positions."""
    p = panel(spark, (11,)).withColumn("r", F.when(F.abs("r") > 1, F.signum("r") * 0.05).otherwise(F.col("r") * 20))
    r = {(x.strategy_id, x.i): x.r for x in p.collect()}
    drawn = rs.stationary_indices(rs.family_sizes(p), 60, block, 4, F.lit(70)).collect()
    want = {}
    for s in range(3):
        for lev in (1.0, 4.0):
            alive = 0
            for b in range(60):
                e = low = 1.0
                for x in sorted((x for x in drawn if x.b == b), key=lambda x: x.step):
                    e *= 1 + lev * r[(s, x.i)]
                    low = min(low, e)
                alive += low > 0.7
            want[(s, lev)] = alive / 60
    got = rs.survival(p, [1.0, 4.0], 70, 60, 0.3, block, 4).collect()
    assert {(x.strategy_id, x.leverage): x.survival for x in got} == pytest.approx(want)
