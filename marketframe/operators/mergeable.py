"""Statistics by mergeable state, for callers who bring their own.

A statistic is three Column functions: the state of one return, the state of two neighbouring runs of
returns, and the value of a state. Nothing else is asked of it (no inverse, no order-free sum), so paths
such as a drawdown qualify. Series, segments, splits and bootstrap draws are then folds of states: in
runs of at most ``FAN`` neighbours, level by level, so no task holds a whole series.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

FAN = 256


class Statistic(NamedTuple):
    """``row(r)`` and ``merge(left, right)`` give structs of the same fields; ``value(state)`` is a double."""

    row: Callable[[Column], Column]
    merge: Callable[[Column, Column], Column]
    value: Callable[[Column], Column]

    def negated(self) -> Statistic:
        """The same state, greater where the value was less: for rules that look for the greatest."""
        return self._replace(value=lambda s: -self.value(s))


def _drawdown_row(r: Column) -> Column:
    g, one = F.greatest(1.0 + r, F.lit(0.0)), F.lit(1.0)
    return F.struct(g.alias("growth"), F.greatest(g, one).alias("peak"), F.least(g, one).alias("trough"), F.greatest(1.0 - g, F.lit(0.0)).alias("drawdown"))


def _drawdown_merge(a: Column, b: Column) -> Column:
    across = 1.0 - a["growth"] * b["trough"] / a["peak"]
    return F.struct(
        (a["growth"] * b["growth"]).alias("growth"), F.greatest(a["peak"], a["growth"] * b["peak"]).alias("peak"),
        F.least(a["trough"], a["growth"] * b["trough"]).alias("trough"), F.greatest(a["drawdown"], b["drawdown"], across).alias("drawdown"),
    )


#: Largest loss from a peak of the compounded returns, as a share of the peak; a return of -1 or less is ruin (1).
MAX_DRAWDOWN = Statistic(_drawdown_row, _drawdown_merge, lambda s: s["drawdown"])


def merged(states: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """One state from an array of states in order; null for an empty array."""
    return F.when(F.size(states) > 0, F.reduce(F.slice(states, 2, 2**30), F.get(states, F.lit(0)), merge))


def fold(states: DataFrame, keys: Sequence[str], place: str, longest: int, merge: Callable[[Column, Column], Column]) -> DataFrame:
    """One row per key: its ``state`` columns merged in order of ``place`` (whole numbers from 0 to below ``longest``).

    Every level merges the rows of ``FAN`` consecutive places, so a long key is spread over its runs.
    """
    while longest > 1:
        run = states.groupBy(*keys, F.floor(F.col(place) / FAN).alias("__run")).agg(F.array_sort(F.collect_list(F.struct(F.col(place).alias("at"), "state"))).alias("__held"))
        states = run.select(*keys, F.col("__run").alias(place), merged(F.transform("__held", lambda h: h["state"]), merge).alias("state"))
        longest = -(-longest // FAN)
    return states.select(*keys, "state")


def series_states(panel: DataFrame, keys: Sequence[str], statistic: Statistic) -> DataFrame:
    """(keys, state) of returns ``r`` at positions ``i``. The driver reads one number, the longest series."""
    longest = (panel.agg(F.max("i")).first()[0] or 0) + 2  # two at least, so that one place is folded too
    return fold(panel.select(*keys, "i", statistic.row(F.col("r")).alias("state")), keys, "i", longest, statistic.merge)


def run_states(panel: DataFrame, longest_run: int, statistic: Statistic) -> DataFrame:
    """(family, strategy_id, k, at, state): the states of all circular runs of 2^k returns from ``at`` on, up to ``longest_run``.

    Each level joins the one before it with itself, half a run further on; levels are written.
    """
    size = panel.groupBy("family").agg((F.max("i") + 1).alias("n"))
    level = panel.join(size, "family").select("family", "strategy_id", "n", F.col("i").cast("long").alias("at"), statistic.row(F.col("r")).alias("state"))
    level, k, levels = cut_lineage(level, "runs"), 0, []
    while True:
        levels.append(level.select("family", "strategy_id", F.lit(k).alias("k"), "at", "state"))
        if 2 ** (k + 1) > longest_run:
            break
        after = level.select("family", "strategy_id", F.col("at").alias("next"), F.col("state").alias("after"))
        both = level.withColumn("next", (F.col("at") + 2**k) % F.col("n")).join(after, ["family", "strategy_id", "next"])
        level = cut_lineage(both.select("family", "strategy_id", "n", "at", statistic.merge(F.col("state"), F.col("after")).alias("state")), "runs")
        k += 1
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def draw_states(panel: DataFrame, blocks: DataFrame, statistic: Statistic) -> DataFrame:
    """(family, strategy_id, b, state) of draws given as circular runs (family, n, b, step, first, len).

    A run is cut into lengths that are powers of two, at most one of each, whose states are looked up: a
    draw costs its blocks times about half the logarithm of their length, and is folded in order of its steps.
    """
    top = blocks.agg(F.max("len").alias("len"), F.max(F.col("step") + F.col("len")).alias("end")).first()
    longest, end = top["len"] or 1, top["end"] or 1
    table = run_states(panel, longest, statistic)
    length = F.col("len").cast("long")

    def piece(k):
        before = length.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1)
        return F.struct(k.alias("k"), ((F.col("first") + before) % F.col("n")).cast("long").alias("at"), (F.col("step") + before).alias("place"))

    bits = F.filter(F.sequence(F.lit(0), F.lit(longest.bit_length() - 1)), lambda k: F.call_function("getbit", length, k) == 1)
    pieces = blocks.select("family", "b", F.explode(F.transform(bits, piece)).alias("p")).select("family", "b", "p.*")
    return fold(pieces.join(table, ["family", "k", "at"]).drop("k", "at"), ["family", "strategy_id", "b"], "place", end + 1, statistic.merge)
