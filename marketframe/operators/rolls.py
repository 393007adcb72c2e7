"""Continuous series from per-contract bars: splice, roll events, adjusted closes, carry, roll decisions.

The tables ``calendar``, windows and events have one row per contract; the bars are the large side and
meet them by an equi-join on contract that AQE turns into a broadcast when the small side is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import best_so_far, segmented
from .pit import days


def month_of(d: Column) -> Column:
    return F.year(d) * 12 + F.month(d)


def active_windows(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Half-open window [previous roll target, own roll target) of each contract that has bars."""
    present = bars.select("root", "contract").distinct()
    dim = calendar.drop("root").withColumn("__known", F.lit(True))
    joined = present.join(dim, "contract", "left")
    known = F.when(
        F.col("__known").isNull(), F.raise_error(F.concat(F.lit("contract is not in the roll calendar: "), F.col("contract")))
    ).otherwise(F.lit(True))
    chain = Window.partitionBy("root").orderBy("roll_target", "contract")
    return joined.filter(known).drop("__known").withColumn("starts", F.lag("roll_target").over(chain))


def splice(bars: DataFrame, windows: DataFrame) -> DataFrame:
    """Keep each bar that falls into its contract's active window."""
    w = windows.select("root", "contract", "starts", "roll_target")
    kept = bars.join(w, ["root", "contract"])
    return kept.filter(
        (F.col("starts").isNull() | (F.col("d") >= F.col("starts"))) & (F.col("d") < F.col("roll_target"))
    ).select(*bars.columns)


def roll_flags(spliced: DataFrame) -> DataFrame:
    """Mark the first bar of each new contract; also the contract before it."""
    out = segmented(spliced, ["root"], ["d"], month_of(F.col("d")), {"prev_contract": ("lag", F.col("contract"))})
    changed = F.col("prev_contract").isNotNull() & (F.col("prev_contract") != F.col("contract"))
    return out.withColumn("roll_flag", changed)


def roll_clean_returns(spliced: DataFrame) -> DataFrame:
    """Close-to-close returns; null on the first row, across a roll, and on a zero base."""
    out = segmented(
        spliced, ["root"], ["d"], month_of(F.col("d")), {"__p": ("lag", F.struct("contract", "close"))}
    )
    base = F.col("__p.close").cast("double")
    clean = (F.col("__p.contract") == F.col("contract")) & (base != 0)
    return out.withColumn("clean_return", F.when(clean, F.col("close").cast("double") / base - 1)).drop("__p")


def roll_events(flagged: DataFrame, bars: DataFrame, windows: DataFrame, strict: bool = True) -> DataFrame:
    """One row per contract change: closes of both contracts around the roll date and the gap."""
    changes = flagged.filter("roll_flag").select("root", F.col("prev_contract").alias("old_contract"), F.col("contract").alias("new_contract"))
    dates = windows.select(F.col("contract").alias("old_contract"), F.col("roll_target").alias("roll_date"))
    changes = changes.join(dates, "old_contract")
    old = (
        bars.select(F.col("contract").alias("old_contract"), "d", "close").join(changes, "old_contract")
        .filter("d <= roll_date").groupBy("old_contract").agg(F.max_by("close", "d").alias("front_settle"))
    )
    new = (
        bars.select(F.col("contract").alias("new_contract"), "d", "close").join(changes, "new_contract")
        .filter("d >= roll_date").groupBy("new_contract").agg(F.min_by("close", "d").alias("back_settle"))
    )
    out = changes.join(old, "old_contract", "left").join(new, "new_contract", "left")
    if strict:
        missing = F.col("front_settle").isNull() | F.col("back_settle").isNull()
        ok = F.when(missing, F.raise_error(F.concat(F.lit("no bar on one side of the roll of "), F.col("old_contract")))).otherwise(F.lit(True))
        out = out.filter(ok)
    return out.withColumn("roll_gap", F.col("back_settle") - F.col("front_settle"))


def ratio_adjusted(spliced: DataFrame, events: DataFrame) -> DataFrame:
    """Research view: closes times the product of all later back/front ratios."""
    later = Window.partitionBy("root").orderBy(F.col("roll_date").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ratio = F.log(F.col("back_settle").cast("double") / F.col("front_settle").cast("double"))
    factors = events.select("root", F.col("old_contract").alias("contract"), F.exp(F.sum(ratio).over(later)).alias("factor"))
    return spliced.join(factors, ["root", "contract"], "left").withColumn(
        "adjusted_close", F.col("close").cast("double") * F.coalesce("factor", F.lit(1.0))
    ).drop("factor")


def carry_inputs(bars: DataFrame, calendar: DataFrame, windows: DataFrame) -> DataFrame:
    """Front close with the latest close of the next contract, and days to both expiries.

    A day without both legs, with a price at or below zero, or without 0 < days_front < days_back is
    dropped.
    """
    front = splice(bars, windows).select("root", F.col("contract").alias("front"), "d", F.col("close").alias("front_close"))
    cal = calendar.select(F.col("contract").alias("front"), F.col("back").alias("back"), F.col("ltd").alias("front_ltd"))
    backs = calendar.select(F.col("contract").alias("back"), F.col("ltd").alias("back_ltd"))
    pairs = front.join(cal, "front").join(backs, "back")
    facts = bars.select(F.col("contract").alias("back"), "d", "close")
    found = best_so_far(pairs, facts, ["back"], days(F.col("d")), days(F.col("d")), F.struct("d", "close"), 31.0, "leg")
    out = found.select(
        "root", "d", "front", "back", "front_close", F.col("leg.close").alias("back_close"),
        F.datediff("front_ltd", "d").alias("days_front"), F.datediff("back_ltd", "d").alias("days_back"),
    )
    return out.filter(
        (F.col("back_close") > 0) & (F.col("front_close") > 0) & (F.col("days_front") > 0) & (F.col("days_front") < F.col("days_back"))
    )


def active_contract(spliced: DataFrame, points: DataFrame) -> DataFrame:
    """Contract of the latest spliced bar on or before each (root, d) point; null before the first."""
    got = best_so_far(points, spliced, ["root"], days(F.col("d")), days(F.col("d")), F.struct("d", "contract"), 31.0, "hit")
    return got.select(*points.columns, F.col("hit.contract").alias("contract"))


def roll_decisions(positions: DataFrame, calendar: DataFrame, divergent: DataFrame, spread_orders: bool = True) -> DataFrame:
    """What to do with each open position ``(contract, qty, today)``: roll, roll late, or nothing."""
    cal = calendar.select("contract", "back", "roll_target", "roll_deadline")
    pairs = divergent.select(F.col("contract"), "back", F.lit(True).alias("diverges")).distinct()
    p = positions.filter("qty <> 0").join(cal, "contract").join(pairs, ["contract", "back"], "left")
    inside = (F.col("today") >= F.col("roll_target")) & (F.col("today") <= F.col("roll_deadline"))
    late = F.col("today") > F.col("roll_deadline")
    diverges = F.coalesce("diverges", F.lit(False))
    method = (
        F.when(inside & diverges, "SEQUENTIAL")
        .when(inside, "CALENDAR_SPREAD" if spread_orders else "SEQUENTIAL")
        .when(late, "SEQUENTIAL_EMERGENCY")
    )
    reason = F.when(inside & diverges, "divergence").when(inside, "on schedule").when(late, "past deadline")
    return p.withColumns({"method": method, "reason": reason}).filter("method IS NOT NULL").drop("diverges", "roll_target")


def roll_bookings(events: DataFrame, daily_net: DataFrame, multipliers: DataFrame) -> DataFrame:
    """Paired legs for every account that holds the chain when it rolls, and what the roll costs.

    ``daily_net``: account, root, d, net after the day's fills. The position that rolls is the one
    from before the roll date.
    """
    who = daily_net.select("account", "root").distinct().join(events, "root")
    got = best_so_far(
        who, daily_net, ["account", "root"], days(F.col("roll_date")), days(F.col("d")) + 1, F.struct("d", "net"), 31.0, "held"
    )
    qty = F.coalesce(F.col("held.net"), F.lit(0))
    out = got.withColumn("qty", qty).filter("qty <> 0").join(multipliers, "root")
    return out.select(
        "account", "root", "roll_date", "old_contract", "new_contract", "qty", "front_settle", "back_settle",
        (-F.col("qty")).alias("front_leg_qty"), F.col("qty").alias("back_leg_qty"),
        ((F.col("back_settle") - F.col("front_settle")).cast("double") * F.col("qty") * F.col("multiplier").cast("double")).alias("roll_cost"),
    )
