"""Daily reference-rate fix from venue bars: twelve five-minute slots of the 15:00-16:00 London hour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clock import LONDON, wall_clock
from ..functions.text import iso_utc

SLOTS = 12
MIN_VENUES = 2


def reference_rate(bars: DataFrame, strict: bool = False) -> DataFrame:
    """``bars``: contract, venue, ts (UTC), close, volume. One row per contract and London date.

    Last close of each venue and slot; a slot counts with two venues or more; the fix is the mean of
    the counting slots. A day without any is null, or fails the job in strict mode.
    """
    local = wall_clock(F.col("ts"), LONDON)
    b = bars.withColumn("fix_date", F.to_date(local)).filter(F.hour(local) == 15)
    b = b.withColumn("slot", F.floor(F.minute(local) / 5).cast("int"))
    per_venue = b.groupBy("contract", "fix_date", "slot", "venue").agg(
        F.max_by("close", "ts").alias("close"),
        F.array_sort(F.collect_list(F.struct("ts", "close", "volume"))).alias("bars"),
    )
    per_slot = per_venue.groupBy("contract", "fix_date", "slot").agg(
        F.count(F.lit(1)).alias("venues"), (F.sum("close").cast("double") / F.count(F.lit(1))).alias("mean"),
        F.collect_list(F.struct("venue", "bars")).alias("inputs"),
    )
    valid = F.col("venues") >= MIN_VENUES
    out = per_slot.groupBy("contract", "fix_date").agg(
        F.avg(F.when(valid, F.col("mean"))).alias("fix"),
        F.count_if(valid).alias("slots_valid"),
        F.map_from_entries(F.collect_list(F.struct("slot", F.when(valid, F.col("mean")).alias("m")))).alias("by_slot"),
        F.flatten(F.collect_list("inputs")).alias("inputs"),
    )
    line = lambda v: F.transform(
        v["bars"],
        lambda x: F.concat_ws("|", v["venue"], iso_utc(x["ts"]), x["close"].cast("string"), x["volume"].cast("string")),
    )
    content = F.array_join(F.array_sort(F.flatten(F.transform("inputs", line))), "\n")
    fix = F.col("fix")
    if strict:
        fix = F.when(fix.isNull(), F.raise_error(F.lit("no slot has enough venues")).cast("double")).otherwise(fix)
    return out.select(
        "contract", "fix_date", fix.alias("fix"), "slots_valid",
        F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda s: F.element_at("by_slot", s)).alias("slots"),
        F.array_sort(F.array_distinct(F.transform("inputs", lambda v: v["venue"]))).alias("venues"),
        F.sha2(F.concat_ws("\n", F.concat_ws("|", "contract", F.col("fix_date").cast("string")), content), 256).alias("sha"),
    )
