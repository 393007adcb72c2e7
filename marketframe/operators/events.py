"""Scheduled-event severity and the size gate around events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dims import series_table


def with_severity(events: DataFrame) -> DataFrame:
    """Severity and size multiplier of each event's series; unlisted series are LOW."""
    dim = series_table(events.sparkSession).select("series", "severity", "size_multiplier")
    out = events.join(F.broadcast(dim), "series", "left")
    return out.withColumns({"severity": F.coalesce("severity", F.lit("LOW")), "size_multiplier": F.coalesce("size_multiplier", F.lit(1.0))})


def event_gate(returns: DataFrame, events: DataFrame, days_lo: int, days_hi: int, exclude: Sequence[str] = (), time: str = "d") -> DataFrame:
    """Scale each return by the smallest multiplier of events ``days_lo`` to ``days_hi`` days away.

    Every event is spread to the dates it affects, so the large side meets one row per date in an
    equi-join; the spread table has (window length) x (event dates) rows at most.
    """
    e = with_severity(events.filter(~F.col("series").isin(list(exclude))) if exclude else events)
    spread = e.select(
        F.explode(F.sequence(F.date_sub("release_date", days_hi), F.date_sub("release_date", days_lo))).alias(time), "size_multiplier"
    ).groupBy(time).agg(F.min("size_multiplier").alias("multiplier"))
    out = returns.join(spread, time, "left").withColumn("multiplier", F.least(F.coalesce("multiplier", F.lit(1.0)), F.lit(1.0)))
    return out.withColumn("gated_r", F.col("r") * F.col("multiplier"))
