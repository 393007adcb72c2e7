"""Point-in-time reads: nothing that became known after the as-of moment is ever returned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import local_to_utc
from .consensus import state_rank
from .ordered import best_so_far

DAY = 86400.0


def days(d: Column) -> Column:
    return F.datediff(d, F.lit("1970-01-01").cast("date"))


def latest_settle(settles: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """Latest settle on or before each point's ``as_of_date``; later states and hashes win ties."""
    best = F.struct(
        F.col("as_of_date").alias("date"), state_rank(F.col("settle_state")).alias("rank"), F.col("sha").alias("sha"),
        *[F.col(c) for c in settles.columns if c not in {*keys, "as_of_date", "sha"}],
    )
    return best_so_far(points, settles, keys, days(F.col("as_of_date")), days(F.col("as_of_date")), best, 366.0, "found")


def cot_known_at(report_date: Column) -> Column:
    """Friday 15:30 New York of the snapshot week; a weekend date fails."""
    wd = F.weekday(report_date)
    friday = F.date_add(report_date, 4 - wd)
    return F.when(wd > 4, F.raise_error(F.concat(F.lit("snapshot on a weekend: "), report_date.cast("string"))).cast("timestamp")).otherwise(
        local_to_utc(friday, "15:30:00")
    )


def cot_history(requests: DataFrame, reports: DataFrame, bucket_days: int = 91) -> DataFrame:
    """Reports of each request (code, since, as_of) that were public at its as-of moment.

    A request is copied to each time bucket it spans and meets the reports of that bucket only, so a
    code with many requests and many reports is never paired whole.
    """
    bucket = lambda d: F.floor(days(d) / bucket_days)
    span = F.sequence(bucket(F.col("since")), bucket(F.to_date("as_of")))
    r = requests.filter(F.col("since") <= F.to_date("as_of")).withColumn("__bucket", F.explode(span))
    return (
        r.join(reports.withColumn("__bucket", bucket(F.col("report_date"))), ["code", "__bucket"])
        .filter((F.col("report_date") >= F.col("since")) & (F.col("report_date") <= F.to_date("as_of")))
        .filter(F.col("known_at") <= F.col("as_of"))
        .drop("__bucket")
    )


def net_positioning(reports: DataFrame) -> DataFrame:
    return reports.withColumns(
        {"spec_net": F.col("spec_long") - F.col("spec_short"), "comm_net": F.col("comm_long") - F.col("comm_short")}
    )


def known_by(rows: DataFrame, as_of: Column, known_at: str = "known_at") -> DataFrame:
    return rows.filter(F.col(known_at) <= as_of)


def latest_vintage(points: DataFrame, values: DataFrame) -> DataFrame:
    """For each (series, as_of): newest reference date known by then, in its latest vintage."""
    best = F.struct("ref_date", "known_at", "value")
    return best_so_far(points, values, ["series"], days(F.col("as_of")), days(F.col("known_at")), best, 366.0, "found")


def require_value(value: Column, is_void: Column, strict: bool = False) -> Column:
    """A void release has no value: null, or a failed job in strict mode - never a zero."""
    missing = F.coalesce(is_void, F.lit(False)) | value.isNull()
    fallback = F.raise_error(F.lit("void release has no value")).cast("double") if strict else F.lit(None).cast("double")
    return F.when(missing, fallback).otherwise(value)


def schedule_drift(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Compare two copies of a release calendar: moved, cancelled and added events."""
    s = stored.select("series", "event_id", F.col("release_at").alias("stored_at"))
    c = current.select("series", "event_id", F.col("release_at").alias("current_at"))
    kind = (
        F.when(F.col("current_at").isNull(), "cancelled")
        .when(F.col("stored_at").isNull(), "added")
        .when(F.col("stored_at") != F.col("current_at"), "moved")
    )
    return s.join(c, ["series", "event_id"], "full_outer").withColumn("kind", kind).filter("kind IS NOT NULL")


def series_of_event(event_id: Column, series: list[str]) -> Column:
    """Series whose name is the event id or its prefix up to an underscore; the longest name wins."""
    names = F.array(*[F.lit(s) for s in sorted(series, key=lambda s: (-len(s), s))])
    hits = F.filter(names, lambda s: (event_id == s) | F.startswith(event_id, F.concat(s, F.lit("_"))))
    return F.get(hits, 0)
