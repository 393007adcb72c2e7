"""Normalisation of landed vendor feeds: venue arrays, vendor and broker bars, JSON reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import SERIES, series_table
from ..functions.clock import CENTRAL, local_to_utc, wall_clock
from ..functions.text import iso_utc
from ..operators.ordered import segmented
from ..operators.pit import cot_known_at

PRICE = "decimal(20,8)"

# Report columns of each positioning report flavour.
COT_COLUMNS = {
    "disaggregated": ("m_money_positions_long_all", "m_money_positions_short_all", "prod_merc_positions_long", "prod_merc_positions_short"),
    "tff": ("lev_money_positions_long", "lev_money_positions_short", "dealer_positions_long_all", "dealer_positions_short_all"),
    "legacy": ("noncomm_positions_long_all", "noncomm_positions_short_all", "comm_positions_long_all", "comm_positions_short_all"),
}
COT_DATE, COT_OI, COT_CODE, COT_TRADERS = "report_date_as_yyyy_mm_dd", "open_interest_all", "cftc_contract_market_code", "traders_tot_all"

# Hours after which a daily bar counts as final, and on Fridays.
FINAL_AFTER, FINAL_AFTER_FRIDAY = 18, 42


def venue_bars(docs: DataFrame, resolution: str) -> DataFrame:
    """Bars from documents (venue, contract, payload, as_of, starts, ends).

    ``payload`` is a JSON array of [ms, open, high, low, close, volume]. Numbers are taken as written,
    never through a float. The window is half-open; a row with fewer than six fields fails the job.
    """
    rows = docs.withColumn("row", F.explode(F.regexp_extract_all("payload", F.lit(r"\[([^\[\]]*)\]"), F.lit(1))))
    t = F.transform(F.split("row", ","), lambda x: F.trim(x))
    rows = rows.withColumn("t", t)
    short = F.when(F.size("t") < 6, F.raise_error(F.concat(F.lit("short bar row: "), F.col("row")))).otherwise(F.lit(True))
    rows = rows.filter(short)
    ts = F.timestamp_millis(F.col("t")[0].cast("bigint"))
    rows = rows.withColumn("ts", ts).filter((F.col("ts") >= F.col("starts")) & (F.col("ts") < F.col("ends")))
    q = lambda k, v: F.concat(F.lit(f'"{k}": "'), v, F.lit('"'))
    text = F.concat(
        F.lit("{"), F.concat_ws(", ", q("close", F.col("t")[4]), q("contract", F.col("contract")), q("high", F.col("t")[2]), q("low", F.col("t")[3]),
                                q("open", F.col("t")[1]), q("resolution", F.lit(resolution)), F.concat(F.lit('"ts_ms": '), F.col("t")[0]),
                                q("venue", F.col("venue")), q("volume_decimal", F.col("t")[5])), F.lit("}"))
    return rows.select(
        "contract", "ts", F.lit(resolution).alias("resolution"), *[F.col("t")[i].cast(PRICE).alias(n) for i, n in enumerate(["open", "high", "low", "close"], 1)],
        F.floor(F.col("t")[5].cast(PRICE)).cast("bigint").alias("volume"), F.col("venue").alias("source_id"), "as_of", F.sha2(text, 256).alias("sha"),
    )


def vendor_daily_bars(records: DataFrame, now: Column, starts: Column, ends: Column, strict: bool = True) -> DataFrame:
    """Daily bars of one vendor: nothing dated after ``now``, half-open window, hash over the fields."""
    late = F.col("ts") > now
    if strict:
        records = records.filter(F.when(late, F.raise_error(F.lit("bar dated in the future"))).otherwise(F.lit(True)))
    else:
        records = records.filter(~late)
    r = records.filter((F.col("ts") >= starts) & (F.col("ts") < ends))
    sha = F.sha2(F.concat_ws("|", "symbol", iso_utc(F.col("ts")), *[F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume")]), 256)
    return r.withColumns({"resolution": F.lit("1d"), "sha": sha})


def broker_time(raw: Column) -> Column:
    """UTC instant of a broker's bar time: date (noon UTC), epoch seconds, or ISO text with an offset.

    Anything else, a time without an offset included, is null.
    """
    iso = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"
    return (
        F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(F.concat(raw, F.lit(" 12:00:00"))))
        .when(raw.rlike(r"^\d+(\.\d+)?$"), F.timestamp_seconds(raw.try_cast("double")))
        .when(raw.rlike(iso), raw.try_cast("timestamp"))
    )


def broker_bars(records: DataFrame, strict: bool = True) -> DataFrame:
    """Broker bars with UTC times and volumes that default to zero; bad times fail or carry a null."""
    ts = broker_time(F.col("raw_time"))
    if strict:
        ts = F.when(ts.isNull(), F.raise_error(F.concat(F.lit("bar time not usable: "), F.col("raw_time"))).cast("timestamp")).otherwise(ts)
    return records.withColumns({"ts": ts, "volume": F.coalesce(F.floor(F.col("volume")).cast("bigint"), F.lit(0).cast("bigint"))})


def settle_state_by_age(bar_ts: Column, as_of: Column) -> Column:
    hours = (F.unix_timestamp(as_of) - F.unix_timestamp(bar_ts)) / 3600
    need = F.when(F.weekday(wall_clock(bar_ts, CENTRAL)) == 4, FINAL_AFTER_FRIDAY).otherwise(FINAL_AFTER)
    return F.when(hours < need, "preliminary").otherwise("final")


def settles_from_bars(bars: DataFrame, as_of: Column) -> DataFrame:
    """Daily bars as settles: settle and last are the close, change is against the previous close."""
    b = segmented(bars, ["contract"], ["ts"], F.year("ts"), {"__prev": ("lag", F.col("close"))})
    change = (F.col("close") - F.coalesce("__prev", "close")).cast(PRICE)
    return b.select(
        "contract", F.to_date(wall_clock(F.col("ts"), CENTRAL)).alias("as_of_date"), F.col("close").alias("settle"),
        settle_state_by_age(F.col("ts"), as_of).alias("settle_state"), "open", "high", "low", F.col("close").alias("last"), change.alias("change"),
        F.coalesce("volume", F.lit(0)).alias("volume_est"), F.lit(0).cast("bigint").alias("oi_prior"), as_of.alias("as_of"),
    )


def _flavor_column(flavor: Column, position: int) -> Column:
    name = F.lit(None).cast("string")
    for f, cols in COT_COLUMNS.items():
        name = F.when(flavor == f, cols[position]).otherwise(name)
    return name


def canonical_json(m: Column) -> Column:
    """Key-sorted compact JSON of a string map."""
    pairs = F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":"'), e["value"], F.lit('"')))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def cot_reports(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reports, drifted) from JSON rows (flavor, payload); drifted rows name the missing columns."""
    d = docs.withColumn("m", F.from_json("payload", "map<string,string>"))
    need = F.array(F.lit(COT_DATE), F.lit(COT_OI), F.lit(COT_CODE), *[_flavor_column(F.col("flavor"), i) for i in range(4)])
    missing = F.array_except(need, F.map_keys("m"))
    d = d.withColumn("missing", F.array_sort(missing))
    good = d.filter(F.size("missing") == 0)
    whole = lambda name: F.element_at("m", name).cast("decimal(28,6)").cast("bigint")
    day = F.to_date(F.substring(F.element_at("m", F.lit(COT_DATE)), 1, 10))
    reports = good.select(
        F.element_at("m", F.lit(COT_CODE)).alias("code"), "flavor", day.alias("report_date"), cot_known_at(day).alias("known_at"),
        whole(F.lit(COT_OI)).alias("open_interest"),
        *[whole(_flavor_column(F.col("flavor"), i)).alias(n) for i, n in enumerate(["spec_long", "spec_short", "comm_long", "comm_short"])],
        whole(F.lit(COT_TRADERS)).alias("traders"), F.sha2(canonical_json(F.col("m")), 256).alias("sha"),
    )
    return reports, d.filter(F.size("missing") > 0).select("flavor", "payload", "missing")


def _with_release_time(df: DataFrame) -> DataFrame:
    return df.join(F.broadcast(series_table(df.sparkSession).select("series", "release_time", "publisher")), "series")


OBSERVATIONS = "struct<observations: array<struct<date: string, value: string, realtime_start: string>>>"


def vintage_values(docs: DataFrame) -> DataFrame:
    """Newest published observation of each vintage document (series, event_id, as_of, payload).

    Observations come newest first; a lone dot means missing. Known at the vintage's start date plus
    the series' release time; values not yet known at ``as_of`` are dropped.
    """
    obs = F.filter(F.from_json("payload", OBSERVATIONS)["observations"], lambda o: o["value"].isNotNull() & (o["value"] != "."))
    d = _with_release_time(docs.withColumn("o", F.get(obs, 0)).filter("o IS NOT NULL"))
    known = local_to_utc(F.to_date("o.realtime_start"), F.col("release_time"))
    return d.select(
        "series", "event_id", F.to_date("o.date").alias("ref_date"), known.alias("known_at"), F.col("o.value").cast(PRICE).alias("value"),
        "as_of", F.sha2("payload", 256).alias("sha"),
    ).filter("known_at <= as_of")


POINTS = "struct<status: string, data: array<struct<year: string, period: string, value: string>>>"


def monthly_values(docs: DataFrame, releases: DataFrame) -> DataFrame:
    """Newest monthly point of each document (series, event_id, as_of, payload).

    Periods other than M01 to M12 and blank values are skipped. Known at the calendar's release of
    (series, reference month), else at release time on the last day of the following month.
    """
    d = docs.withColumn("j", F.from_json("payload", POINTS))
    ok = F.when(F.col("j.status") != "REQUEST_SUCCEEDED", F.raise_error(F.lit("request did not succeed"))).otherwise(F.lit(True))
    pts = F.filter("j.data", lambda p: p["period"].rlike("^M(0[1-9]|1[0-2])$") & p["value"].isNotNull() & ~F.trim(p["value"]).isin("", "-", "."))
    d = _with_release_time(d.filter(ok).withColumn("p", F.get(pts, 0)).filter("p IS NOT NULL"))
    d = d.withColumn("ref_date", F.make_date(F.col("p.year").cast("int"), F.substring("p.period", 2, 2).cast("int"), F.lit(1)))
    r = releases.select("series", "ref_date", F.col("release_at").alias("__release"))
    d = d.join(r, ["series", "ref_date"], "left")
    bound = local_to_utc(F.last_day(F.add_months("ref_date", 1)), F.col("release_time"))
    return d.select("series", "event_id", "ref_date", F.coalesce("__release", bound).alias("known_at"), F.col("p.value").cast(PRICE).alias("value"), "as_of",
                    F.sha2("payload", 256).alias("sha")).filter("known_at <= as_of")


def release_events(pages: DataFrame, starts: Column, ends: Column) -> DataFrame:
    """Scheduled events from calendar pages (series, payload with release_dates), half-open window."""
    d = pages.withColumn("r", F.explode(F.from_json("payload", "struct<release_dates: array<struct<date: string>>>")["release_dates"]))
    d = _with_release_time(d.withColumn("day", F.to_date("r.date")))
    at = local_to_utc(F.col("day"), F.col("release_time"))
    event_id = F.concat_ws("_", "series", F.year("day").cast("string"), F.lpad(F.month("day").cast("string"), 2, "0"))
    d = d.withColumns({"release_at": at, "event_id": event_id}).filter((F.col("release_at") >= starts) & (F.col("release_at") < ends))
    return d.select("event_id", "series", "publisher", F.col("day").alias("release_date"), "release_at",
                    F.sha2(F.concat_ws("||", F.sha2("payload", 256), "event_id"), 256).alias("sha"))


def static_dates(spark, path: str, series: str) -> DataFrame:
    """Event dates from JSON documents that hold plain lists of ISO dates."""
    if series not in {s[0] for s in SERIES}:
        raise ValueError(f"unknown series {series!r}")
    text = spark.read.text(path, wholetext=True)
    days = F.explode(F.from_json("value", "array<string>"))
    return text.select(days.alias("d")).select(F.lit(series).alias("series"), F.to_date("d").alias("release_date")).distinct()


def marker_lines(docs: DataFrame, marker: str, codes: str) -> DataFrame:
    """Lines holding a whole-word marker, with the distinct codes on them in order of appearance."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("n", "line")).filter(F.col("line").rlike(rf"\b({marker})\b"))
    found = F.array_distinct(F.regexp_extract_all("line", F.lit(rf"\b({codes})\b"), F.lit(1)))
    return lines.select("doc_id", (F.col("n") + 1).alias("line_no"), F.trim("line").alias("line"), found.alias("codes"))


def marker_report(lines: DataFrame) -> DataFrame:
    """Counts per document, per code family (text before the dash), and of lines without a code."""
    by_doc = lines.groupBy(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    fam = lines.select(F.explode("codes").alias("c")).groupBy(F.lit("family").alias("kind"), F.split("c", "-")[0].alias("name")).agg(F.count(F.lit(1)).alias("n"))
    rest = lines.agg(F.count_if(F.size("codes") == 0).alias("n")).select(F.lit("without code").alias("kind"), F.lit("").alias("name"), "n")
    return by_doc.unionByName(fam).unionByName(rest)
