"""Exchange calendar and roll calendar as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import ROOTS
from ..functions import contracts as sym

# First year with a June holiday, and the first day of round-the-clock crypto trading.
JUNE_HOLIDAY_FROM = 2022
ALL_DAY_FROM = "2026-05-29"


def _nth(year: Column, month: int, iso_weekday: int, n: int) -> Column:
    """The n-th given weekday (Monday = 0) of a month."""
    first = F.make_date(year, F.lit(month), F.lit(1))
    return F.date_add(first, (F.lit(iso_weekday) - F.weekday(first) + 7) % 7 + 7 * (n - 1))


def _last_weekday_of(first: Column, weekday: int) -> Column:
    last = F.last_day(first)
    return F.date_sub(last, (F.weekday(last) - weekday + 7) % 7)


def _observed(d: Column) -> Column:
    """Saturday holidays move to Friday, Sunday holidays to Monday."""
    return F.when(F.weekday(d) == 5, F.date_sub(d, 1)).when(F.weekday(d) == 6, F.date_add(d, 1)).otherwise(d)


def easter(year: Column) -> Column:
    """Easter Sunday: the Sunday after the ecclesiastical full moon (Gauss, with the century terms)."""
    century = F.floor(year / 100)
    moon = (15 + century - F.floor(century / 4) - F.floor((13 + 8 * century) / 25)) % 30
    sun = (4 + century - F.floor(century / 4)) % 7
    d = (19 * (year % 19) + moon) % 30
    e = (2 * (year % 4) + 4 * (year % 7) + 6 * d + sun) % 7
    day = 22 + d + e
    day = F.when((d == 29) & (e == 6), F.lit(50)).when((d == 28) & (e == 6) & (year % 19 > 10), F.lit(49)).otherwise(day)
    return F.date_add(F.make_date(year, F.lit(3), F.lit(1)), (day - 1).cast("int"))


def holidays(years: DataFrame) -> DataFrame:
    """Full-day closures for a table of years (column ``y``), weekends left aside."""
    y = F.col("y")
    fixed = lambda m, d: _observed(F.make_date(y, F.lit(m), F.lit(d)))
    days = F.array(
        fixed(1, 1), _nth(y, 1, 0, 3), _nth(y, 2, 0, 3), F.date_sub(easter(y), 2),
        _last_weekday_of(F.make_date(y, F.lit(5), F.lit(1)), 0), fixed(7, 4), _nth(y, 9, 0, 1), _nth(y, 11, 3, 4), fixed(12, 25),
        F.when(y >= JUNE_HOLIDAY_FROM, fixed(6, 19)),
    )
    return years.select(F.explode(days).alias("d")).filter("d IS NOT NULL").distinct()


def exchange_calendar(span: DataFrame, extra_closed: DataFrame | None = None, extra_open: DataFrame | None = None) -> DataFrame:
    """One row per calendar day of ``span`` (one row: ``lo``, ``hi``) with ``is_open`` and ``open_seq``.

    ``open_seq`` counts open days up to and including the day. Forced-open days beat forced closures;
    a day in both override tables fails. The table has one row per day, so a plain window is enough.
    """
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("d"))
    years = days.select(F.year("d").alias("y")).distinct()
    years = years.unionByName(years.select((F.col("y") + 1).alias("y"))).distinct()
    shut = holidays(years).withColumn("holiday", F.lit(True))
    cal = days.join(F.broadcast(shut), "d", "left").withColumn("holiday", F.coalesce("holiday", F.lit(False)))
    for name, extra in (("forced_shut", extra_closed), ("forced_open", extra_open)):
        if extra is None:
            cal = cal.withColumn(name, F.lit(False))
        else:
            marked = extra.select("d", F.lit(True).alias(name)).distinct()
            cal = cal.join(marked, "d", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    clash = F.when(F.col("forced_shut") & F.col("forced_open"), F.raise_error(F.lit("day both forced open and forced shut"))).otherwise(F.lit(True))
    is_open = F.col("forced_open") | (~F.col("forced_shut") & (F.weekday("d") < 5) & ~F.col("holiday"))
    cal = cal.filter(clash).select("d", is_open.alias("is_open"))
    seq = F.sum(F.col("is_open").cast("int")).over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0))
    return cal.withColumn("open_seq", seq.cast("long"))


def shift_days(points: DataFrame, day: str, n: Column, cal: DataFrame, out: str) -> DataFrame:
    """Move each row's ``day`` by ``n`` open days; ``n = 0`` keeps it. Null outside the calendar."""
    here = cal.select(F.col("d").alias(day), F.col("is_open").alias("__o"), F.col("open_seq").alias("__s"))
    there = cal.filter("is_open").select(F.col("open_seq").alias("__t"), F.col("d").alias("__to"))
    p = points.withColumn("__n", n).join(here, day, "left")
    target = F.col("__s") + F.col("__n") + F.when((F.col("__n") < 0) & ~F.col("__o"), 1).otherwise(0)
    moved = p.withColumn("__t", target).join(there, "__t", "left")
    return moved.withColumn(out, F.when(F.col("__n") == 0, F.col(day)).otherwise(F.col("__to"))).drop("__n", "__o", "__s", "__t", "__to")


def days_between(points: DataFrame, start: str, end: str, cal: DataFrame, out: str) -> DataFrame:
    """Open days in the closed interval [start, end]; a start after the end fails."""
    a = cal.select(F.col("d").alias(start), F.col("is_open").alias("__ao"), F.col("open_seq").alias("__as"))
    b = cal.select(F.col("d").alias(end), F.col("open_seq").alias("__bs"))
    p = points.join(a, start, "left").join(b, end, "left")
    n = F.col("__bs") - F.col("__as") + F.col("__ao").cast("int")
    bad = F.when(F.col(start) > F.col(end), F.raise_error(F.lit("start after end")).cast("long")).otherwise(n.cast("long"))
    return p.withColumn(out, bad).drop("__ao", "__as", "__bs")


def cycle_steps(spark) -> DataFrame:
    """For each root and month code, the next code and whether the year advances."""
    rows = [(r[0], c, r[4][(i + 1) % len(r[4])], int(i + 1 == len(r[4]))) for r in ROOTS for i, c in enumerate(r[4])]
    return spark.createDataFrame(rows, "root string, code string, next_code string, year_step int")


def next_contract(symbols: DataFrame, symbol: str, strict: bool = True) -> DataFrame:
    """The contract after each symbol in its root's cycle; unknown roots or codes fail when strict."""
    s = F.col(symbol)
    p = symbols.withColumns({"root": sym.contract_root(s), "code": sym.contract_code(s), "__y": sym.contract_year(s)})
    p = p.join(F.broadcast(cycle_steps(symbols.sparkSession)), ["root", "code"], "left")
    nxt = sym.contract_symbol(F.col("root"), F.col("next_code"), F.col("__y") + F.col("year_step"))
    if strict:
        nxt = F.when(nxt.isNull(), F.raise_error(F.concat(F.lit("no cycle for "), s))).otherwise(nxt)
    return p.withColumn("next_symbol", nxt).select(*symbols.columns, "next_symbol")


def roll_calendar(years: DataFrame, cal: DataFrame) -> DataFrame:
    """Every contract of every rule-bearing root for a table of years (column ``y``).

    Last trade and first notice follow the root's family; the roll target and deadline lie a number
    of open days before the anchor, and crude may not be held past the day before first notice.
    """
    rules = [(r[0], *r[4:]) for r in ROOTS if r[5] is not None]
    fields = ["root", "cycle", "family", "anchor", "target_offset", "deadline_offset"]
    each = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(fields, rule)]) for rule in rules]))
    codes = F.filter(F.split("cycle", ""), lambda c: c != "")
    c = years.select("y", each.alias("rule")).select("y", "rule.*")
    c = c.withColumn("code", F.explode(codes))
    c = c.withColumns({"contract": sym.contract_symbol(F.col("root"), F.col("code"), F.col("y"))})
    m = F.instr(F.lit(sym.MONTH_CODES), F.col("code"))
    first = F.make_date(F.col("y"), m, F.lit(1))
    nth = lambda wd, n: F.date_add(first, (F.lit(wd) - F.weekday(first) + 7) % 7 + 7 * (n - 1))
    fam = F.col("family")
    start = (
        F.when(fam == "third_friday", nth(4, 3)).when(fam == "second_friday", nth(4, 2)).when(fam == "currency", nth(2, 3))
        .when(fam == "last_friday", _last_weekday_of(first, 4)).when(fam == "crude", F.date_add(F.add_months(first, -1), 24))
        .otherwise(F.last_day(first))
    )
    # Steps from a closed start count from the open day before it (except the Nikkei family, which
    # always steps once), so "0 steps" means the start itself or the open day before.
    opens = cal.select(F.col("d").alias("start"), F.col("open_seq").alias("start_seq"), F.col("is_open").alias("start_open"))
    c = c.withColumn("start", start).join(opens, "start", "left")
    back = (
        F.when(fam == "second_friday", F.when(F.col("start_open"), -1).otherwise(0))
        .when(fam == "currency", -2).when(fam == "crude", -3).when(fam == "treasury", -7).when(fam == "metal", -2).otherwise(0)
    )
    c = c.withColumn("ltd_seq", F.col("start_seq") + back)
    prev_end = cal.select(F.col("d").alias("prev_end"), F.col("open_seq").alias("prev_seq"))
    c = c.withColumn("prev_end", F.date_sub(first, 1)).join(prev_end, "prev_end", "left")
    fnd_seq = F.when(fam == "crude", F.col("ltd_seq") + 2).when(fam.isin("metal", "treasury"), F.col("prev_seq"))
    c = c.withColumn("fnd_seq", fnd_seq)
    anchor = F.when(F.col("anchor") == "LTD", F.col("ltd_seq")).otherwise(F.col("fnd_seq"))
    deadline = anchor - F.col("deadline_offset")
    c = c.withColumns({
        "target_seq": anchor - F.col("target_offset"),
        "deadline_seq": F.when(fam == "crude", F.least(deadline, F.col("fnd_seq") - 1)).otherwise(deadline),
    })
    open_days = cal.filter("is_open").select("open_seq", "d")
    for seq, name in (("ltd_seq", "ltd"), ("fnd_seq", "fnd"), ("target_seq", "roll_target"), ("deadline_seq", "roll_deadline")):
        c = c.join(open_days.select(F.col("open_seq").alias(seq), F.col("d").alias(name)), seq, "left")
    regime = F.when((fam == "last_friday") & (F.col("ltd") >= F.lit(ALL_DAY_FROM).cast("date")), "24/7").otherwise("RTH")
    return next_contract(c.withColumn("regime", regime), "contract").select(
        "root", "contract", F.col("next_symbol").alias("back"), "ltd", "fnd", "roll_target", "roll_deadline", "regime"
    )
