"""Registered queries: archive, ledger, feeds, validation, corpus scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions.text import clean_number, is_bad_number
from ..operators import validate
from ..schemas import SCHEMAS
from ..session import work_dir
from ..sources import archive, feeds, ledger, settlement_pages
from ..sources.custom import LandedFolder, feed_source
from .quote_queries import EVENTS_SQL, _events
from .views import load, present, sql, v_bars, v_contract_bars, v_cot, v_macro, v_quotes, v_ret, v_settles, view

BAR_COLS = [c.split()[0] for c in SCHEMAS["bar"].split(", ")]

_ARCHIVES: dict[tuple, tuple[str, list]] = {}


def bar_archive(spark, sf):
    """An archive written in three overlapping batches: first half, everything, everything again."""
    key = (spark.sparkContext.applicationId, sf, "bars")
    if key not in _ARCHIVES:
        q = v_quotes(spark, sf).withColumn("oi", F.lit(None).cast("bigint")).select(*BAR_COLS)
        path = work_dir(spark, "archive")
        half = q.filter(F.dayofmonth("ts") <= 15)
        results = [archive.write_bars(half.unionByName(half.filter("volume > 1")), path), archive.write_bars(q, path), archive.write_bars(q, path)]
        _ARCHIVES[key] = (path, results)
    return _ARCHIVES[key]


def settle_archive(spark, sf):
    key = (spark.sparkContext.applicationId, sf, "settles")
    if key not in _ARCHIVES:
        s = v_settles(spark, sf).withColumns({"change": F.lit(0).cast("decimal(20,8)"), "oi_prior": F.lit(0).cast("bigint")})
        s = s.select(*[c.split()[0] for c in SCHEMAS["settle"].split(", ")])
        path = work_dir(spark, "archive")
        first = s.filter("settle_state <> 'final'")
        _ARCHIVES[key] = (path, [archive.write_settles(first, path), archive.write_settles(s, path)])
    return _ARCHIVES[key]


def s1(spark, sf):
    """Stored rows per partition after the three writes."""
    path, _ = bar_archive(spark, sf)
    return present(spark.read.parquet(f"{path}/bars").groupBy("root", "resolution", "year", "month").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("sha").alias("hashes"), F.sum("close").alias("closes")))


def s1_counts(spark, sf):
    """What each of the three writes reported, next to the sizes of its batch."""
    _, results = bar_archive(spark, sf)
    q = v_quotes(spark, sf)
    half = F.dayofmonth("ts") <= 15
    n = q.agg(F.count_if(half).alias("h"), F.count_if(half & (F.col("volume") > 1)).alias("d"), F.count(F.lit(1)).alias("n"))
    batch = F.array(*[F.struct(F.lit(i).alias("batch"), F.lit(r.rows_written).alias("written"), F.lit(r.rows_skipped).alias("skipped")) for i, r in enumerate(results)])
    sizes = F.array(F.col("h") + F.col("d"), F.col("n"), F.col("n"))
    return present(n.withColumn("r", F.explode(batch)).select("r.*", F.element_at(sizes, F.col("r.batch") + 1).alias("submitted")))


def s2(spark, sf):
    """One contract's half-month, both window kinds."""
    path, _ = bar_archive(spark, sf)
    out = None
    for inclusive in (False, True):
        r = archive.read_bars(spark, path, "CLH24", "1h", "2024-01-10 00:00:00", "2024-01-20 00:00:00", inclusive)
        r = r.select(F.lit(inclusive).alias("inclusive"), "ts", "source_id", "close", "sha")
        out = r if out is None else out.unionByName(r)
    return present(out)


def s3(spark, sf):
    path, _ = settle_archive(spark, sf)
    return present(spark.read.parquet(f"{path}/settles").groupBy("root", "year", "settle_state").agg(F.count(F.lit(1)).alias("n"), F.sum("settle").alias("total")))


def s4(spark, sf):
    path, _ = settle_archive(spark, sf)
    return present(archive.read_settles(spark, path, "ESH99", "1998-12-01", "1999-02-15").select("as_of_date", "settle_state", "settle", "sha"))


def s5(spark, sf):
    path, _ = bar_archive(spark, sf)
    archive.register(spark, path)
    return present(archive.query(
        spark, "SELECT contract, month, count(*) AS n, sum(close) AS total, grouping_id(contract, month) AS g FROM bars WHERE close >= :low GROUP BY CUBE (contract, month)", {"low": 105}))


def s5_where(spark, sf):
    path, _ = settle_archive(spark, sf)
    return present(archive.query_table(spark, path, "settles", "contract, max(settle) AS top", "root = :r GROUP BY contract", {"r": "GC"}))


def s15(spark, sf):
    """Sessions of each strategy written in two batches to a JSON-lines ledger, then read back."""
    key = (spark.sparkContext.applicationId, sf, "ledger")
    if key not in _ARCHIVES:
        path = work_dir(spark, "ledger")
        s = v_ret(spark, sf).select(
            F.col("strategy_id").cast("string").alias("sleeve"), F.col("d").alias("session_date"), (F.col("r") > 0).alias("qualified"),
            F.lit(1).cast("bigint").alias("contracts"), F.lit(None).cast("decimal(20,8)").alias("entry_price"), F.lit(None).cast("decimal(20,8)").alias("exit_price"),
            (F.col("r") * 1000).cast("decimal(18,6)").alias("session_pnl"), F.lit(1).cast("decimal(18,6)").alias("cost"))
        ledger.record_sessions(s.filter("session_date < '1999-01-01'"), path)
        ledger.record_sessions(s.filter("session_date >= '1998-06-01'"), path, strict=False)
        _ARCHIVES[key] = (path, [])
    return present(ledger.read_ledger(spark, _ARCHIVES[key][0]).select("sleeve", "session_date", "qualified", "session_pnl", "cumulative_pnl"))


S15_SQL = sql(
    """WITH s AS (SELECT strategy_id::VARCHAR AS sleeve, d, r > 0 AS qualified, CAST(r * 1000 AS DECIMAL(18,6)) AS p FROM v_ret)
    SELECT sleeve, d::VARCHAR AS session_date, qualified, p::DOUBLE AS session_pnl, round(sum(p) OVER (PARTITION BY sleeve ORDER BY d)::DOUBLE, 6) AS cumulative_pnl FROM s"""
)


def landed_feed(spark, sf):
    """All quotes landed by day and read through a data source of their own: the last week in a window, then everything."""
    path = work_dir(spark, "feed")
    q = v_quotes(spark, sf).select(*FEED_COLS)
    q.withColumn("day", F.to_date("ts")).repartition("day").write.partitionBy("day").parquet(path)
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in q.schema)
    spark.dataSource.register(feed_source(LandedFolder(path, ddl), "landed_quotes"))
    read = lambda **window: spark.read.format("landed_quotes").options(**window).load()
    both = read(starts="2024-01-20T12:00:00").withColumn("read", F.lit("window")).unionByName(read().withColumn("read", F.lit("all")))
    return present(both.groupBy("read", "contract", "source_id").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"), F.max("close").alias("top"), F.min("ts").alias("first")))


FEED_COLS = ["contract", "ts", "close", "volume", "source_id", "as_of"]
LANDED_FEED_SQL = sql(
    """WITH q AS (SELECT 'all' AS read, * FROM v_quotes UNION ALL SELECT 'window', * FROM v_quotes WHERE ts >= TIMESTAMP '2024-01-20 12:00:00')
    SELECT read, contract, source_id, count(*) AS n, sum(volume)::BIGINT AS volume, max(close)::DOUBLE AS top, min(ts)::VARCHAR AS first FROM q GROUP BY ALL"""
)


@view(stored=True)
def v_pages(spark, sf):
    """One settlement page per root and day, with defects planted by day number."""
    b = v_contract_bars(spark, sf)
    n = F.datediff("d", F.lit("1990-01-01").cast("date"))
    months = F.array(*[F.lit(m) for m in settlement_pages.MONTHS])
    code = F.instr(F.lit("FGHJKMNQUVXZ"), F.substring("contract", -3, 1))
    num = lambda c: F.format_number(F.col(c).cast("double"), 2)
    td = lambda x: F.concat(F.lit("<td> "), x, F.lit(" </td>"))
    row = F.concat(
        F.lit("<tr>"), td(F.concat_ws(" ", F.element_at(months, code), F.substring("contract", -2, 2))),
        td(F.when(n % 5 == 0, F.lit("---")).otherwise(num("open"))), td(num("high")), td(num("low")), td(F.lit("-")), td(F.concat(F.lit("+"), F.lit("1.25"))),
        td(F.when((n % 7 == 0) & (code == 3), F.lit("n/a")).otherwise(num("close"))), td(F.when(n % 11 == 0, F.lit("bad")).otherwise(F.format_number("volume", 0))),
        td(F.lit("1,234")), F.when(n % 17 == 0, F.lit("<td>x</td>")).otherwise(F.lit("")), F.lit("</tr>"))
    rows = b.withColumn("row", row).withColumn("n", n).groupBy("root", "d", "n").agg(F.array_join(F.array_sort(F.collect_list("row")), "\n").alias("rows"))
    head = F.concat(*[F.lit(f"<th>{h}</th>") if h != "Last" else F.when(F.col("n") % 23 == 0, F.lit("<th>Close</th>")).otherwise(F.lit("<th>Last</th>")) for h in settlement_pages.HEADERS])
    table = F.concat(F.lit("<table><tr><td>menu</td></tr></table><table id=\"settlementsTable\"><thead><tr>"), head, F.lit("</tr></thead><tbody>"),
                     F.when(F.col("n") % 29 == 0, F.lit("")).otherwise(F.col("rows")), F.lit("</tbody></table>"))
    status = F.when(F.col("n") % 3 == 0, F.lit("<span class=\"status-value\">Final</span>")).when(F.col("n") % 3 == 1, F.lit("<p>Final</p>")).otherwise(F.lit("<p>Final or Preliminary</p>"))
    body = F.when(F.col("n") % 31 == 0, F.lit("<p>nothing here</p>")).when(F.col("n") % 37 == 0, F.lit("<p>Just a moment...</p>")).otherwise(table)
    page_id = F.col("n").cast("bigint") * 10 + F.instr(F.lit("ECGZ"), F.substring("root", 1, 1))
    return rows.select(page_id.alias("page_id"), "root", F.col("d").alias("as_of_date"), F.timestamp_add("HOUR", F.lit(23), F.col("d").cast("timestamp")).alias("as_of"),
                       F.concat(F.lit("<html><body>"), status, body, F.lit("</body></html>")).alias("html"))


def s6(spark, sf):
    good, _ = settlement_pages.parse_pages(v_pages(spark, sf))
    return present(good.select("page_id", "contract", "as_of_date", "settle", "settle_state", "open", "high", "low", "last", "change", "volume_est", "oi_prior"))


_PAGE = """WITH b AS (SELECT *, date_diff('day', DATE '1990-01-01', d) AS n, instr('ECGZ', root[1]) AS ri, contract[-3] AS code FROM v_contract_bars)"""
S6_SQL = sql(
    _PAGE + """ SELECT (n * 10 + ri)::BIGINT AS page_id, contract, d::VARCHAR AS as_of_date, round(close::DOUBLE, 2) AS settle, CASE WHEN n % 3 = 2 THEN 'preliminary' ELSE 'final' END AS settle_state,
      round((CASE WHEN n % 5 = 0 THEN close ELSE open END)::DOUBLE, 2) AS open, round(high::DOUBLE, 2) AS high, round(low::DOUBLE, 2) AS low, round(close::DOUBLE, 2) AS last, 1.25e0 AS change,
      volume AS volume_est, 1234::BIGINT AS oi_prior FROM b WHERE n % 23 <> 0 AND n % 29 <> 0 AND n % 31 <> 0 AND n % 37 <> 0 AND n % 17 <> 0 AND n % 11 <> 0 AND NOT (n % 7 = 0 AND code = 'H')"""
)


def s6_problems(spark, sf):
    _, bad = settlement_pages.parse_pages(v_pages(spark, sf))
    return present(bad.groupBy("problem").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_id").alias("pages")))


S6P_SQL = sql(
    _PAGE + """, p AS (SELECT *, CASE WHEN n % 31 = 0 THEN 'no table' WHEN n % 37 = 0 THEN 'challenge' WHEN n % 23 = 0 THEN 'header drift' WHEN n % 29 = 0 THEN 'empty body'
        WHEN n % 17 = 0 THEN 'cell count' WHEN n % 11 = 0 AND NOT (n % 7 = 0 AND code = 'H') THEN 'number text' END AS problem FROM b)
    SELECT problem, CASE WHEN problem IN ('cell count', 'number text') THEN count(*) ELSE count(DISTINCT (root, d)) END AS n, count(DISTINCT (root, d)) AS pages FROM p WHERE problem IS NOT NULL GROUP BY problem"""
)


def s7(spark, sf):
    """One payload per contract and day, window cut at both ends."""
    b = v_bars(spark, sf)
    row = F.concat(F.lit("["), F.concat_ws(", ", (F.unix_timestamp("ts") * 1000).cast("string"), *[F.col(c).cast("decimal(20,2)").cast("string") for c in ("open", "high", "low", "close")],
                                           F.concat(F.col("volume").cast("string"), F.lit(".75"))), F.lit("]"))
    d = b.withColumn("row", row).groupBy("contract", F.to_date("ts").alias("day")).agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("row")), ", "), F.lit("]")).alias("payload"))
    at = lambda h: F.timestamp_add("HOUR", F.lit(h), F.col("day").cast("timestamp"))
    d = d.select("contract", F.lit("kraken").alias("venue"), "payload", at(48).alias("as_of"), at(2).alias("starts"), at(20).alias("ends"))
    return present(feeds.venue_bars(d, "1h").select("contract", "ts", "open", "high", "low", "close", "volume", "sha"))


S7_SQL = sql(
    """WITH t AS (SELECT *, open::DECIMAL(20,2)::VARCHAR AS o, high::DECIMAL(20,2)::VARCHAR AS h, low::DECIMAL(20,2)::VARCHAR AS l, close::DECIMAL(20,2)::VARCHAR AS c FROM v_bars WHERE hour(ts) >= 2 AND hour(ts) < 20)
    SELECT contract, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, open::DOUBLE AS open, high::DOUBLE AS high, low::DOUBLE AS low, close::DOUBLE AS close, volume,
      sha256('{"close": "' || c || '", "contract": "' || contract || '", "high": "' || h || '", "low": "' || l || '", "open": "' || o || '", "resolution": "1h", "ts_ms": ' || (epoch(ts)::BIGINT * 1000)::VARCHAR
        || ', "venue": "kraken", "volume_decimal": "' || volume::VARCHAR || '.75"}') AS sha FROM t"""
)


def _daily(spark, sf):
    return v_contract_bars(spark, sf).withColumn("ts", F.col("d").cast("timestamp"))


def s8(spark, sf):
    d = _daily(spark, sf).withColumn("symbol", F.concat("root", F.lit(".c.0")))
    ts = lambda s: F.lit(s).cast("timestamp")
    out = feeds.vendor_daily_bars(d, ts("1999-06-30 00:00:00"), ts("1998-01-01 00:00:00"), ts("2000-01-01 00:00:00"), strict=False)
    return present(out.select("contract", "ts", "close", "resolution", "sha"))


S8_SQL = sql(
    """SELECT contract, strftime(d, '%Y-%m-%d 00:00:00') AS ts, close::DOUBLE AS close, '1d' AS resolution,
      sha256(root || '.c.0|' || strftime(d, '%Y-%m-%dT00:00:00+00:00') || '|' || open::VARCHAR || '|' || high::VARCHAR || '|' || low::VARCHAR || '|' || close::VARCHAR || '|' || volume::VARCHAR) AS sha
    FROM v_contract_bars WHERE d >= DATE '1998-01-01' AND d <= DATE '1999-06-30'"""
)


def s9(spark, sf):
    e = load(spark, sf, "events")
    k = F.col("event_id") % 4
    raw = (
        F.when(k == 0, F.to_date("ts").cast("string")).when(k == 1, F.unix_timestamp("ts").cast("string"))
        .when(k == 2, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-05:00"))).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")))
    b = e.select("event_id", raw.alias("raw_time"), F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise(F.col("value")).alias("volume"))
    return present(feeds.broker_bars(b, strict=False).select("event_id", "raw_time", "ts", "volume"))


S9_SQL = """WITH e AS (SELECT event_id, event_id % 4 AS k, date_trunc('second', ts) AS ts, CASE WHEN event_id % 3 = 0 THEN 0 ELSE floor(value)::BIGINT END AS volume FROM events)
    SELECT event_id, CASE k WHEN 0 THEN CAST(ts AS DATE)::VARCHAR WHEN 1 THEN epoch(ts)::BIGINT::VARCHAR WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '-05:00' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS raw_time,
      strftime(CASE k WHEN 0 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 12 HOUR WHEN 1 THEN ts WHEN 2 THEN ts + INTERVAL 5 HOUR END, '%Y-%m-%d %H:%M:%S') AS ts, volume FROM e"""


def s10(spark, sf):
    b = _daily(spark, sf).withColumn("ts", F.timestamp_add("HOUR", F.lit(22), "ts"))
    as_of = F.timestamp_add("HOUR", (F.lit(10) + F.dayofmonth("d") * 2).cast("int"), F.col("ts"))
    return present(feeds.settles_from_bars(b.withColumn("asof", as_of), F.col("asof")).select("contract", "as_of_date", "settle", "settle_state", "change", "volume_est"))


S10_SQL = sql(
    """WITH t AS (SELECT *, CAST(d AS TIMESTAMP) + INTERVAL 22 HOUR AS ts, 10 + day(d) * 2 AS h, lag(close) OVER (PARTITION BY contract ORDER BY d) AS p FROM v_contract_bars),
    c AS (SELECT *, CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Chicago' AS TIMESTAMP) AS ct FROM t)
    SELECT contract, CAST(ct AS DATE)::VARCHAR AS as_of_date, close::DOUBLE AS settle, CASE WHEN h < CASE WHEN isodow(ct) = 5 THEN 42 ELSE 18 END THEN 'preliminary' ELSE 'final' END AS settle_state,
      (close - coalesce(p, close))::DOUBLE AS change, volume AS volume_est FROM c"""
)


def _cot_docs(spark, sf):
    c = v_cot(spark, sf)
    flavors = list(feeds.COT_COLUMNS)
    flavor = F.element_at(F.array(*[F.lit(f) for f in flavors]), (F.substring("code", 2, 1).cast("int") % 3 + 1).cast("int"))
    pair = lambda k, v: F.concat(F.lit('"'), k, F.lit('":"'), v.cast("string"), F.lit('"'))
    pos = [pair(feeds._flavor_column(F.col("flavor"), i), F.col(n)) for i, n in enumerate(["spec_long", "spec_short", "comm_long", "comm_short"])]
    body = F.concat_ws(
        ",", pair(F.lit(feeds.COT_DATE), F.concat(F.col("report_date").cast("string"), F.lit("T00:00:00.000"))), pair(F.lit(feeds.COT_CODE), F.col("code")),
        pair(F.lit(feeds.COT_OI), F.col("open_interest")), *pos[:3], F.when(F.weekofyear("report_date") != 20, pos[3]),
        F.when(F.col("open_interest") % 2 == 0, pair(F.lit(feeds.COT_TRADERS), F.col("open_interest") * 3)))
    return c.withColumn("flavor", flavor).select("flavor", F.concat(F.lit("{"), body, F.lit("}")).alias("payload"))


def s11(spark, sf):
    good, _ = feeds.cot_reports(_cot_docs(spark, sf))
    return present(good)


_COT_BASE = """WITH f(flavor, k, sl, ss, cl, cs) AS (VALUES """ + ", ".join(
    f"('{f}', {i}, '{c[0]}', '{c[1]}', '{c[2]}', '{c[3]}')" for i, (f, c) in enumerate(feeds.COT_COLUMNS.items())
) + """), d AS (SELECT v_cot.*, f.*, weekofyear(report_date) = 20 AS broken, CASE WHEN open_interest % 2 = 0 THEN open_interest * 3 END AS traders FROM v_cot JOIN f ON k = code[2]::INT % 3)"""
S11_SQL = sql(
    _COT_BASE + f""", j AS (SELECT *, list_sort([['{feeds.COT_CODE}', code], ['{feeds.COT_OI}', open_interest::VARCHAR], ['{feeds.COT_DATE}', report_date::VARCHAR || 'T00:00:00.000'],
        [sl, spec_long::VARCHAR], [ss, spec_short::VARCHAR], [cl, comm_long::VARCHAR], [cs, comm_short::VARCHAR]] || CASE WHEN traders IS NULL THEN [] ELSE [['{feeds.COT_TRADERS}', traders::VARCHAR]] END) AS kv FROM d WHERE NOT broken)
    SELECT code, flavor, report_date::VARCHAR AS report_date, strftime((CAST(report_date + 3 AS TIMESTAMP) + INTERVAL 930 MINUTE) AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS known_at,
      open_interest, spec_long, spec_short, comm_long, comm_short, traders, sha256('{{' || array_to_string(list_transform(kv, lambda e: '"' || e[1] || '":"' || e[2] || '"'), ',') || '}}') AS sha FROM j"""
)


def p19(spark, sf):
    _, bad = feeds.cot_reports(_cot_docs(spark, sf))
    return present(bad.groupBy("flavor", "missing").agg(F.count(F.lit(1)).alias("n")))


def _macro_docs(spark, sf):
    """Per series and month: the observations known then, newest first, the newest often missing."""
    m = v_macro(spark, sf).groupBy("series", "ref_date").agg(F.max("value").alias("value"), F.min("known_at").alias("known_at"))
    names = F.array(F.lit("NFP"), F.lit("CPI"), F.lit("JOLTS"), F.lit("PCE"), F.lit("FOMC_MINUTES"))
    return m.withColumn("series", F.element_at(names, F.col("series").cast("int")))


def s12(spark, sf):
    m = _macro_docs(spark, sf)
    v = F.when(F.month("ref_date") % 2 == 0, F.lit(".")).otherwise(F.col("value").cast("decimal(20,2)").cast("string"))
    obs = lambda d, val: F.concat(F.lit('{"realtime_start":"'), F.date_add("known_at", 1).cast("string"), F.lit('","date":"'), d.cast("string"), F.lit('","value":"'), val, F.lit('"}'))
    doc = F.concat(F.lit('{"observations":['), obs(F.col("ref_date"), v), F.lit(","), obs(F.add_months("ref_date", -1), F.lit("10.5")), F.lit("]}"))
    as_of = F.timestamp_add("HOUR", F.lit(38), F.col("known_at").cast("timestamp"))
    d = m.select("series", F.concat_ws("_", "series", F.col("ref_date").cast("string")).alias("event_id"), as_of.alias("as_of"), doc.alias("payload"))
    return present(feeds.vintage_values(d).select("series", "event_id", "ref_date", "known_at", "value"))


_MACRO_BASE = """WITH m0 AS (SELECT series, ref_date, max(value) AS value, min(known_at) AS known_at FROM v_macro GROUP BY 1, 2),
    m AS (SELECT ['NFP','CPI','JOLTS','PCE','FOMC_MINUTES'][series::INT] AS s, ['08:30:00','08:30:00','10:00:00','08:30:00','14:00:00'][series::INT] AS rt, ref_date, value, known_at FROM m0)"""
S12_SQL = sql(
    _MACRO_BASE + """, k AS (SELECT *, CAST(((known_at + 1)::VARCHAR || ' ' || rt) AS TIMESTAMP) AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC' AS kn FROM m)
    SELECT s AS series, s || '_' || ref_date::VARCHAR AS event_id, (CASE WHEN month(ref_date) % 2 = 0 THEN CAST(ref_date - INTERVAL 1 MONTH AS DATE) ELSE ref_date END)::VARCHAR AS ref_date,
      strftime(kn, '%Y-%m-%d %H:%M:%S') AS known_at, CASE WHEN month(ref_date) % 2 = 0 THEN 10.5e0 ELSE round(value, 2) END AS value FROM k WHERE kn <= CAST(known_at AS TIMESTAMP) + INTERVAL 38 HOUR"""
)


def s13(spark, sf):
    m = _macro_docs(spark, sf)
    point = lambda p, v: F.concat(F.lit('{"year":"'), F.year("ref_date").cast("string"), F.lit('","period":"'), p, F.lit('","value":"'), v, F.lit('"}'))
    period = F.concat(F.lit("M"), F.lpad(F.month("ref_date").cast("string"), 2, "0"))
    doc = F.concat(F.lit('{"status":"REQUEST_SUCCEEDED","data":['), point(F.lit("M13"), F.lit("1")), F.lit(","), point(F.lit("M12"), F.lit(" - ")), F.lit(","),
                   point(period, F.col("value").cast("decimal(20,2)").cast("string")), F.lit("]}"))
    d = m.select("series", F.concat_ws("_", "series", F.col("ref_date").cast("string")).alias("event_id"), F.date_add("ref_date", 400).cast("timestamp").alias("as_of"), doc.alias("payload"))
    rel = m.filter("month(ref_date) % 3 = 0").select("series", "ref_date", F.col("known_at").cast("timestamp").alias("release_at"))
    return present(feeds.monthly_values(d, rel).select("series", "event_id", "ref_date", "known_at", "value"))


S13_SQL = sql(
    _MACRO_BASE + """ SELECT s AS series, s || '_' || ref_date::VARCHAR AS event_id, ref_date::VARCHAR AS ref_date, strftime(CASE WHEN month(ref_date) % 3 = 0 THEN CAST(known_at AS TIMESTAMP)
      ELSE CAST((last_day(CAST(ref_date + INTERVAL 1 MONTH AS DATE))::VARCHAR || ' ' || rt) AS TIMESTAMP) AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC' END, '%Y-%m-%d %H:%M:%S') AS known_at, round(value, 2) AS value FROM m"""
)


def s14(spark, sf):
    e = _events(spark, sf)
    one = F.concat(F.lit('{"date":"'), F.col("release_date").cast("string"), F.lit('"}'))
    p = e.withColumn("one", one).groupBy("series", F.year("release_date").alias("y")).agg(F.concat(F.lit('{"release_dates":['), F.array_join(F.array_sort(F.collect_list("one")), ","), F.lit("]}")).alias("payload"))
    ts = lambda s: F.lit(s).cast("timestamp")
    return present(feeds.release_events(p, ts("1996-03-10 13:30:00"), ts("2000-07-10 18:00:00")).select("event_id", "series", "publisher", "release_date", "release_at", "sha"))


S14_SQL = sql(
    "WITH p AS (SELECT series, year(release_date) AS y, '{\"release_dates\":[' || string_agg('{\"date\":\"' || release_date::VARCHAR || '\"}', ',' ORDER BY release_date) || ']}' AS payload FROM v_events GROUP BY 1, 2), "
    + "s(series, publisher, rt) AS (VALUES " + ", ".join(f"('{s[0]}', '{s[1]}', '{s[2]}')" for s in dims.SERIES) + "), "
    + """k AS (SELECT e.*, publisher, CAST((release_date::VARCHAR || ' ' || rt) AS TIMESTAMP) AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC' AS a FROM v_events e JOIN s ON s.series = e.series)
    SELECT event_id, k.series, publisher, release_date::VARCHAR AS release_date, strftime(a, '%Y-%m-%d %H:%M:%S') AS release_at, sha256(sha256(payload) || '||' || event_id) AS sha
    FROM k JOIN p ON p.series = k.series AND p.y = year(release_date) WHERE a >= TIMESTAMP '1996-03-10 13:30:00' AND a < TIMESTAMP '2000-07-10 18:00:00'""",
    EVENTS_SQL,
)


def s16(spark, sf):
    """Meeting dates kept as JSON lists, one file per year, joined back to the orders of the day."""
    key = (spark.sparkContext.applicationId, sf, "dates")
    if key not in _ARCHIVES:
        path = work_dir(spark, "dates")
        d = load(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).filter("weekday(d) = 2 AND day(d) BETWEEN 15 AND 21").distinct()
        d.groupBy(F.year("d").alias("y")).agg(F.to_json(F.array_sort(F.collect_list(F.col("d").cast("string")))).alias("value")).write.partitionBy("y").text(path)
        _ARCHIVES[key] = (path, [])
    days = feeds.static_dates(spark, _ARCHIVES[key][0], "FOMC_STATEMENT")
    o = load(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("release_date")).agg(F.count(F.lit(1)).alias("orders"))
    return present(days.join(o, "release_date"))


S16_SQL = "SELECT CAST(o_orderdate AS DATE)::VARCHAR AS release_date, 'FOMC_STATEMENT' AS series, count(*) AS orders FROM orders WHERE isodow(o_orderdate) = 3 AND day(o_orderdate) BETWEEN 15 AND 21 GROUP BY 1"

MARKER, CODES = "MIT|Apache|License|Copyright", "MIT|GNU|Apache|Version|License|Licensed|Public"


def s17(spark, sf):
    return present(feeds.marker_lines(load(spark, sf, "documents"), MARKER, CODES))


_S17 = f"""WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\\r\\n|\\n|\\r')) AS line, generate_subscripts(string_split_regex(text, '\\r\\n|\\n|\\r'), 1) AS k FROM documents),
    m AS (SELECT *, regexp_extract_all(line, '\\b({CODES})\\b', 1) AS raw FROM l WHERE regexp_matches(line, '\\b({MARKER})\\b')),
    c AS (SELECT *, list_filter(raw, lambda x, i: list_position(raw, x) = i) AS codes FROM m)"""


def s17_report(spark, sf):
    return present(feeds.marker_report(feeds.marker_lines(load(spark, sf, "documents"), MARKER, CODES)))


S17R_SQL = _S17 + """, u AS (SELECT unnest(codes) AS x FROM c) SELECT 'document' AS kind, doc_id::VARCHAR AS name, count(*) AS n FROM c GROUP BY 1, 2
    UNION ALL SELECT 'family', string_split(x, '-')[1], count(*) FROM u GROUP BY 1, 2 UNION ALL SELECT 'without code', '', count(*) FILTER (len(codes) = 0) FROM c"""


def p1(spark, sf):
    """Quotes with planted faults, split into valid and quarantined."""
    q = v_quotes(spark, sf).withColumn("oi", F.col("volume") - 1)
    h = F.hour("ts")
    q = q.withColumns({
        "high": F.when(h == 3, F.col("low") - 1).otherwise(F.col("high")).cast("decimal(20,8)"), "volume": F.when(h == 5, -F.col("volume")).otherwise(F.col("volume")),
        "sha": F.when(h == 7, F.lit("short")).otherwise(F.col("sha")), "contract": F.when(h == 9, F.lit("??")).otherwise(F.col("contract")), "oi": F.when(h % 4 == 1, -F.col("oi") - 1).otherwise(F.col("oi")),
    })
    good, bad = validate.split(q, "bar")
    return present(good.withColumn("broken", F.array().cast("array<string>")).unionByName(bad).groupBy("broken").agg(F.count(F.lit(1)).alias("n")))


P1_SQL = sql(
    """WITH q AS (SELECT hour(ts) AS h FROM v_quotes), b AS (SELECT concat_ws(',', CASE WHEN h = 3 THEN 'high below low' END, CASE WHEN h = 5 THEN 'negative volume' END, CASE WHEN h % 4 = 1 THEN 'negative oi' END,
      CASE WHEN h = 7 THEN 'bad sha' END, CASE WHEN h = 9 THEN 'bad contract' END) AS broken FROM q) SELECT broken, count(*) AS n FROM b GROUP BY 1"""
)


def p1_orders(spark, sf):
    from .views import v_orders

    o = v_orders(spark, sf).withColumn("quantity", F.when(F.col("order_id") % 7 == 0, F.lit(0)).otherwise(F.col("quantity")))
    o = o.withColumn("order_type", F.when(F.col("order_id") % 11 == 0, F.lit("STP_LMT")).otherwise(F.col("order_type")))
    return present(validate.check(o, "order").groupBy("order_type", "broken").agg(F.count(F.lit(1)).alias("n")))


P1O_SQL = sql(
    """WITH o AS (SELECT CASE WHEN order_id % 11 = 0 THEN 'STP_LMT' ELSE order_type END AS t, CASE WHEN order_id % 7 = 0 THEN 0 ELSE quantity END AS q, limit_price, stop_price FROM v_orders)
    SELECT t AS order_type, concat_ws(',', CASE WHEN q <= 0 THEN 'quantity not positive' END, CASE WHEN t IN ('LMT', 'STP_LMT') AND limit_price IS NULL THEN 'limit price missing' END,
      CASE WHEN t IN ('STP', 'STP_LMT') AND stop_price IS NULL THEN 'stop price missing' END) AS broken, count(*) AS n FROM o GROUP BY 1, 2"""
)


def p18(spark, sf):
    li = load(spark, sf, "lineitem")
    k = F.col("l_partkey") % 6
    raw = (
        F.when(k == 0, F.concat(F.lit("+"), F.format_number("l_extendedprice", 2))).when(k == 1, F.lit(" --- ")).when(k == 2, F.lit("n/a"))
        .when(k == 3, F.concat(F.lit("-"), F.format_number("l_extendedprice", 2))).when(k == 4, F.lit("12x")).otherwise(F.format_number("l_extendedprice", 2)))
    d = li.select(k.alias("k"), raw.alias("raw")).select("k", clean_number(F.col("raw")).alias("v"), is_bad_number(F.col("raw")).alias("bad"))
    return present(d.groupBy("k").agg(F.count("v").alias("n"), F.sum("v").alias("total"), F.count_if("bad").alias("bad")))


P18_SQL = """WITH d AS (SELECT l_partkey % 6 AS k, CAST(l_extendedprice AS DECIMAL(20,2)) AS p FROM lineitem)
    SELECT k, count(*) FILTER (k IN (0, 3, 5)) AS n, sum(CASE WHEN k IN (0, 5) THEN p WHEN k = 3 THEN -p END)::DOUBLE AS total, count(*) FILTER (k = 4) AS bad FROM d GROUP BY k"""


def t1(spark, sf):
    """Canonical settle order, shown as each row's place within its contract."""
    from ..operators.consensus import state_rank
    from ..operators.ordered import segmented
    from ..operators.rolls import month_of

    s = v_settles(spark, sf).withColumn("rank", state_rank(F.col("settle_state")))
    s = segmented(s, ["contract"], ["as_of_date", "rank", "sha"], month_of(F.col("as_of_date")), {"place": ("row_number", None)})
    return present(s.select("contract", "as_of_date", "settle_state", "sha", "place"))


T1_SQL = sql(
    """SELECT contract, as_of_date::VARCHAR AS as_of_date, settle_state, sha,
      row_number() OVER (PARTITION BY contract ORDER BY v_settles.as_of_date, CASE settle_state WHEN 'live' THEN 0 WHEN 'preliminary' THEN 1 ELSE 2 END, sha) AS place FROM v_settles"""
)


def u2(spark, sf):
    """Latest quote per contract, hour and value, after uniting a narrower and a wider batch."""
    q = v_quotes(spark, sf)
    both = q.filter("tier < 4").drop("volume").unionByName(q.filter("tier >= 3"), allowMissingColumns=True)
    return present(archive.keep_last(both, ["contract", "ts", "close"], ["as_of", "volume"]).select("contract", "ts", "close", "source_id", "volume"))


U2_SQL = sql(
    """WITH b AS (SELECT contract, ts, close, source_id, as_of, NULL::BIGINT AS volume FROM v_quotes WHERE tier < 4 UNION ALL SELECT contract, ts, close, source_id, as_of, volume FROM v_quotes WHERE tier >= 3),
    k AS (SELECT *, row_number() OVER (PARTITION BY contract, ts, close ORDER BY as_of DESC, volume DESC NULLS LAST) AS k FROM b)
    SELECT contract, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, close::DOUBLE AS close, source_id, volume FROM k WHERE k = 1"""
)


def j10(spark, sf):
    """Quotes a later batch would add to what an earlier one stored."""
    q = archive.with_bar_parts(v_quotes(spark, sf))
    old = q.filter((F.hour("ts") % 3 != 0) & (F.col("tier") < 4))
    return present(archive.new_rows(q, old, archive.BAR_KEY, archive.BAR_PARTS).groupBy("contract", "source_id").agg(F.count(F.lit(1)).alias("n")))


QUERIES = {
    "S1_bar_archive": s1, "S1_write_counts": s1_counts, "S2_bar_window": s2, "S3_settle_archive": s3, "S4_settle_range": s4, "S5_archive_sql": s5, "S5_archive_table_query": s5_where,
    "S6_settlement_pages": s6, "S6_page_problems": s6_problems, "S7_venue_bars": s7, "S8_vendor_daily_bars": s8, "S9_broker_bars": s9, "S10_settles_from_bars": s10, "S11_cot_reports": s11,
    "S12_vintage_values": s12, "S13_monthly_values": s13, "S14_release_events": s14, "S15_session_ledger": s15, "D1_landed_feed": landed_feed, "S16_static_dates": s16, "S17_marker_lines": s17, "S17_marker_report": s17_report,
    "P1_bar_rules": p1, "P1_order_rules": p1_orders, "P18_number_cleaning": p18, "P19_schema_drift": p19, "T1_canonical_order": t1, "U1_U2_T3_keep_last": u2, "J10_new_rows": j10,
}

ORACLES = {
    "S1_bar_archive": sql("SELECT left(contract, 2) AS root, resolution, year(ts) AS year, month(ts) AS month, count(*) AS n, count(DISTINCT sha) AS hashes, round(sum(close)::DOUBLE, 6) AS closes FROM v_quotes GROUP BY 1, 2, 3, 4"),
    "S1_write_counts": sql("""WITH c AS (SELECT count(*) FILTER (day(ts) <= 15) AS h, count(*) FILTER (day(ts) <= 15 AND volume > 1) AS d, count(*) AS n FROM v_quotes)
        SELECT 0::BIGINT AS batch, h AS written, d AS skipped, h + d AS submitted FROM c UNION ALL SELECT 1, n - h, h, n FROM c UNION ALL SELECT 2, 0, n, n FROM c"""),
    "S2_bar_window": sql("""SELECT inclusive, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, source_id, close::DOUBLE AS close, sha FROM v_quotes, (VALUES (true), (false)) w(inclusive)
        WHERE contract = 'CLH24' AND ts >= TIMESTAMP '2024-01-10' AND (v_quotes.ts < TIMESTAMP '2024-01-20' OR inclusive AND v_quotes.ts = TIMESTAMP '2024-01-20')"""),
    "S3_settle_archive": sql("SELECT root, year(as_of_date) AS year, settle_state, count(*) AS n, round(sum(settle)::DOUBLE, 6) AS total FROM v_settles GROUP BY 1, 2, 3"),
    "S4_settle_range": sql("SELECT as_of_date::VARCHAR AS as_of_date, settle_state, settle::DOUBLE AS settle, sha FROM v_settles WHERE contract = 'ESH99' AND v_settles.as_of_date BETWEEN DATE '1998-12-01' AND DATE '1999-02-15'"),
    "S5_archive_sql": sql("""SELECT contract, month(ts) AS month, count(*) AS n, round(sum(close)::DOUBLE, 6) AS total, grouping_id(contract, month(ts)) AS g FROM v_quotes WHERE close >= 105 GROUP BY CUBE (contract, month(ts))"""),
    "S5_archive_table_query": sql("SELECT contract, max(settle)::DOUBLE AS top FROM v_settles WHERE root = 'GC' GROUP BY contract"),
    "S6_settlement_pages": S6_SQL, "S6_page_problems": S6P_SQL, "S7_venue_bars": S7_SQL, "S8_vendor_daily_bars": S8_SQL, "S9_broker_bars": S9_SQL, "S10_settles_from_bars": S10_SQL, "S11_cot_reports": S11_SQL,
    "S12_vintage_values": S12_SQL, "S13_monthly_values": S13_SQL, "S14_release_events": S14_SQL, "S15_session_ledger": S15_SQL, "D1_landed_feed": LANDED_FEED_SQL, "S16_static_dates": S16_SQL,
    "S17_marker_lines": _S17 + " SELECT doc_id, k AS line_no, trim(line) AS line, array_to_string(codes, ',') AS codes FROM c", "S17_marker_report": S17R_SQL,
    "P1_bar_rules": P1_SQL, "P1_order_rules": P1O_SQL, "P18_number_cleaning": P18_SQL,
    "P19_schema_drift": sql(_COT_BASE + " SELECT flavor, cs AS missing, count(*) AS n FROM d WHERE broken GROUP BY 1, 2"),
    "T1_canonical_order": T1_SQL, "U1_U2_T3_keep_last": U2_SQL,
    "J10_new_rows": sql("SELECT contract, source_id, count(*) AS n FROM v_quotes WHERE NOT (hour(ts) % 3 <> 0 AND tier < 4) GROUP BY 1, 2"),
}
