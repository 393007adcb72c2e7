"""Registered queries: per-strategy statistics and calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendar as cal_ops
from ..operators import events, performance as perf
from ..operators import positions as pos
from ..operators.ordered import segmented
from . import sqlmath
from .quote_queries import EVENTS_SQL, _events
from .trade_queries import _W7, v_f
from .trade_queries import VIEWS as TRADE_VIEWS
from .views import load, present, sql, v_equity, v_panel, v_ret, view

PPY_M = 12.0


def _alive(spark, sf):
    return v_equity(spark, sf).filter("strategy_id < 20")


def a7(spark, sf):
    return present(perf.performance(_alive(spark, sf), 252.0, 0.01))


A7_SQL = sql(
    """WITH e AS (SELECT *, lag(equity) OVER w AS prev, max(equity) OVER w AS peak FROM v_equity WHERE strategy_id < 20 WINDOW w AS (PARTITION BY strategy_id ORDER BY d)),
    g AS (SELECT strategy_id, count(prev) AS n, arg_min(equity, d) AS f, arg_max(equity, d) AS l, max((peak - equity) / peak) AS dd,
      avg(equity / prev - 1) AS m, stddev_samp(equity / prev - 1) AS s FROM e GROUP BY 1)
    SELECT strategy_id, n AS n_periods, round(l / f - 1, 6) AS total_return, round(pow(l / f, 252e0 / n) - 1, 6) AS annual_return, round(s * sqrt(252e0), 6) AS volatility,
      round((m - 0.01e0 / 252e0) / s * sqrt(252e0), 6) AS sharpe, round(dd, 6) AS max_drawdown, round((pow(l / f, 252e0 / n) - 1) / dd, 6) AS calmar FROM g"""
)


def w4(spark, sf):
    return present(perf.equity_returns(v_equity(spark, sf)).select("strategy_id", "d", "r"))


W4_SQL = sql(
    """WITH e AS (SELECT *, lag(equity) OVER w AS prev, min(equity) OVER w AS low, min(equity) OVER (PARTITION BY strategy_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low_before
      FROM v_equity WINDOW w AS (PARTITION BY strategy_id ORDER BY d))
    SELECT strategy_id, d::VARCHAR AS d, CASE WHEN low_before <= 0 THEN 0e0 WHEN low <= 0 THEN -1e0 ELSE round(equity / prev - 1, 6) END AS r FROM e WHERE prev IS NOT NULL"""
)


def w5(spark, sf):
    return present(perf.drawdowns(v_equity(spark, sf)).select("strategy_id", "d", "drawdown"))


def w9(spark, sf):
    return present(perf.trailing_sharpe(v_ret(spark, sf), "strategy_id", "d", 63, 252.0).select("strategy_id", "d", "n", "trailing_sharpe"))


W9_SQL = sql(
    """WITH t AS (SELECT strategy_id, d, row_number() OVER (PARTITION BY strategy_id ORDER BY d) AS n, avg(r) OVER w AS m, stddev_samp(r) OVER w AS s FROM v_ret
      WINDOW w AS (PARTITION BY strategy_id ORDER BY d ROWS BETWEEN 62 PRECEDING AND CURRENT ROW))
    SELECT strategy_id, d::VARCHAR AS d, n, CASE WHEN n >= 2 AND s > 1e-12 THEN round(m / s * sqrt(252e0), 6) END AS trailing_sharpe FROM t"""
)


def a8(spark, sf):
    return present(perf.trade_metrics(pos.trade_ledger(v_f(spark, sf)), ["account"]))


A8_SQL = sql(
    _W7 + """, t AS (SELECT account, sum(-q * price * multiplier)::DOUBLE AS pnl FROM p WHERE q <> 0 GROUP BY account, root, bet HAVING max(ends) = 1),
    m AS (SELECT account, avg(pnl) AS mu FROM t GROUP BY 1)
    SELECT t.account, count(*) AS n_trades, count(*) FILTER (pnl > 0) AS n_wins, count(*) FILTER (pnl < 0) AS n_losses, count(*) FILTER (pnl = 0) AS n_scratch,
      round(count(*) FILTER (pnl > 0) / count(*), 6) AS win_rate, round(avg(pnl) FILTER (pnl > 0), 6) AS avg_win, round(-avg(pnl) FILTER (pnl < 0), 6) AS avg_loss,
      round(avg(pnl) FILTER (pnl > 0) / -avg(pnl) FILTER (pnl < 0), 6) AS payoff, round(avg(pnl), 6) AS expectancy,
      round(coalesce(sum(pnl) FILTER (pnl > 0), 0) / -sum(pnl) FILTER (pnl < 0), 6) AS profit_factor, CASE WHEN count(*) >= 3 AND var_pop(pnl) > 0 THEN round(avg(pow(pnl - mu, 3)) / pow(avg(pow(pnl - mu, 2)), 1.5e0), 6) END AS pnl_skew
    FROM t JOIN m ON m.account = t.account GROUP BY t.account""",
    TRADE_VIEWS,
)

STAT_VIEWS = {
    "v_mom": """SELECT strategy_id, count(*) AS n, any_value(mu) / stddev_samp(r) AS sr, avg(pow(r - mu, 3)) / pow(avg(pow(r - mu, 2)), 1.5e0) AS skew,
        avg(pow(r - mu, 4)) / pow(avg(pow(r - mu, 2)), 2e0) AS kurt FROM (SELECT *, avg(r) OVER (PARTITION BY strategy_id) AS mu FROM v_panel) GROUP BY 1""",
}


def ssql(body):
    return sql(body, STAT_VIEWS)


def a9(spark, sf):
    return present(perf.sharpe_moments(v_panel(spark, sf), ["strategy_id"]))


def a10(spark, sf):
    m = perf.probabilistic_sharpe(perf.sharpe_moments(v_panel(spark, sf), ["strategy_id"]), PPY_M, 0.1)
    return present(m.select("strategy_id", "n", "sr_annual", "psr", "passes"))


A10_SQL = ssql(
    f"""WITH z AS (SELECT *, (sr - 0.1e0 / sqrt(12e0)) * sqrt(n - 1) / sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr) AS z FROM v_mom)
    SELECT strategy_id, n, round(sr * sqrt(12e0), 6) AS sr_annual, round({sqlmath.cdf('z')}, 6) AS psr, {sqlmath.cdf('z')} > 0.95 AS passes FROM z"""
)


def a11(spark, sf):
    return present(perf.min_track_record(perf.sharpe_moments(v_panel(spark, sf), ["strategy_id"]), 0.0).select("strategy_id", F.round("min_length", 3).alias("min_length")))


A11_SQL = ssql(
    f"""SELECT strategy_id, CASE WHEN sr > 0 AND 1 - skew * sr + (kurt - 1) / 4 * sr * sr > 0 THEN
      round(1 + (1 - skew * sr + (kurt - 1) / 4 * sr * sr) * pow({sqlmath.ppf('0.95e0')} / sr, 2), 3) END AS min_length FROM v_mom"""
)


def a12(spark, sf):
    m = perf.sharpe_moments(v_panel(spark, sf), ["strategy_id"]).withColumn("family", F.col("strategy_id") % 2)
    t = m.select("family", (F.col("sr") * PPY_M**0.5).alias("sr_trial"))
    d = perf.deflated_sharpe(m, t, ["family"], PPY_M)
    return present(d.select("strategy_id", "family", "n_trials", "trial_var", "sr_star", "dsr", "passes"))


A12_SQL = ssql(
    f"""WITH f AS (SELECT strategy_id % 2 AS family, count(*) AS nt, var_samp(sr * sqrt(12e0)) AS v, 1e0 - 1e0 / count(*) AS p1, 1e0 - 1e0 / (count(*) * exp(1e0)) AS p2 FROM v_mom GROUP BY 1),
    s AS (SELECT *, sqrt(v) * ((1 - 0.5772156649015329e0) * {sqlmath.ppf('p1')} + 0.5772156649015329e0 * {sqlmath.ppf('p2')}) AS star FROM f),
    z AS (SELECT m.strategy_id, s.family, nt, v, star, (sr - star / sqrt(12e0)) * sqrt(n - 1) / sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr) AS z FROM v_mom m JOIN s ON s.family = m.strategy_id % 2)
    SELECT strategy_id, family, nt AS n_trials, round(v, 6) AS trial_var, round(star, 6) AS sr_star, round({sqlmath.cdf('z')}, 6) AS dsr, {sqlmath.cdf('z')} > 0.95 AS passes FROM z"""
)


def a13(spark, sf):
    return present(perf.lo_factor(v_panel(spark, sf), 12))


A13_SQL = ssql(
    """WITH c AS (SELECT strategy_id, i, r - avg(r) OVER (PARTITION BY strategy_id) AS x, count(*) OVER (PARTITION BY strategy_id) AS n FROM v_panel),
    l AS (SELECT *, unnest(range(0, least(11, n - 1, greatest(1, CAST(floor(4 * pow(n / 100e0, 2e0 / 9e0)) AS BIGINT))) + 1)) AS lag FROM c),
    v AS (SELECT l.strategy_id, l.lag, sum(l.x * c.x) / max(l.n) AS cov FROM l JOIN c ON c.strategy_id = l.strategy_id AND c.i = l.i + l.lag GROUP BY 1, 2)
    SELECT strategy_id, round(12e0 / sqrt(12e0 + 2 * sum((12 - lag) * cov) FILTER (lag > 0) / max(cov) FILTER (lag = 0)), 6) AS eta FROM v GROUP BY 1"""
)


def a14(spark, sf):
    return present(perf.winsorised_sharpe(v_ret(spark, sf), ["strategy_id"], 0.02, 252.0))


A14_SQL = sql(
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY r) - 1 AS k, count(*) OVER (PARTITION BY strategy_id) AS n FROM v_ret),
    c AS (SELECT strategy_id, max(r) FILTER (k = floor(0.02e0 * n)) AS lo, max(r) FILTER (k = n - 1 - floor(0.02e0 * n)) AS hi FROM o GROUP BY 1),
    w AS (SELECT o.strategy_id, r, least(greatest(r, lo), hi) AS x FROM o JOIN c ON c.strategy_id = o.strategy_id)
    SELECT strategy_id, round(avg(r) / stddev_samp(r) * sqrt(252e0), 6) AS sharpe, round(avg(x) / stddev_samp(x) * sqrt(252e0), 6) AS sharpe_winsorised FROM w GROUP BY 1"""
)


def a15(spark, sf):
    return present(perf.tail_contribution(v_ret(spark, sf), ["strategy_id"], 0.05))


A15_SQL = sql(
    """WITH o AS (SELECT strategy_id, abs(r) AS a, row_number() OVER (PARTITION BY strategy_id ORDER BY abs(r) DESC) AS k, count(*) OVER (PARTITION BY strategy_id) AS n FROM v_ret)
    SELECT strategy_id, round(sum(a) FILTER (k <= greatest(1, floor(0.05e0 * n))) / sum(a), 6) AS tail_share FROM o GROUP BY 1"""
)


def a16(spark, sf):
    return present(perf.skew_without_extremes(v_panel(spark, sf), "strategy_id", "i", 3))


A16_SQL = ssql(
    """WITH c AS (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY abs(r - mu) DESC, i) AS k FROM (SELECT *, avg(r) OVER (PARTITION BY strategy_id) AS mu FROM v_panel)),
    t AS (SELECT strategy_id, r, avg(r) OVER (PARTITION BY strategy_id) AS mu FROM c WHERE k > 3),
    s AS (SELECT strategy_id, avg(pow(r - mu, 3)) / pow(avg(pow(r - mu, 2)), 1.5e0) AS sk FROM t GROUP BY 1)
    SELECT m.strategy_id, round(m.skew, 6) AS skew, round(s.sk, 6) AS skew_trimmed FROM v_mom m JOIN s ON s.strategy_id = m.strategy_id"""
)


def a17(spark, sf):
    return present(perf.quantile_skew(v_ret(spark, sf), ["strategy_id"]))


A17_SQL = sql(
    """WITH q AS (SELECT strategy_id, quantile_cont(r, 0.05) AS lo, quantile_cont(r, 0.5) AS mid, quantile_cont(r, 0.95) AS hi FROM v_ret GROUP BY 1)
    SELECT strategy_id, round(lo, 6) AS lo, round(mid, 6) AS mid, round(hi, 6) AS hi, round((hi + lo - 2 * mid) / (hi - lo), 6) AS quantile_skew FROM q"""
)


def a18(spark, sf):
    return present(perf.tail_means(v_ret(spark, sf), ["strategy_id"]))


A18_SQL = sql(
    """WITH o AS (SELECT strategy_id, r, row_number() OVER (PARTITION BY strategy_id ORDER BY r) AS a, row_number() OVER (PARTITION BY strategy_id ORDER BY r DESC) AS z,
      ceil(round(0.05e0 * count(*) OVER (PARTITION BY strategy_id), 9)) AS k FROM v_ret)
    SELECT strategy_id, round(avg(r) FILTER (a <= k), 6) AS left_mean, round(avg(r) FILTER (z <= k), 6) AS right_mean, max(k)::BIGINT AS n_tail,
      round(avg(r) FILTER (z <= k) / abs(avg(r) FILTER (a <= k)), 6) AS ratio FROM o GROUP BY 1"""
)


def a19(spark, sf):
    return present(perf.profit_factors(v_ret(spark, sf), ["strategy_id"]))


def a21(spark, sf):
    s = v_ret(spark, sf).select("strategy_id", "d", (F.col("r") * 1000).cast("decimal(18,6)").alias("pnl"))
    return present(perf.decay_verdicts(s))


A21_SQL = sql(
    """WITH s AS (SELECT strategy_id, d, CAST(r * 1000 AS DECIMAL(18,6)) AS pnl FROM v_ret),
    c AS (SELECT *, sum(pnl) OVER (PARTITION BY strategy_id ORDER BY d) AS cum, row_number() OVER (PARTITION BY strategy_id ORDER BY d DESC) AS k FROM s),
    p AS (SELECT *, greatest(0, max(cum) OVER (PARTITION BY strategy_id ORDER BY d)) - cum AS dd FROM c),
    g AS (SELECT strategy_id, count(*) AS n, sum(pnl)::DOUBLE AS cm, avg(pnl::DOUBLE) / stddev_samp(pnl::DOUBLE) * sqrt(252e0) AS fs,
      avg(pnl::DOUBLE) FILTER (k <= 63) / stddev_samp(pnl::DOUBLE) FILTER (k <= 63) * sqrt(252e0) AS rs, max(dd)::DOUBLE AS dd FROM p GROUP BY 1)
    SELECT strategy_id, n AS n_sessions, round(cm, 6) AS cumulative, round(fs, 6) AS full_sharpe, round(rs, 6) AS rolling_sharpe, round(dd, 6) AS max_drawdown,
      CASE WHEN n < 21 THEN 'warming_up' WHEN cm <= 0 OR rs <= 0 THEN 'decayed' ELSE 'healthy' END AS verdict FROM g"""
)


def a22(spark, sf):
    return present(perf.lag_one(v_panel(spark, sf)))


A22_SQL = ssql(
    """WITH c AS (SELECT strategy_id, i, r - avg(r) OVER (PARTITION BY strategy_id) AS x FROM v_panel),
    l AS (SELECT *, lag(x) OVER (PARTITION BY strategy_id ORDER BY i) AS p FROM c)
    SELECT strategy_id, count(*) AS n, round(sum(x * p) / sum(x * x), 6) AS lag1, abs(sum(x * p) / sum(x * x)) > 2 / sqrt(count(*)) AS warning FROM l GROUP BY 1"""
)


def a23(spark, sf):
    """Family of monthly curves of equal length, one of them ruined after forty months."""
    run = segmented(v_panel(spark, sf), ["strategy_id"], ["i"], F.floor(F.col("i") / 12), {"c": ("sum", F.col("r").cast("decimal(18,10)"))})
    fall = F.when((F.col("strategy_id") == 3) & (F.col("i") >= 40), 300000.0).otherwise(0.0)
    e = run.select("strategy_id", F.add_months(F.lit("2000-01-01").cast("date"), F.col("i").cast("int")).alias("d"), (100000.0 + 10000.0 * F.col("c").cast("double") - fall).alias("equity"))
    return present(perf.family_from_curves(e, PPY_M)[1])


A23_SQL = sql(
    """WITH m AS (SELECT strategy_id, i AS mo, 100000e0 + 10000e0 * CAST(sum(CAST(r AS DECIMAL(18,10))) OVER (PARTITION BY strategy_id ORDER BY i) AS DOUBLE)
        - CASE WHEN strategy_id = 3 AND i >= 40 THEN 300000e0 ELSE 0e0 END AS equity FROM v_panel),
    e AS (SELECT *, lag(equity) OVER w AS prev, min(equity) OVER w AS low, min(equity) OVER (PARTITION BY strategy_id ORDER BY mo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lb FROM m
      WINDOW w AS (PARTITION BY strategy_id ORDER BY mo)),
    r AS (SELECT strategy_id, CASE WHEN lb <= 0 THEN 0e0 WHEN low <= 0 THEN -1e0 ELSE equity / prev - 1 END AS r FROM e WHERE prev IS NOT NULL)
    SELECT strategy_id, count(*) AS n, round(avg(r) / stddev_samp(r) * sqrt(12e0), 6) AS sr_trial FROM r GROUP BY 1"""
)


def p17(spark, sf):
    r = v_ret(spark, sf).withColumn("traded", F.dayofmonth("d") % 2 == 0)
    n = perf.net_of_cost(r, 0.001)
    return present(n.groupBy("strategy_id").agg(F.sum("net_r").alias("net"), F.count_if("traded").alias("n_traded")))


def p5(spark, sf):
    t = load(spark, sf, "events").select("event_type", F.element_at(F.array(*[F.lit(x) for x in ("1s", "5s", "1m", "5m", "15m", "1h", "1d", "settle")]), (F.col("user_id") % 8 + 1).cast("int")).alias("resolution")).distinct()
    t = t.withColumn("hours", F.when(F.col("event_type") == "error", 6.5).when(F.col("event_type") == "click", 23.0).when(F.col("event_type") == "view", 22.0).otherwise(24.0))
    t = t.withColumn("sessions", F.when(F.col("event_type") == "signup", 365).otherwise(252))
    return present(perf.periods_per_year(t))


P5_SQL = """WITH t AS (SELECT DISTINCT event_type, ['1s','5s','1m','5m','15m','1h','1d','settle'][user_id % 8 + 1] AS resolution,
      CASE event_type WHEN 'error' THEN 6.5e0 WHEN 'click' THEN 23e0 WHEN 'view' THEN 22e0 ELSE 24e0 END AS hours, CASE event_type WHEN 'signup' THEN 365 ELSE 252 END AS sessions FROM events)
    SELECT event_type, resolution, hours, sessions::BIGINT AS sessions, CASE WHEN resolution IN ('1d', 'settle') THEN sessions ELSE sessions * hours *
      CASE resolution WHEN '1s' THEN 3600e0 WHEN '5s' THEN 720e0 WHEN '1m' THEN 60e0 WHEN '5m' THEN 12e0 WHEN '15m' THEN 4e0 ELSE 1e0 END END AS periods_per_year FROM t"""


def p4(spark, sf):
    from ..functions import clock

    e = load(spark, sf, "events").withColumn("ts", F.expr("timestampadd(DAY, cast(event_id % 300 as int), ts)"))
    return present(e.select(
        "event_id", clock.wall_time(F.col("ts")).alias("et_time"), clock.session_date(F.col("ts")).alias("session"),
        clock.is_regular_hours(F.col("ts")).alias("regular"), clock.in_window(F.col("ts"), "22:00:00", "04:00:00").alias("overnight")))


P4_SQL = """WITH e AS (SELECT event_id, CAST((ts + to_days(CAST(event_id % 300 AS INTEGER))) AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS TIMESTAMP) AS t FROM events)
    SELECT event_id, strftime(t, '%H:%M:%S') AS et_time, CAST(t AS DATE)::VARCHAR AS session, strftime(t, '%H:%M:%S') >= '09:30:00' AND strftime(t, '%H:%M:%S') < '16:00:00' AS regular,
      strftime(t, '%H:%M:%S') >= '22:00:00' OR strftime(t, '%H:%M:%S') < '04:00:00' AS overnight FROM e"""


def p6(spark, sf):
    from ..functions.text import iso_utc, provenance_hash

    e = load(spark, sf, "events")
    sha = F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "props"), 256)
    return present(e.select("event_id", iso_utc(F.col("ts")).alias("iso"), provenance_hash(F.col("event_type"), F.col("ts"), sha).alias("provenance")))


P6_SQL = """WITH e AS (SELECT event_id, event_type, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 <> 0 THEN '.' || lpad((microsecond(ts) % 1000000)::VARCHAR, 6, '0') ELSE '' END || '+00:00' AS iso,
      sha256(event_id::VARCHAR || '|' || props) AS sha FROM events)
    SELECT event_id, iso, sha256(event_type || '||' || iso || '||' || sha) AS provenance FROM e"""


def _span(spark, sf):
    o = load(spark, sf, "orders")
    return o.agg(F.add_months(F.trunc(F.min("o_orderdate"), "year"), -12).alias("lo"), F.add_months(F.trunc(F.max("o_orderdate"), "year"), 40).alias("hi"))


@view(stored=True)
def v_cal(spark, sf):
    return cal_ops.exchange_calendar(_span(spark, sf))


# The twin lists holidays by another route: it tests each calendar day instead of computing dates.
CAL_SQL = {
    "v_span": "SELECT CAST(date_trunc('year', min(o_orderdate)) - INTERVAL 1 YEAR AS DATE) AS lo, CAST(date_trunc('year', max(o_orderdate)) + INTERVAL 40 MONTH AS DATE) AS hi FROM orders",
    "v_moon": """SELECT y, a, b, c, (b // 4) AS d4, b % 4 AS e4, (b + 8) // 25 AS f, c // 4 AS i4, c % 4 AS k4 FROM (
        SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM (SELECT unnest(range(year(lo), year(hi) + 2)) AS y FROM v_span))""",
    "v_easter": """SELECT y, make_date(y, (h + l - 7 * m + 114) // 31, (h + l - 7 * m + 114) % 31 + 1) AS easter FROM (
        SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM (SELECT *, (32 + 2 * e4 + 2 * i4 - h - k4) % 7 AS l FROM (
        SELECT *, (19 * a + b - d4 - (b - f + 1) // 3 + 15) % 30 AS h FROM v_moon)))""",
    "v_cal": """SELECT d, is_open, sum(is_open::INT) OVER (ORDER BY d)::BIGINT AS open_seq FROM (
        SELECT d, NOT (isodow(d) > 5
          OR (md IN (101, 704, 1225) OR (md = 619 AND year(d) >= 2022))
          OR (isodow(d) = 1 AND (md1 IN (101, 704, 1225) OR (md1 = 619 AND year(d) >= 2022)))
          OR (isodow(d) = 5 AND (mdn IN (101, 704, 1225) OR (mdn = 619 AND year(d) >= 2022)))
          OR (isodow(d) = 1 AND ((month(d) IN (1, 2) AND day(d) BETWEEN 15 AND 21) OR (month(d) = 5 AND day(d) >= 25) OR (month(d) = 9 AND day(d) <= 7)))
          OR (isodow(d) = 4 AND month(d) = 11 AND day(d) BETWEEN 22 AND 28)
          OR d + 2 = easter) AS is_open
        FROM (SELECT d, month(d) * 100 + day(d) AS md, month(d - 1) * 100 + day(d - 1) AS md1, month(d + 1) * 100 + day(d + 1) AS mdn, easter
          FROM (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM v_span) JOIN v_easter ON y = year(d)))""",
}


def csql(body):
    return sql(body, CAL_SQL)


def c1(spark, sf):
    """Open days with the number of orders placed on each."""
    o = load(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count(F.lit(1)).alias("orders"))
    return present(v_cal(spark, sf).join(o, "d", "left").withColumn("orders", F.coalesce("orders", F.lit(0))))


def c2(spark, sf):
    o = load(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d"), ((F.col("o_custkey") % 21) - 10).alias("n")).distinct()
    m = cal_ops.shift_days(o, "d", F.col("n"), v_cal(spark, sf), "moved").filter("moved IS NOT NULL")
    m = m.withColumns({"a": F.least("d", "moved"), "b": F.greatest("d", "moved")})
    return present(cal_ops.days_between(m, "a", "b", v_cal(spark, sf), "open_days").select("d", "n", "moved", "open_days"))


C2_SQL = csql(
    """WITH o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, o_custkey % 21 - 10 AS n FROM orders),
    op AS (SELECT d, row_number() OVER (ORDER BY d) AS k FROM v_cal WHERE is_open),
    m AS (SELECT o.d, n, CASE WHEN n = 0 THEN o.d
        WHEN n > 0 THEN (SELECT x.d FROM op x WHERE x.k = (SELECT count(*) FROM op WHERE op.d <= o.d) + n)
        ELSE (SELECT x.d FROM op x WHERE x.k = (SELECT count(*) FROM op WHERE op.d < o.d) + n + 1) END AS moved FROM o)
    SELECT d::VARCHAR AS d, n, moved::VARCHAR AS moved, (SELECT count(*) FROM op WHERE op.d >= least(m.d, moved) AND op.d <= greatest(m.d, moved)) AS open_days FROM m WHERE moved IS NOT NULL"""
)


def c3(spark, sf):
    """Roll calendar for the years orders were placed in."""
    years = load(spark, sf, "orders").select(F.year("o_orderdate").alias("y")).distinct()
    return present(cal_ops.roll_calendar(years, v_cal(spark, sf)))


def _c3_sql():
    from .. import dims

    rows = ", ".join(
        f"('{r}', '{c}', {sym_m}, '{fam}', '{anc}', {t}, {dl})"
        for r, _, _, _, cyc, fam, anc, t, dl in dims.ROOTS if fam
        for c in cyc for sym_m in [("FGHJKMNQUVXZ".index(c) + 1)]
    )
    lastopen = lambda e: f"(SELECT max(d) FROM op WHERE op.d <= {e})"
    back = lambda e, n: f"(SELECT d FROM op WHERE k = (SELECT max(k) FROM op x WHERE x.d <= {e}) - {n})"
    return csql(
        f"""WITH op AS (SELECT d, row_number() OVER (ORDER BY d) AS k FROM v_cal WHERE is_open),
        r(root, code, m, fam, anc, t, dl) AS (VALUES {rows}),
        x AS (SELECT r.*, y, make_date(y, m, 1) AS f FROM r, (SELECT DISTINCT year(o_orderdate) AS y FROM orders )),
        dd AS (SELECT *, CAST(f + CAST((12 - isodow(f)) % 7 AS INTEGER) AS DATE) AS fri, CAST(f + CAST((10 - isodow(f)) % 7 AS INTEGER) AS DATE) AS wed FROM x),
        l AS (SELECT *, CASE fam WHEN 'third_friday' THEN {lastopen('CAST(fri + 14 AS DATE)')} WHEN 'second_friday' THEN (SELECT max(d) FROM op WHERE op.d < fri + 7)
            WHEN 'currency' THEN {back('CAST(wed + 14 AS DATE)', 2)} WHEN 'last_friday' THEN {lastopen('CAST(last_day(f) - CAST((isodow(last_day(f)) + 2) % 7 AS INTEGER) AS DATE)')}
            WHEN 'crude' THEN {back("CAST(f - INTERVAL 1 MONTH AS DATE) + 24", 3)} WHEN 'metal' THEN {back('last_day(f)', 2)} ELSE {back('last_day(f)', 7)} END AS ltd FROM dd),
        n AS (SELECT *, CASE WHEN fam IN ('metal', 'treasury') THEN (SELECT max(d) FROM op WHERE op.d < f) WHEN fam = 'crude' THEN {back('ltd', -2)} END AS fnd FROM l),
        a AS (SELECT *, CASE WHEN anc = 'LTD' THEN ltd ELSE fnd END AS an FROM n),
        e AS (SELECT *, {back('an', 't')} AS roll_target, CASE WHEN fam = 'crude' THEN least({back('an', 'dl')}, {back('fnd', 1)}) ELSE {back('an', 'dl')} END AS roll_deadline FROM a),
        nx AS (SELECT root, code, lead(code) OVER (PARTITION BY root ORDER BY m) AS nc, first_value(code) OVER (PARTITION BY root ORDER BY m) AS fc FROM r)
        SELECT e.root, e.root || e.code || lpad((y % 100)::VARCHAR, 2, '0') AS contract, e.root || coalesce(nc, fc) || lpad(((y + CASE WHEN nc IS NULL THEN 1 ELSE 0 END) % 100)::VARCHAR, 2, '0') AS back,
          ltd::VARCHAR AS ltd, fnd::VARCHAR AS fnd, roll_target::VARCHAR AS roll_target, roll_deadline::VARCHAR AS roll_deadline, 'RTH' AS regime FROM e JOIN nx ON nx.root = e.root AND nx.code = e.code"""
    )


def j9(spark, sf):
    e = _events(spark, sf)
    g = events.event_gate(v_ret(spark, sf), e, 0, 2, exclude=["FOMC_STATEMENT"])
    return present(g.groupBy("strategy_id", "multiplier").agg(F.count(F.lit(1)).alias("n"), F.sum("gated_r").alias("gated")))


J9_SQL = sql(
    """WITH m AS (SELECT r.*, coalesce((SELECT min(CASE WHEN series IN ('NFP', 'CPI', 'FOMC_STATEMENT') THEN 0.5e0 ELSE 1e0 END) FROM v_events e WHERE series <> 'FOMC_STATEMENT' AND e.release_date - r.d BETWEEN 0 AND 2), 1e0) AS multiplier FROM v_ret r)
    SELECT strategy_id, multiplier, count(*) AS n, round(sum(r * multiplier), 6) AS gated FROM m GROUP BY 1, 2""",
    EVENTS_SQL,
)


def p9(spark, sf):
    return present(events.with_severity(_events(spark, sf)).groupBy("severity", "size_multiplier").agg(F.count(F.lit(1)).alias("n")))


QUERIES = {
    "A7_performance": a7, "A8_trade_metrics": a8, "A9_sharpe_moments": a9, "A10_probabilistic_sharpe": a10, "A11_min_track_record": a11,
    "A12_deflated_sharpe": a12, "A13_lo_factor": a13, "A14_winsorised_sharpe": a14, "A15_tail_contribution": a15, "A16_T4_skew_without_extremes": a16,
    "A17_quantile_skew": a17, "A18_tail_means": a18, "A19_profit_factor": a19, "A21_decay_verdict": a21, "A22_lag_one": a22, "A23_family_bridge": a23,
    "W4_ruin_latch": w4, "W5_drawdown": w5, "W9_trailing_sharpe": w9, "P4_session_clock": p4, "P5_periods_per_year": p5, "P6_provenance_hash": p6,
    "P9_severity": p9, "P17_net_of_cost": p17, "C1_exchange_calendar": c1, "C2_trading_day_arithmetic": c2, "C3_roll_calendar": c3, "J9_event_gate": j9,
}

ORACLES = {
    "A7_performance": A7_SQL, "A8_trade_metrics": A8_SQL,
    "A9_sharpe_moments": ssql("SELECT strategy_id, n, round(sr, 6) AS sr, round(skew, 6) AS skew, round(kurt, 6) AS kurt FROM v_mom"),
    "A10_probabilistic_sharpe": A10_SQL, "A11_min_track_record": A11_SQL, "A12_deflated_sharpe": A12_SQL, "A13_lo_factor": A13_SQL,
    "A14_winsorised_sharpe": A14_SQL, "A15_tail_contribution": A15_SQL, "A16_T4_skew_without_extremes": A16_SQL, "A17_quantile_skew": A17_SQL,
    "A18_tail_means": A18_SQL,
    "A19_profit_factor": sql("""WITH g AS (SELECT strategy_id, sum(r) FILTER (r > 0) AS g, -sum(r) FILTER (r < 0) AS l FROM v_ret GROUP BY 1)
        SELECT strategy_id, round(g, 6) AS gains, round(l, 6) AS losses, round(g / l, 6) AS profit_factor FROM g"""),
    "A21_decay_verdict": A21_SQL, "A22_lag_one": A22_SQL, "A23_family_bridge": A23_SQL, "W4_ruin_latch": W4_SQL,
    "W5_drawdown": sql("""SELECT strategy_id, d::VARCHAR AS d, round((p - equity) / p, 6) AS drawdown FROM (SELECT *, max(equity) OVER (PARTITION BY strategy_id ORDER BY d) AS p FROM v_equity)"""),
    "W9_trailing_sharpe": W9_SQL, "P4_session_clock": P4_SQL, "P5_periods_per_year": P5_SQL, "P6_provenance_hash": P6_SQL,
    "P9_severity": sql("""SELECT CASE WHEN series = 'FOMC_STATEMENT' THEN 'CRITICAL' WHEN series IN ('CPI', 'NFP') THEN 'HIGH' WHEN series = 'JOBLESS_CLAIMS' THEN 'MEDIUM' ELSE 'LOW' END AS severity,
        CASE WHEN series IN ('FOMC_STATEMENT', 'CPI', 'NFP') THEN 0.5e0 ELSE 1e0 END AS size_multiplier, count(*) AS n FROM v_events GROUP BY 1, 2""", EVENTS_SQL),
    "P17_net_of_cost": sql("SELECT strategy_id, round(sum(CASE WHEN day(d) % 2 = 0 THEN r - 0.001e0 ELSE r END), 6) AS net, count(*) FILTER (day(d) % 2 = 0) AS n_traded FROM v_ret GROUP BY 1"),
    "C1_exchange_calendar": csql("""SELECT c.d::VARCHAR AS d, is_open, open_seq, coalesce(n, 0) AS orders FROM v_cal c LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1) o ON o.d = c.d"""),
    "C2_trading_day_arithmetic": C2_SQL, "C3_roll_calendar": _c3_sql(), "J9_event_gate": J9_SQL,
}
