"""Registered queries: rolls, fills, positions, orders and sizing."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions import contracts as sym
from ..operators import orders as order_ops
from ..operators import positions as pos
from ..operators import rolls, sizing
from .views import load, present, sql, v_bars, v_base, v_contract_bars, v_equity, v_fills, v_orders, v_ret, v_roll, view

_DIM_SQL = "(VALUES " + ", ".join(
    f"('{r[0]}', {r[1]}::DECIMAL(20,8), {r[2]}::DECIMAL(20,8), {r[3]}::DECIMAL(20,8), '{r[4]}')" for r in dims.ROOTS
) + ") dim(root, multiplier, margin, tick, cycle)"

VIEWS = {
    "v_win": """SELECT p.root, p.contract, r.back, r.ltd, r.roll_target, r.roll_deadline,
        lag(r.roll_target) OVER (PARTITION BY p.root ORDER BY r.roll_target) AS starts
        FROM (SELECT DISTINCT root, contract FROM v_contract_bars) p JOIN v_roll r ON r.contract = p.contract""",
    "v_spliced": """SELECT b.* FROM v_contract_bars b JOIN v_win w ON w.contract = b.contract
        WHERE (starts IS NULL OR d >= starts) AND d < roll_target""",
    "v_flags": "SELECT *, lag(contract) OVER (PARTITION BY root ORDER BY d) AS prev_contract FROM v_spliced",
    "v_events": """SELECT c.root, c.prev_contract AS old_contract, c.contract AS new_contract, w.roll_target AS roll_date,
        (SELECT arg_max(close, d) FROM v_contract_bars b WHERE b.contract = c.prev_contract AND b.d <= w.roll_target) AS front_settle,
        (SELECT arg_min(close, d) FROM v_contract_bars b WHERE b.contract = c.contract AND b.d >= w.roll_target) AS back_settle
        FROM v_flags c JOIN v_win w ON w.contract = c.prev_contract WHERE c.prev_contract <> c.contract""",
    "v_f": f"SELECT f.*, dim.multiplier FROM v_fills f JOIN {_DIM_SQL} ON dim.root = f.root",
    "v_net": "SELECT account, root, d, sum(q) OVER (PARTITION BY account, root ORDER BY d)::BIGINT AS net FROM (SELECT account, root, d, sum(qty) AS q FROM v_fills GROUP BY 1, 2, 3)",
}


def tsql(body):
    return sql(body, VIEWS)


@view(stored=True)
def v_win(spark, sf):
    return rolls.active_windows(v_contract_bars(spark, sf), v_roll(spark, sf))


@view(stored=True)
def v_spliced(spark, sf):
    return rolls.splice(v_contract_bars(spark, sf), v_win(spark, sf))


@view(stored=True)
def v_flags(spark, sf):
    return rolls.roll_flags(v_spliced(spark, sf))


@view(stored=True)
def v_events(spark, sf):
    return rolls.roll_events(v_flags(spark, sf), v_contract_bars(spark, sf), v_win(spark, sf))


@view(stored=False)
def v_f(spark, sf):
    return dims.with_root_facts(v_fills(spark, sf), "multiplier")


def j4(spark, sf):
    return present(v_spliced(spark, sf).select("root", "contract", "d", "close", "volume"))


def w1(spark, sf):
    return present(v_flags(spark, sf).select("root", "d", "contract", "roll_flag"))


def w2(spark, sf):
    return present(rolls.roll_clean_returns(v_spliced(spark, sf)).select("root", "d", "contract", "clean_return"))


def j5(spark, sf):
    return present(v_events(spark, sf).select("root", "roll_date", "old_contract", "new_contract", "front_settle", "back_settle", "roll_gap"))


def w3(spark, sf):
    return present(rolls.ratio_adjusted(v_spliced(spark, sf), v_events(spark, sf)).select("root", "d", "contract", "adjusted_close"))


def j6(spark, sf):
    return present(rolls.carry_inputs(v_contract_bars(spark, sf), v_roll(spark, sf), v_win(spark, sf)))


def j7(spark, sf):
    pts = v_spliced(spark, sf).select("root", F.explode(F.expr("array(last_day(d), date_add(trunc(d, 'month'), 14))")).alias("d")).distinct()
    return present(rolls.active_contract(v_spliced(spark, sf), pts))


def u3(spark, sf):
    return present(v_contract_bars(spark, sf).groupBy("d").agg(F.count_distinct("contract").alias("contracts")))


def _open_positions(spark, sf):
    b = v_contract_bars(spark, sf)
    return b.select("contract", "d", ((F.col("volume") * 7 + F.dayofmonth("d")) % 5 - 2).alias("qty")).withColumnRenamed("d", "today")


def j12(spark, sf):
    pairs = v_roll(spark, sf).filter("substr(contract, -3, 1) = 'H'").select("contract", "back")
    return present(rolls.roll_decisions(_open_positions(spark, sf), v_roll(spark, sf), pairs).select(
        "contract", "back", "today", "qty", "method", "reason", "roll_deadline"))


def w12(spark, sf):
    mult = dims.root_table(spark).select("root", "multiplier")
    return present(rolls.roll_bookings(v_events(spark, sf), pos.daily_net(v_fills(spark, sf)), mult))


def w7(spark, sf):
    t = pos.trade_ledger(v_f(spark, sf))
    return present(t.select("account", "root", "trade_no", F.round(F.col("pnl").cast("double"), 2).alias("pnl"), "opened", "closed", "volume"))


_W7 = """WITH a AS (SELECT *, sum(qty) OVER w AS net, sum(qty) OVER w - qty AS before FROM v_f WINDOW w AS (PARTITION BY account, root ORDER BY seq)),
    e AS (SELECT *, CASE WHEN before <> 0 AND (net = 0 OR sign(net) <> sign(before)) THEN 1 ELSE 0 END AS ends FROM a),
    n AS (SELECT *, sum(ends) OVER (PARTITION BY account, root ORDER BY seq) AS done FROM e),
    c AS (SELECT *, CASE WHEN before <> 0 AND sign(before) <> sign(qty) THEN sign(qty) * least(abs(before), abs(qty)) ELSE 0 END AS cq FROM n),
    p AS (SELECT account, root, d, price, multiplier, cq AS q, done - ends AS bet, ends FROM c UNION ALL
      SELECT account, root, d, price, multiplier, qty - cq, done, 0 FROM c)
    """


def w8(spark, sf):
    f = pos.average_cost(v_f(spark, sf))
    return present(f.select("account", "root", "d", "qty", "net", F.round(F.col("avg_price") + 1e-7, 4).alias("avg_price"), F.round(F.col("realised") + 0.001, 1).alias("realised")))


_W8 = (
    """WITH RECURSIVE o AS (SELECT account, root, d, qty, price::DOUBLE AS price, multiplier::DOUBLE AS mult, row_number() OVER (PARTITION BY account, root ORDER BY seq) AS rn FROM v_f),
    s AS (SELECT account, root, d, qty, rn, qty::BIGINT AS net, price AS avg, 0e0 AS realised FROM o WHERE rn = 1
      UNION ALL
      SELECT o.account, o.root, o.d, o.qty, o.rn, (s.net + o.qty)::BIGINT,
        CASE WHEN s.net + o.qty = 0 THEN 0e0
             WHEN s.net = 0 OR sign(s.net + o.qty) <> sign(s.net) THEN o.price
             WHEN sign(s.net) = sign(o.qty) THEN (s.avg * abs(s.net) + o.price * abs(o.qty)) / abs(s.net + o.qty)
             ELSE s.avg END,
        s.realised + CASE WHEN s.net <> 0 AND sign(s.net) <> sign(o.qty)
          THEN (o.price - s.avg) * least(abs(s.net), abs(o.qty)) * sign(s.net) * o.mult ELSE 0e0 END
      FROM s JOIN o ON o.account = s.account AND o.root = s.root AND o.rn = s.rn + 1)
    SELECT account, root, d::VARCHAR AS d, qty, net, round(avg + 1e-7, 4) AS avg_price, round(realised + 0.001e0, 1) AS realised FROM s"""
)
W8_SQL = tsql(_W8)


def w10(spark, sf):
    f = pos.loss_limit_flags(v_f(spark, sf), 5e6, 2e7, 60)
    return present(f.groupBy("account", "verdict").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("first"), F.max("d").alias("last")))


#: Limits of a session, which is a quarter here: an account trades on few days of the test data.
SESSION = "string(date(date_trunc('quarter', d)))"
SESSION_LIMITS = (1e6, 3e6, 60)


def w10_sessions(spark, sf):
    f = pos.loss_limit_flags(v_f(spark, sf), *SESSION_LIMITS, session=F.expr(SESSION))
    return present(f.groupBy("account", "session", "verdict").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("first"), F.max("d").alias("last")))


def w11(spark, sf):
    e = pos.equity_curve(v_f(spark, sf), v_base(spark, sf).withColumnRenamed("px", "close"))
    return present(e.select("account", "d", F.round("equity", 2).alias("equity")))


W11_SQL = tsql(
    """WITH ch AS (SELECT account, root, min(d) AS first, max(multiplier) AS m FROM v_f GROUP BY 1, 2),
    ax AS (SELECT DISTINCT ch.account, b.d FROM ch JOIN v_base b ON b.root = ch.root AND b.d >= ch.first),
    fl AS (SELECT account, root, d, sum(qty) AS q, sum(-qty * price * multiplier) AS c FROM v_f GROUP BY 1, 2, 3),
    g AS (SELECT ax.account, ax.d, ch.root, ch.m, fl.q, fl.c, b.px FROM ax JOIN ch ON ch.account = ax.account
      LEFT JOIN fl ON fl.account = ax.account AND fl.root = ch.root AND fl.d = ax.d
      LEFT JOIN v_base b ON b.root = ch.root AND b.d = ax.d AND b.d >= ch.first),
    r AS (SELECT account, d, coalesce(sum(c) OVER w, 0) + coalesce(sum(q) OVER w, 0) * coalesce(last_value(px IGNORE NULLS) OVER w, 0) * m AS worth FROM g
      WINDOW w AS (PARTITION BY account, root ORDER BY d))
    SELECT account, d::VARCHAR AS d, round(50000e0 + CAST(sum(worth) AS DOUBLE), 2) AS equity FROM r GROUP BY account, d"""
)


def j13(spark, sf):
    pts = v_fills(spark, sf).select("root", F.date_add(F.last_day("d"), 3).alias("d")).distinct()
    return present(pos.mark_prices(pts, v_base(spark, sf).select("root", "d", F.col("px").alias("close")), ["root"]))


def w13(spark, sf):
    st = pos.average_cost(v_f(spark, sf)).select("account", "root", "d", "fill_key", "net", "avg_price")
    out = pos.stop_loss_flags(st, v_base(spark, sf).select("root", "d", F.col("px").alias("close")), 0.05)
    return present(out.groupBy("account", "root", "stop").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("adverse") + 1e-7, 4).alias("worst")))


W13_SQL = tsql(_W8.rsplit("SELECT account, root, d::VARCHAR", 1)[0] + """,
    day AS (SELECT account, root, d, arg_max(net, rn) AS net, arg_max(avg, rn) AS avg FROM s GROUP BY 1, 2, 3),
    j AS (SELECT p.account, p.root, b.d, b.px::DOUBLE AS px, day.net, day.avg FROM (SELECT DISTINCT account, root FROM day) p JOIN v_base b ON b.root = p.root
      ASOF JOIN day ON day.account = p.account AND day.root = p.root AND b.d >= day.d),
    a AS (SELECT *, CASE WHEN net > 0 THEN (avg - px) / avg ELSE (px - avg) / avg END AS adv FROM j WHERE net <> 0)
    SELECT account, root, adv >= 0.05 AS stop, count(*) AS n, round(max(adv) + 1e-7, 4) AS worst FROM a GROUP BY account, root, stop""")

W10_SQL = tsql(_W8.rsplit("SELECT account, root, d::VARCHAR", 1)[0].replace(
    "row_number() OVER (PARTITION BY account, root ORDER BY seq) AS rn FROM v_f", "seq, row_number() OVER (PARTITION BY account, root ORDER BY seq) AS rn FROM v_f"
).replace("qty, rn, qty::BIGINT AS net", "qty, seq, rn, qty::BIGINT AS net").replace("o.qty, o.rn, (s.net", "o.qty, o.seq, o.rn, (s.net") + """,
    g AS (SELECT *, net - qty AS before, realised - coalesce(lag(realised) OVER (PARTITION BY account, root ORDER BY rn), 0) AS gain FROM s),
    k AS (SELECT *, coalesce(sum(CAST(gain AS DECIMAL(28,6))) OVER (PARTITION BY account ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS kn,
      abs(net) >= abs(before) AS inc, abs(net) > 60 AS over FROM g),
    q AS (SELECT *, greatest(0, coalesce(max(CASE WHEN inc AND NOT over THEN kn END) OVER (PARTITION BY account ORDER BY seq), 0)) AS peak FROM k),
    b AS (SELECT *, inc AND NOT over AND (kn <= -5e6 OR peak - kn >= 2e7) AS br FROM q),
    h AS (SELECT *, coalesce(sum(br::INT) OVER (PARTITION BY account ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hits FROM b),
    v AS (SELECT *, CASE WHEN NOT inc THEN 'reduce' WHEN hits > 0 THEN 'halted' WHEN over THEN 'max_contracts' WHEN br AND kn <= -5e6 THEN 'loss_limit'
      WHEN br THEN 'trailing_limit' ELSE 'allowed' END AS verdict FROM h)
    SELECT account, verdict, count(*) AS n, min(d)::VARCHAR AS first, max(d)::VARCHAR AS last FROM v GROUP BY account, verdict""")

W10_SESSIONS_SQL = W10_SQL.replace("SELECT *, net - qty AS before", "SELECT *, strftime(date_trunc('quarter', d), '%Y-%m-%d') AS session, net - qty AS before").replace(
    "PARTITION BY account ORDER BY seq", "PARTITION BY account, session ORDER BY seq"
).replace("-5e6", "-1e6").replace("2e7", "3e6").replace("SELECT account, verdict, count", "SELECT account, session, verdict, count").replace("FROM v GROUP BY account, verdict", "FROM v GROUP BY account, session, verdict")


@view(stored=True)
def v_signals(spark, sf):
    """Signals per strategy and day: kelly from the day's return, equity and price at hand."""
    r = v_ret(spark, sf).join(v_equity(spark, sf).filter("strategy_id < 20"), ["strategy_id", "d"])
    root = F.expr("CASE strategy_id % 4 WHEN 0 THEN 'ES' WHEN 1 THEN 'CL' WHEN 2 THEN 'GC' ELSE 'ZN' END")
    s = r.withColumn("root", root).join(v_base(spark, sf).select("root", "d", "px"), ["root", "d"])
    return s.select(
        "strategy_id", "root", "d", F.greatest(F.col("r"), F.lit(0.0)).alias("edge"),
        (F.greatest(F.col("r"), F.lit(0.0)) * 1000).alias("kelly"), (F.greatest(F.col("equity"), F.lit(1000.0)) * 97.31).alias("equity"), F.col("px").alias("price"),
        F.when(F.col("r") > 0, 1).when(F.col("r") < 0, -1).otherwise(0).alias("direction"), "r",
        (F.dayofmonth("d") % 7).cast("long").alias("survival_contracts"),
    )


VIEWS["v_signals"] = """SELECT strategy_id, s.root, s.d, greatest(r, 0e0) AS edge, greatest(r, 0e0) * 1000 AS kelly, greatest(equity, 1000e0) * 97.31e0 AS equity, b.px AS price,
    CASE WHEN r > 0 THEN 1 WHEN r < 0 THEN -1 ELSE 0 END AS direction, r, day(s.d) % 7 AS survival_contracts FROM (
    SELECT r.*, e.equity, ['ES', 'CL', 'GC', 'ZN'][r.strategy_id % 4 + 1] AS root FROM v_ret r JOIN v_equity e ON e.strategy_id = r.strategy_id AND e.d = r.d) s
    JOIN v_base b ON b.root = s.root AND b.d = s.d"""


def w14(spark, sf):
    t = v_signals(spark, sf).withColumn("target", (F.col("direction") * (1 + F.dayofmonth("d") % 3)).cast("long"))
    return present(pos.target_deltas(t, ["strategy_id"]).select("strategy_id", "d", "target", "delta", "side"))


def x1(spark, sf):
    s = sizing.size_positions(v_signals(spark, sf).drop("survival_contracts"))
    return present(s.select("strategy_id", "d", "contracts", "binding", "kelly_contracts", "margin_contracts", "leverage_contracts"))


_X_BASE = f"""WITH s AS (SELECT v.*, floor(equity * 0.5e0 / margin::DOUBLE)::BIGINT AS margin_contracts, floor(equity * 3e0 / (price::DOUBLE * multiplier::DOUBLE))::BIGINT AS leverage_contracts,
    CASE WHEN kelly <= 0 THEN 0 ELSE floor(kelly * 0.25e0 * equity / (price::DOUBLE * multiplier::DOUBLE)) END::BIGINT AS kelly_contracts
    FROM v_signals v JOIN {_DIM_SQL} ON dim.root = v.root)"""
X1_SQL = tsql(
    _X_BASE + """ SELECT strategy_id, d::VARCHAR AS d, CASE WHEN kelly <= 0 THEN 0 ELSE least(kelly_contracts, margin_contracts, leverage_contracts) END AS contracts,
    CASE WHEN kelly <= 0 THEN 'no_edge' WHEN kelly_contracts <= least(margin_contracts, leverage_contracts) THEN 'kelly'
      WHEN margin_contracts <= leverage_contracts THEN 'margin' ELSE 'leverage' END AS binding, kelly_contracts, margin_contracts, leverage_contracts FROM s"""
)


def _months(spark, sf):
    """Per root and month: its first date and the price then."""
    return v_base(spark, sf).groupBy("root", F.trunc("d", "month").alias("month")).agg(F.min("d").alias("valid_from"), F.min_by("px", "d").alias("px"))


def x1_dated(spark, sf):
    """Margins that follow prices: each month 7 % of a contract's value on the month's first date."""
    m = dims.with_root_facts(_months(spark, sf), "multiplier")
    m = m.select("root", "valid_from", (F.col("px").cast("double") * F.col("multiplier").cast("double") * 0.07).alias("margin"))
    s = sizing.size_positions(v_signals(spark, sf).drop("survival_contracts"), margins=m)
    return present(s.select("strategy_id", "d", "contracts", "binding", "margin_contracts", "margin"))


_MONTHS = "(SELECT root, date_trunc('month', d) AS month, min(d) AS valid_from, arg_min(px, d) AS px FROM v_base GROUP BY 1, 2)"
X1_DATED_SQL = tsql(
    f"""WITH s AS (SELECT v.*, m.px::DOUBLE * multiplier::DOUBLE * 0.07e0 AS mg, floor(equity * 3e0 / (price::DOUBLE * multiplier::DOUBLE))::BIGINT AS lc,
      CASE WHEN kelly <= 0 THEN 0 ELSE floor(kelly * 0.25e0 * equity / (price::DOUBLE * multiplier::DOUBLE)) END::BIGINT AS kc
      FROM v_signals v JOIN {_DIM_SQL} ON dim.root = v.root ASOF JOIN {_MONTHS} m ON m.root = v.root AND v.d >= m.valid_from),
    t AS (SELECT *, floor(equity * 0.5e0 / mg)::BIGINT AS mc FROM s)
    SELECT strategy_id, d::VARCHAR AS d, CASE WHEN kelly <= 0 THEN 0 ELSE least(kc, mc, lc) END AS contracts,
      CASE WHEN kelly <= 0 THEN 'no_edge' WHEN kc <= least(mc, lc) THEN 'kelly' WHEN mc <= lc THEN 'margin' ELSE 'leverage' END AS binding, mc AS margin_contracts, round(mg, 6) AS margin FROM t"""
)


def x2(spark, sf):
    s = sizing.size_fixed(v_signals(spark, sf), 3)
    return present(s.select("strategy_id", "d", "contracts"))


X2_SQL = tsql(
    _X_BASE + """ SELECT strategy_id, d::VARCHAR AS d, CASE WHEN kelly <= 0 THEN 0 ELSE least(3, margin_contracts, leverage_contracts,
      CASE WHEN least(kelly_contracts, margin_contracts, leverage_contracts) > 0 THEN survival_contracts END) END::BIGINT AS contracts FROM s"""
)


def a20(spark, sf):
    legs = v_ret(spark, sf).select((F.col("strategy_id") % 3).alias("portfolio"), "strategy_id", F.when(F.col("strategy_id") == 7, 0.01).otherwise(F.col("r")).alias("r"))
    return present(sizing.inverse_vol_weights(legs, ["portfolio"], "strategy_id").select("portfolio", "strategy_id", "weight"))


_A20 = """WITH l AS (SELECT strategy_id % 3 AS portfolio, strategy_id, stddev_samp(CASE WHEN strategy_id = 7 THEN 0.01e0 ELSE r END) AS sd FROM v_ret GROUP BY 1, 2),
    i AS (SELECT *, CASE WHEN sd > 0 THEN 1 / sd END AS inv FROM l),
    w AS (SELECT *, coalesce(inv, avg(inv) OVER (PARTITION BY portfolio), 1e0) AS raw FROM i)"""


def x3(spark, sf):
    s = v_signals(spark, sf).withColumn("portfolio", F.col("strategy_id") % 3)
    legs = s.select("portfolio", "strategy_id", "r")
    w = sizing.inverse_vol_weights(legs, ["portfolio"], "strategy_id").select("strategy_id", "weight")
    s = s.drop("survival_contracts").join(w, "strategy_id").withColumn("kelly", F.col("kelly") * F.col("weight"))
    return present(sizing.size_positions(s).groupBy("strategy_id", "binding").agg(F.count(F.lit(1)).alias("n"), F.sum("contracts").alias("contracts")))


X3_SQL = tsql(
    f"""WITH l AS (SELECT strategy_id % 3 AS portfolio, strategy_id, stddev_samp(r) AS sd FROM v_signals GROUP BY 1, 2),
    w AS (SELECT strategy_id, (1 / sd) / avg(1 / sd) OVER (PARTITION BY portfolio) AS wt FROM l),
    s AS (SELECT v.strategy_id, kelly, floor(equity * 0.5e0 / margin::DOUBLE)::BIGINT AS mc, floor(equity * 3e0 / (price::DOUBLE * multiplier::DOUBLE))::BIGINT AS lc,
      CASE WHEN kelly <= 0 THEN 0 ELSE floor(kelly * wt * 0.25e0 * equity / (price::DOUBLE * multiplier::DOUBLE)) END::BIGINT AS kc
      FROM v_signals v JOIN {_DIM_SQL} ON dim.root = v.root JOIN w ON w.strategy_id = v.strategy_id)
    SELECT strategy_id, CASE WHEN kelly <= 0 THEN 'no_edge' WHEN kc <= least(mc, lc) THEN 'kelly' WHEN mc <= lc THEN 'margin' ELSE 'leverage' END AS binding,
      count(*) AS n, sum(CASE WHEN kelly <= 0 THEN 0 ELSE least(kc, mc, lc) END)::BIGINT AS contracts FROM s GROUP BY 1, 2"""
)


def j8(spark, sf):
    f = pos.fill_orders(v_orders(spark, sf), v_bars(spark, sf))
    return present(f.select("order_id", "contract", "order_type", "side", "filled_at", "fill_price"))


_J8 = """WITH j AS (SELECT o.order_id, arg_min(b, b.ts) AS h FROM v_orders o JOIN v_bars b ON b.contract = o.contract AND b.ts > o.ts
      AND CASE WHEN order_type = 'MKT' THEN true WHEN order_type = 'LMT' THEN CASE WHEN side = 'buy' THEN b.low <= limit_price ELSE b.high >= limit_price END
        ELSE CASE WHEN side = 'buy' THEN b.high >= stop_price ELSE b.low <= stop_price END END GROUP BY 1),
    f AS (SELECT o.*, h.ts AS filled_at, CASE WHEN h IS NULL THEN NULL WHEN order_type = 'MKT' THEN h.open WHEN order_type = 'LMT' THEN limit_price ELSE stop_price END AS fill_price
      FROM v_orders o LEFT JOIN j ON j.order_id = o.order_id)"""


def p7(spark, sf):
    f = pos.fill_orders(v_orders(spark, sf), v_bars(spark, sf)).filter("fill_price IS NOT NULL")
    return present(order_ops.apply_slippage(f, [band for band, _ in dims.SLIPPAGE_BANDS]).select("order_id", "band", "slipped_price"))


P7_SQL = tsql(
    _J8 + f""" SELECT order_id, band, (CASE WHEN order_type = 'LMT' THEN fill_price WHEN side = 'buy' THEN fill_price + tick * k ELSE fill_price - tick * k END)::DOUBLE AS slipped_price
    FROM f JOIN {_DIM_SQL} ON dim.root = left(contract, length(contract) - 3), (VALUES ('CONSERVATIVE', 2), ('REALISTIC', 1), ('PESSIMISTIC', 4)) bands(band, k)
    WHERE fill_price IS NOT NULL"""
)



def p7_dated(spark, sf):
    """Tick sizes doubled in odd years, one to three ticks by month."""
    f = pos.fill_orders(v_orders(spark, sf), v_bars(spark, sf)).filter("fill_price IS NOT NULL")
    ticks = (1 + F.month("valid_from") % 3).cast("int")
    day = F.to_date("ts")
    months = v_bars(spark, sf).groupBy(sym.contract_root(F.col("contract")).alias("root"), F.trunc(day, "month").alias("month")).agg(F.min(day).alias("valid_from"))
    slips = dims.with_root_facts(months, "tick").select("root", "valid_from", (F.col("tick") * (1 + F.year("valid_from") % 2)).cast("decimal(20,8)").alias("tick"), ticks.alias("ticks"))
    return present(order_ops.apply_slippage(f, slips=slips).select("order_id", "ticks", "slipped_price"))


P7_DATED_SQL = tsql(
    _J8 + f""", m AS (SELECT m.root, valid_from, (tick * (1 + year(valid_from) % 2))::DECIMAL(20,8) AS tick, 1 + month(valid_from) % 3 AS k
      FROM (SELECT left(contract, length(contract) - 3) AS root, min(ts::DATE) AS valid_from FROM v_bars GROUP BY 1, date_trunc('month', ts)) m JOIN {_DIM_SQL} ON dim.root = m.root)
    SELECT order_id, k::BIGINT AS ticks, (CASE WHEN order_type = 'LMT' THEN fill_price WHEN side = 'buy' THEN fill_price + tick * k ELSE fill_price - tick * k END)::DOUBLE AS slipped_price
    FROM (SELECT *, left(contract, length(contract) - 3) AS r, filled_at::DATE AS fd FROM f WHERE fill_price IS NOT NULL) g ASOF JOIN m ON m.root = g.r AND g.fd >= m.valid_from"""
)

_TYPES = ["MKT", "LMT", "STP", "STP_LMT", "STP_PRT", "MIT", "LIT", "MOC", "MOO", "TRAIL", "TRAIL_LMT", "JOIN_BID", "JOIN_ASK", "ICEBERG"]


def p16(spark, sf):
    types = F.array(*[F.lit(t) for t in _TYPES])
    o = load(spark, sf, "orders").select("o_orderkey", F.element_at(types, (F.col("o_custkey") % len(_TYPES) + 1).cast("int")).alias("order_type"))
    return present(order_ops.downgrade_orders(o).groupBy("order_type", "action", "sent_as", "severity").agg(F.count(F.lit(1)).alias("n")))


P16_SQL = f"""WITH o AS (SELECT {_TYPES!r}[o_custkey % {len(_TYPES)} + 1] AS order_type FROM orders),
    r(t, target, sev) AS (VALUES {", ".join(f"('{t}', {'NULL' if g is None else repr(g)}, '{s}')" for t, g, s in dims.ORDER_DOWNGRADES)})
    SELECT order_type, CASE WHEN order_type IN {tuple(dims.NATIVE_ORDER_TYPES)} THEN 'native' WHEN target IS NOT NULL THEN 'rewrite' ELSE 'reject' END AS action,
      CASE WHEN order_type IN {tuple(dims.NATIVE_ORDER_TYPES)} THEN order_type ELSE target END AS sent_as,
      CASE WHEN order_type IN {tuple(dims.NATIVE_ORDER_TYPES)} THEN NULL ELSE coalesce(sev, 'HIGH') END AS severity, count(*) AS n
    FROM o LEFT JOIN r ON t = order_type GROUP BY 1, 2, 3, 4"""


def _symbols(spark, sf):
    roots = F.array(*[F.lit(r[0]) for r in dims.ROOTS])
    cycles = F.array(*[F.lit(r[4]) for r in dims.ROOTS])
    i = (F.col("o_custkey") % len(dims.ROOTS) + 1).cast("int")
    cyc = F.element_at(cycles, i)
    code = F.substring(cyc, (F.col("o_orderkey") % F.length(cyc) + 1).cast("int"), F.lit(1))
    return load(spark, sf, "orders").select(
        F.concat(F.element_at(roots, i), code, F.lpad((F.year("o_orderdate") % 100).cast("string"), 2, "0")).alias("symbol")
    ).distinct()


_SYM_SQL = f"""SELECT DISTINCT r || c[(o_orderkey % length(c) + 1)::INT] || lpad((y % 100)::VARCHAR, 2, '0') AS symbol, r, c, c[(o_orderkey % length(c) + 1)::INT] AS code, y FROM (
    SELECT o_orderkey, year(o_orderdate) AS y, {[r[0] for r in dims.ROOTS]!r}[o_custkey % {len(dims.ROOTS)} + 1] AS r, {[r[4] for r in dims.ROOTS]!r}[o_custkey % {len(dims.ROOTS)} + 1] AS c FROM orders)"""


def p2(spark, sf):
    s = F.col("symbol")
    return present(_symbols(spark, sf).select("symbol", sym.contract_root(s).alias("root"), sym.contract_code(s).alias("code"),
                                              sym.contract_month(s).alias("month"), sym.contract_year(s).alias("year")))


def p3(spark, sf):
    from ..operators.calendar import next_contract

    return present(next_contract(_symbols(spark, sf), "symbol"))


def p8(spark, sf):
    s = _symbols(spark, sf).withColumn("root", sym.contract_root(F.col("symbol")))
    return present(dims.with_root_facts(s, "multiplier", "margin", "tick", "cycle"))


QUERIES = {
    "J4_T5_splice": j4, "J5_roll_events": j5, "J6_carry_inputs": j6, "J7_active_contract": j7, "J12_roll_decisions": j12,
    "W1_roll_flags": w1, "W2_roll_clean_returns": w2, "W3_ratio_adjusted": w3, "W12_roll_bookings": w12, "U3_date_axis": u3,
    "W7_trade_ledger": w7, "W8_average_cost": w8, "W10_loss_limits": w10, "W10_session_limits": w10_sessions, "W11_equity_curve": w11, "W13_stop_loss": w13,
    "W14_target_deltas": w14, "J8_order_fills": j8, "J13_mark_price": j13, "P2_contract_parse": p2, "P3_next_contract": p3,
    "P7_slippage_dated": p7_dated, "X1_capped_sizing_dated": x1_dated, "P7_slippage": p7, "P8_root_constants": p8, "P16_order_downgrade": p16, "X1_capped_sizing": x1, "X2_fixed_sizing": x2,
    "X3_weighted_sizing": x3, "A20_inverse_vol_weights": a20,
}

ORACLES = {
    "J4_T5_splice": tsql("SELECT root, contract, d::VARCHAR AS d, close::DOUBLE AS close, volume FROM v_spliced"),
    "J5_roll_events": tsql("""SELECT root, roll_date::VARCHAR AS roll_date, old_contract, new_contract, front_settle::DOUBLE AS front_settle,
        back_settle::DOUBLE AS back_settle, (back_settle - front_settle)::DOUBLE AS roll_gap FROM v_events"""),
    "J6_carry_inputs": tsql("""WITH f AS (SELECT s.root, s.d, s.contract AS front, r.back, s.close AS front_close, r.ltd AS fl FROM v_spliced s JOIN v_roll r ON r.contract = s.contract),
        x AS (SELECT f.*, b.ltd AS bl, (SELECT arg_max(c.close, c.d) FROM v_contract_bars c WHERE c.contract = f.back AND c.d <= f.d) AS back_close FROM f JOIN v_roll b ON b.contract = f.back)
        SELECT root, d::VARCHAR AS d, front, back, front_close::DOUBLE AS front_close, back_close::DOUBLE AS back_close, (fl - d)::BIGINT AS days_front, (bl - d)::BIGINT AS days_back
        FROM x WHERE back_close > 0 AND front_close > 0 AND fl - d > 0 AND fl - d < bl - d"""),
    "J7_active_contract": tsql("""WITH p AS (SELECT DISTINCT root, unnest([last_day(d), CAST(date_trunc('month', d) AS DATE) + 14]) AS d FROM v_spliced)
        SELECT root, p.d::VARCHAR AS d, (SELECT arg_max(contract, s.d) FROM v_spliced s WHERE s.root = p.root AND s.d <= p.d) AS contract FROM p"""),
    "J12_roll_decisions": tsql("""WITH p AS (SELECT contract, d AS today, ((volume * 7 + day(d)) % 5 - 2)::BIGINT AS qty FROM v_contract_bars),
        j AS (SELECT p.*, r.back, r.roll_target, r.roll_deadline, substr(p.contract, -3, 1) = 'H' AS dv FROM p JOIN v_roll r ON r.contract = p.contract WHERE qty <> 0)
        SELECT contract, back, today::VARCHAR AS today, qty, CASE WHEN today > roll_deadline THEN 'SEQUENTIAL_EMERGENCY' WHEN dv THEN 'SEQUENTIAL' ELSE 'CALENDAR_SPREAD' END AS method,
          CASE WHEN today > roll_deadline THEN 'past deadline' WHEN dv THEN 'divergence' ELSE 'on schedule' END AS reason, roll_deadline::VARCHAR AS roll_deadline FROM j WHERE today >= roll_target"""),
    "W1_roll_flags": tsql("SELECT root, d::VARCHAR AS d, contract, coalesce(prev_contract <> contract, false) AS roll_flag FROM v_flags"),
    "W2_roll_clean_returns": tsql("""WITH l AS (SELECT *, lag(contract) OVER w AS pc, lag(close) OVER w AS p FROM v_spliced WINDOW w AS (PARTITION BY root ORDER BY d))
        SELECT root, d::VARCHAR AS d, contract, CASE WHEN pc = contract AND p <> 0 THEN round(close::DOUBLE / p::DOUBLE - 1, 6) END AS clean_return FROM l"""),
    "W3_ratio_adjusted": tsql("""WITH f AS (SELECT old_contract, exp(sum(ln(back_settle::DOUBLE / front_settle::DOUBLE)) OVER (PARTITION BY root ORDER BY roll_date DESC)) AS f FROM v_events)
        SELECT root, d::VARCHAR AS d, contract, round(close::DOUBLE * coalesce(f, 1), 6) AS adjusted_close FROM v_spliced LEFT JOIN f ON old_contract = contract"""),
    "W12_roll_bookings": tsql(f"""WITH e AS (SELECT n.account, v_events.*, (SELECT arg_max(net, x.d) FROM v_net x WHERE x.account = n.account AND x.root = v_events.root AND x.d < roll_date) AS qty
          FROM v_events JOIN (SELECT DISTINCT account, root FROM v_net) n ON n.root = v_events.root)
        SELECT account, e.root, roll_date::VARCHAR AS roll_date, old_contract, new_contract, qty, front_settle::DOUBLE AS front_settle, back_settle::DOUBLE AS back_settle,
          -qty AS front_leg_qty, qty AS back_leg_qty, (back_settle - front_settle)::DOUBLE * qty * multiplier::DOUBLE AS roll_cost FROM e JOIN {_DIM_SQL} ON dim.root = e.root WHERE qty <> 0"""),
    "U3_date_axis": tsql("SELECT d::VARCHAR AS d, count(DISTINCT contract) AS contracts FROM v_contract_bars GROUP BY v_contract_bars.d"),
    "W7_trade_ledger": tsql(_W7 + """SELECT account, root, bet::BIGINT AS trade_no, round(sum(-q * price * multiplier)::DOUBLE, 2) AS pnl, min(d)::VARCHAR AS opened, max(d)::VARCHAR AS closed,
        sum(abs(q))::BIGINT AS volume FROM p WHERE q <> 0 GROUP BY account, root, bet HAVING max(ends) = 1"""),
    "W8_average_cost": W8_SQL,
    "W10_loss_limits": W10_SQL, "W10_session_limits": W10_SESSIONS_SQL,
    "W11_equity_curve": W11_SQL,
    "W13_stop_loss": W13_SQL,
    "W14_target_deltas": tsql("""WITH t AS (SELECT strategy_id, d, (direction * (1 + day(d) % 3))::BIGINT AS target FROM v_signals),
        l AS (SELECT *, target - coalesce(lag(target) OVER (PARTITION BY strategy_id ORDER BY d), 0) AS delta FROM t)
        SELECT strategy_id, d::VARCHAR AS d, target, delta, CASE WHEN delta > 0 THEN 'buy' ELSE 'sell' END AS side FROM l WHERE delta <> 0"""),
    "J8_order_fills": tsql(_J8 + " SELECT order_id, contract, order_type, side, strftime(filled_at, '%Y-%m-%d %H:%M:%S') AS filled_at, fill_price::DOUBLE AS fill_price FROM f"),
    "J13_mark_price": tsql("""WITH p AS (SELECT DISTINCT root, CAST(last_day(d) + 3 AS DATE) AS d FROM v_fills)
        SELECT p.root, p.d::VARCHAR AS d, b.d::VARCHAR AS marked_on, b.px::DOUBLE AS mark FROM p ASOF JOIN v_base b ON b.root = p.root AND p.d >= b.d"""),
    "P2_contract_parse": f"""WITH s AS ({_SYM_SQL}) SELECT DISTINCT symbol, r AS root, code, instr('FGHJKMNQUVXZ', code)::BIGINT AS month, y AS year FROM s""",
    "P3_next_contract": f"""WITH s AS ({_SYM_SQL}) SELECT DISTINCT symbol, r || CASE WHEN instr(c, code) < length(c) THEN c[instr(c, code) + 1] ELSE c[1] END
        || lpad(((y + CASE WHEN instr(c, code) < length(c) THEN 0 ELSE 1 END) % 100)::VARCHAR, 2, '0') AS next_symbol FROM s""",
    "P7_slippage": P7_SQL,
    "P7_slippage_dated": P7_DATED_SQL,
    "X1_capped_sizing_dated": X1_DATED_SQL,
    "P8_root_constants": f"""WITH s AS ({_SYM_SQL}) SELECT DISTINCT symbol, r AS root, multiplier::DOUBLE AS multiplier, margin::DOUBLE AS margin, round(tick::DOUBLE, 6) AS tick, cycle FROM s JOIN {_DIM_SQL} ON dim.root = r""",
    "P16_order_downgrade": P16_SQL,
    "X1_capped_sizing": X1_SQL,
    "X2_fixed_sizing": X2_SQL,
    "X3_weighted_sizing": X3_SQL,
    "A20_inverse_vol_weights": tsql(_A20 + " SELECT portfolio, strategy_id, round(raw / avg(raw) OVER (PARTITION BY portfolio), 6) AS weight FROM w"),
}
