"""Market-data views derived from the given tables, in Spark and as SQL text.

Every view exists twice: a function of (spark, sf_dir) and a SQL body of the same name in ``SQL``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import PRICE, iso_utc
from ..session import cut_lineage

# Source, tier, how far its calendar is shifted (decides gaps and deviations).
SOURCES = [("src_a", 2, 0), ("src_b", 3, 1), ("src_c", 4, 2), ("src_d", 6, 3)]


_KEPT: dict[tuple, DataFrame] = {}


def view(stored: bool):
    """Build a view once per application and folder.

    A stored view is written to the shared work folder first: several queries and several branches
    of one query then read a table instead of deriving it again.
    """

    def wrap(fn):
        def get(spark: SparkSession, sf_dir: str) -> DataFrame:
            key = (spark.sparkContext.applicationId, sf_dir, fn.__name__)
            if key not in _KEPT:
                df = fn(spark, sf_dir)
                _KEPT[key] = cut_lineage(df, fn.__name__) if stored else df
            return _KEPT[key]

        get.__name__, get.__doc__ = fn.__name__, fn.__doc__
        return get

    return wrap


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(
        *[F.col(f).cast("timestamp").alias(f) if t == "timestamp_ntz" else F.col(f) for f, t in df.dtypes]
    )


def _sources() -> F.Column:
    return F.explode(
        F.array(
            *[
                F.struct(F.lit(s).alias("source_id"), F.lit(t).alias("tier"), F.lit(k).alias("k"))
                for s, t, k in SOURCES
            ]
        )
    )


_SOURCES_SQL = "(VALUES " + ", ".join(f"('{s}', {t}, {k})" for s, t, k in SOURCES) + ") src(source_id, tier, k)"

_EVENT_CONTRACT = {"error": "ESH24", "click": "CLH24", "view": "GCJ24", "signup": "ZNH24"}


def _event_contract() -> F.Column:
    c = F.lit("NQH24")
    for event, contract in _EVENT_CONTRACT.items():
        c = F.when(F.col("event_type") == event, contract).otherwise(c)
    return c


_EVENT_CONTRACT_SQL = (
    "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{c}'" for e, c in _EVENT_CONTRACT.items()) + " ELSE 'NQH24' END"
)


@view(stored=False)
def v_ticks(spark, sf):
    return load(spark, sf, "events").select(
        _event_contract().alias("contract"), "ts", "event_id", "user_id",
        (F.lit(100) + F.round("value", 2)).cast(PRICE).alias("px"),
    )


def bars_of(ticks: DataFrame, unit: str = "hour") -> DataFrame:
    order = F.struct("ts", "event_id")
    return (
        ticks.withColumn("bar_ts", F.date_trunc(unit, "ts"))
        .groupBy("contract", "bar_ts")
        .agg(
            F.min_by("px", order).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
            F.max_by("px", order).alias("close"), F.count(F.lit(1)).alias("volume"),
        )
        .withColumnRenamed("bar_ts", "ts")
    )


@view(stored=True)
def v_bars(spark, sf):
    return bars_of(v_ticks(spark, sf))


@view(stored=True)
def v_quotes(spark, sf):
    hr = (F.unix_timestamp("ts") / 3600).cast("long")
    q = v_bars(spark, sf).select("*", _sources().alias("s")).select("*", "s.*").drop("s")
    q = q.withColumn("hr", hr).filter((F.col("hr") + 5 * F.col("k")) % 7 != 0)
    close = (
        F.when((F.col("hr") + 3 * F.col("k")) % 13 == 0, (F.col("close") * F.lit("1.2").cast("decimal(4,2)")).cast(PRICE))
        .when((F.col("hr") + F.col("k")) % 11 == 0, (F.col("close") * F.lit("1.02").cast("decimal(4,2)")).cast(PRICE))
        .otherwise(F.col("close"))
    )
    q = q.withColumn("close", close).withColumn("high", F.greatest("high", "close")).withColumn("resolution", F.lit("1h"))
    q = q.withColumn("as_of", F.timestamp_seconds(F.unix_timestamp("ts") + 3600 + 60 * F.col("k")))
    sha = F.sha2(F.concat_ws("|", "source_id", "contract", iso_utc(F.col("ts")), F.col("close").cast("string")), 256)
    return q.withColumn("sha", sha).select(
        "contract", "ts", "resolution", "open", "high", "low", "close", "volume", "source_id", "tier", "as_of", "sha"
    )


_ROOT = "CASE l_suppkey % 4 WHEN 0 THEN 'ES' WHEN 1 THEN 'CL' WHEN 2 THEN 'GC' ELSE 'ZN' END"


@view(stored=True)
def v_base(spark, sf):
    return (
        load(spark, sf, "lineitem")
        .select(F.expr(_ROOT).alias("root"), F.to_date("l_shipdate").alias("d"),
                (F.col("l_extendedprice") / F.col("l_quantity")).cast("decimal(18,6)").alias("p"))
        .groupBy("root", "d")
        .agg((F.floor(F.sum("p").cast("double") * 100 / F.count(F.lit(1))) / 100).cast(PRICE).alias("px"),
             F.count(F.lit(1)).alias("n"))
    )


@view(stored=True)
def v_roll(spark, sf):
    """A quarterly chain per root over the years of the bars and the next: third-Friday expiry, roll target a week before."""
    span = v_base(spark, sf).agg(F.min(F.year("d")).alias("lo"), F.max(F.year("d")).alias("hi"))
    dim = spark.sql(
        """
        SELECT root, code, y, date_add(first, (4 - weekday(first) + 7) % 7 + 14) AS ltd FROM (
          SELECT root, y, code, make_date(y, m, 1) AS first FROM (
            SELECT root, y, inline(array(named_struct('code', 'H', 'm', 3), named_struct('code', 'M', 'm', 6), named_struct('code', 'U', 'm', 9), named_struct('code', 'Z', 'm', 12)))
            FROM (SELECT explode(sequence(lo, hi + 1)) AS y, root
                  FROM {span}, (SELECT root FROM VALUES ('ES'), ('CL'), ('GC'), ('ZN') AS r(root)))))
        """,
        span=span,
    )
    from pyspark.sql import Window

    w = Window.partitionBy("root").orderBy("ltd")
    contract = F.concat("root", "code", F.lpad((F.col("y") % 100).cast("string"), 2, "0"))
    return dim.withColumn("contract", contract).select(
        "root", "contract", F.lead("contract").over(w).alias("back"), "ltd",
        F.date_sub("ltd", 7).alias("roll_target"), F.date_sub("ltd", 3).alias("roll_deadline"),
    )


@view(stored=True)
def v_contract_bars(spark, sf):
    b, r = v_base(spark, sf), v_roll(spark, sf)
    months = (F.year("ltd") - F.year("d")) * 12 + F.month("ltd") - F.month("d")
    close = (F.col("px") + F.lit("0.25").cast("decimal(4,2)") * months).cast(PRICE)
    half = F.lit("0.5").cast("decimal(4,2)")
    return (
        b.join(F.broadcast(r), "root")
        .filter((F.col("d") <= F.col("ltd")) & (F.col("d") > F.date_sub("ltd", 200)))
        .select(
            "root", "contract", "d", F.col("px").alias("open"),
            (F.greatest(F.col("px"), close) + half).cast(PRICE).alias("high"),
            (F.least(F.col("px"), close) - half).cast(PRICE).alias("low"),
            close.alias("close"), F.col("n").alias("volume"),
        )
    )


@view(stored=True)
def v_settles(spark, sf):
    s = v_contract_bars(spark, sf).select("*", _sources().alias("s")).select("*", "s.*").drop("s")
    day = F.datediff("d", F.lit("1970-01-01").cast("date"))
    s = s.withColumn("n", day).filter((F.col("n") + 5 * F.col("k")) % 7 != 0)
    settle = (
        F.when((F.col("n") + 3 * F.col("k")) % 13 == 0, (F.col("close") * F.lit("1.2").cast("decimal(4,2)")).cast(PRICE))
        .when((F.col("n") + F.col("k")) % 11 == 0, (F.col("close") * F.lit("1.02").cast("decimal(4,2)")).cast(PRICE))
        .otherwise(F.col("close"))
    )
    state = F.when(F.col("k") == 3, "live").when(F.col("k") == 2, "preliminary").otherwise("final")
    return s.withColumn("settle", settle).withColumn("settle_state", state).select(
        "root", "contract", F.col("d").alias("as_of_date"), "settle", "settle_state", "open",
        F.greatest("high", "settle").alias("high"), "low", F.col("close").alias("last"),
        F.col("volume").alias("volume_est"), "source_id", "tier",
        F.timestamp_seconds(F.unix_timestamp(F.col("d").cast("timestamp")) + 79200 + 60 * F.col("k")).alias("as_of"),
        F.sha2(F.concat_ws("|", "source_id", "contract", F.col("d").cast("string"), F.col("settle").cast("string")), 256).alias("sha"),
    )


@view(stored=True)
def v_ret(spark, sf):
    return (
        load(spark, sf, "lineitem")
        .groupBy((F.col("l_suppkey") % 20).alias("strategy_id"), F.to_date("l_shipdate").alias("d"))
        .agg((F.sum(F.col("l_discount").cast("decimal(10,4)")).cast("double") / F.count(F.lit(1)) - F.lit(0.05)).alias("r"))
    )


@view(stored=True)
def v_ret_m(spark, sf):
    return (
        v_ret(spark, sf)
        .groupBy("strategy_id", F.trunc("d", "month").alias("m"))
        .agg((F.sum(F.col("r").cast("decimal(18,10)")).cast("double") / F.count(F.lit(1))).alias("r"))
    )


@view(stored=True)
def v_panel(spark, sf):
    """The dense monthly matrix: position ``i`` counts months from the first one; idle months return 0."""
    m = v_ret_m(spark, sf)
    span = m.agg(F.min("m").alias("m0"), F.max("m").alias("m1")).withColumn("one", F.lit(1))
    months = F.explode(F.expr("sequence(m0, m1, interval 1 month)")).alias("m")
    grid = m.select("strategy_id", F.lit(1).alias("one")).distinct().join(F.broadcast(span), "one").select("strategy_id", "m0", months)
    i = (F.year("m") - F.year("m0")) * 12 + F.month("m") - F.month("m0")
    return grid.join(m, ["strategy_id", "m"], "left").select("strategy_id", i.cast("long").alias("i"), F.coalesce("r", F.lit(0.0)).alias("r"))


@view(stored=True)
def v_equity(spark, sf):
    """Curves of 100,000 plus 10,000 per unit of summed return; strategy 20 copies strategy 0 and is ruined once."""
    from ..operators.ordered import segmented

    r = v_ret(spark, sf)
    run = segmented(r, ["strategy_id"], ["d"], F.year("d"),
                    {"c": ("sum", F.col("r").cast("decimal(18,10)")), "rn": ("row_number", None)})
    e = run.select("strategy_id", "d", (F.lit(100000.0) + F.lit(10000.0) * F.col("c").cast("double")).alias("equity"), "rn")
    ruin = e.filter("strategy_id = 0").select(
        F.lit(20).cast("long").alias("strategy_id"), "d",
        F.when(F.col("rn") == 500, F.col("equity") - 200000.0).otherwise(F.col("equity")).alias("equity"), "rn")
    return e.unionByName(ruin).select("strategy_id", "d", "equity")


_FILL_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


@view(stored=True)
def v_fills(spark, sf):
    """One fill per line; ``fill_key`` is a total order within an account and root."""
    li = load(spark, sf, "lineitem")
    return li.select(
        (F.col("l_suppkey") % 10).alias("account"), F.expr(_ROOT).alias("root"),
        F.to_date("l_shipdate").alias("d"),
        (F.when(F.col("l_orderkey") % 2 == 0, 1).otherwise(-1) * (1 + F.col("l_linenumber") % 3)).cast("long").alias("qty"),
        (F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")) / 100).cast(PRICE).alias("price"),
        F.struct(*_FILL_ORDER).alias("fill_key"),
    )


@view(stored=True)
def v_orders(spark, sf):
    t = v_ticks(spark, sf)
    kind = F.when(F.col("event_id") % 3 == 0, "MKT").when(F.col("event_id") % 3 == 1, "LMT").otherwise("STP")
    buy = (F.col("event_id") / 20).cast("long") % 2 == 0
    five = F.lit("5").cast("decimal(4,2)")
    price = F.when((kind == "LMT") == buy, F.col("px") - five).otherwise(F.col("px") + five).cast(PRICE)
    return t.select(
        F.col("event_id").alias("order_id"), "contract", "ts", kind.alias("order_type"),
        F.when(buy, "buy").otherwise("sell").alias("side"), (F.col("user_id") % 5 + 1).alias("quantity"),
        F.when(kind == "LMT", price).alias("limit_price"), F.when(kind == "STP", price).alias("stop_price"),
    )


@view(stored=True)
def v_cot(spark, sf):
    o = load(spark, sf, "orders").select(
        (F.col("o_custkey") % 6).alias("code"),
        F.date_add(F.date_trunc("week", "o_orderdate").cast("date"), 1).alias("report_date"), "o_orderpriority")
    side = F.substring("o_orderpriority", 1, 1)
    return o.groupBy("code", "report_date").agg(
        F.count(F.lit(1)).alias("open_interest"),
        *[F.count_if(side == str(i)).alias(n) for i, n in enumerate(["spec_long", "spec_short", "comm_long", "comm_short"], 1)],
    ).withColumn("code", F.concat(F.lit("M"), F.col("code").cast("string")))


@view(stored=True)
def v_macro(spark, sf):
    lag = F.when(F.col("o_orderstatus") == "F", 30).when(F.col("o_orderstatus") == "O", 60).otherwise(90)
    return (
        load(spark, sf, "orders")
        .groupBy(F.substring("o_orderpriority", 1, 1).alias("series"), F.trunc("o_orderdate", "month").alias("ref_date"), lag.alias("lag"))
        .agg((F.floor(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") * 100 / F.count(F.lit(1))) / 100).alias("value"))
        .select("series", "ref_date", F.expr("date_add(last_day(ref_date), lag)").alias("known_at"), "value")
    )


SQL: dict[str, str] = {
    "v_ticks": f"""SELECT {_EVENT_CONTRACT_SQL} AS contract, ts, event_id, user_id,
        CAST(100 + round(value, 2) AS DECIMAL(20,8)) AS px FROM events""",
    "v_bars": """SELECT contract, date_trunc('hour', ts) AS ts, arg_min(px, (ts, event_id)) AS open, max(px) AS high,
        min(px) AS low, arg_max(px, (ts, event_id)) AS close, count(*) AS volume
        FROM v_ticks GROUP BY contract, date_trunc('hour', ts)""",
    "v_quotes": f"""SELECT contract, ts, '1h' AS resolution, open, greatest(high, close) AS high, low, close, volume, source_id, tier,
        as_of, sha256(concat_ws('|', source_id, contract, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00', close::VARCHAR)) AS sha
        FROM (SELECT contract, ts, open, high, low, volume, source_id, tier, ts + INTERVAL 1 HOUR + to_minutes(k) AS as_of,
          CAST(CASE WHEN (hr + 3*k) % 13 = 0 THEN close * 1.2 WHEN (hr + k) % 11 = 0 THEN close * 1.02 ELSE close END AS DECIMAL(20,8)) AS close
          FROM (SELECT *, CAST(epoch(ts) AS BIGINT) // 3600 AS hr FROM v_bars), {_SOURCES_SQL}
          WHERE (hr + 5*k) % 7 <> 0)""",
    "v_base": f"""SELECT {_ROOT} AS root, CAST(l_shipdate AS DATE) AS d,
        CAST(floor(CAST(sum(CAST(l_extendedprice / l_quantity AS DECIMAL(18,6))) AS DOUBLE) * 100 / count(*)) / 100 AS DECIMAL(20,8)) AS px,
        count(*) AS n FROM lineitem GROUP BY 1, 2""",
    "v_roll": """SELECT root, contract, lead(contract) OVER (PARTITION BY root ORDER BY ltd) AS back, ltd,
        CAST(ltd - 7 AS DATE) AS roll_target, CAST(ltd - 3 AS DATE) AS roll_deadline FROM (
        SELECT root, root || code || lpad((y % 100)::VARCHAR, 2, '0') AS contract,
          CAST(make_date(y, m, 1) + CAST((5 - isodow(make_date(y, m, 1)) + 7) % 7 + 14 AS INTEGER) AS DATE) AS ltd
        FROM (VALUES ('ES'), ('CL'), ('GC'), ('ZN')) r(root), (SELECT unnest(range((SELECT min(year(d)) FROM v_base), (SELECT max(year(d)) FROM v_base) + 2)) AS y),
          (VALUES ('H', 3), ('M', 6), ('U', 9), ('Z', 12)) c(code, m))""",
    "v_contract_bars": """SELECT root, contract, d, px AS open, CAST(greatest(px, close) + 0.5 AS DECIMAL(20,8)) AS high,
        CAST(least(px, close) - 0.5 AS DECIMAL(20,8)) AS low, close, n AS volume FROM (
        SELECT b.root, r.contract, b.d, b.px, b.n,
          CAST(px + 0.25 * ((year(ltd) - year(d)) * 12 + month(ltd) - month(d)) AS DECIMAL(20,8)) AS close
        FROM v_base b JOIN v_roll r ON b.root = r.root AND d <= ltd AND d > ltd - 200)""",
    "v_settles": f"""SELECT root, contract, d AS as_of_date, settle, settle_state, open, greatest(high, settle) AS high, low,
        close AS last, volume AS volume_est, source_id, tier, CAST(d AS TIMESTAMP) + INTERVAL 22 HOUR + to_minutes(k) AS as_of,
        sha256(concat_ws('|', source_id, contract, d::VARCHAR, settle::VARCHAR)) AS sha
        FROM (SELECT *, CAST(CASE WHEN (n + 3*k) % 13 = 0 THEN close * 1.2 WHEN (n + k) % 11 = 0 THEN close * 1.02 ELSE close END AS DECIMAL(20,8)) AS settle,
          CASE k WHEN 3 THEN 'live' WHEN 2 THEN 'preliminary' ELSE 'final' END AS settle_state
          FROM (SELECT *, date_diff('day', DATE '1970-01-01', d) AS n FROM v_contract_bars), {_SOURCES_SQL}
          WHERE (n + 5*k) % 7 <> 0)""",
    "v_ret": """SELECT l_suppkey % 20 AS strategy_id, CAST(l_shipdate AS DATE) AS d,
        CAST(sum(CAST(l_discount AS DECIMAL(10,4))) AS DOUBLE) / count(*) - 0.05e0 AS r FROM lineitem GROUP BY 1, 2""",
    "v_ret_m": """SELECT strategy_id, CAST(date_trunc('month', d) AS DATE) AS m,
        CAST(sum(CAST(r AS DECIMAL(18,10))) AS DOUBLE) / count(*) AS r FROM v_ret GROUP BY 1, 2""",
    "v_panel": """SELECT g.strategy_id, g.i, coalesce(r, 0e0) AS r FROM (
        SELECT strategy_id, unnest(range(0, (SELECT date_diff('month', min(m), max(m)) FROM v_ret_m) + 1)) AS i FROM (SELECT DISTINCT strategy_id FROM v_ret_m)) g
        LEFT JOIN (SELECT strategy_id, date_diff('month', (SELECT min(m) FROM v_ret_m), m) AS i, r FROM v_ret_m) x ON x.strategy_id = g.strategy_id AND x.i = g.i""",
    "v_equity": """WITH e AS (SELECT strategy_id, d, 100000e0 + 10000e0 * CAST(sum(CAST(r AS DECIMAL(18,10))) OVER w AS DOUBLE) AS equity,
          row_number() OVER w AS rn FROM v_ret WINDOW w AS (PARTITION BY strategy_id ORDER BY d))
        SELECT strategy_id, d, equity FROM e UNION ALL
        SELECT 20, d, CASE WHEN rn = 500 THEN equity - 200000e0 ELSE equity END FROM e WHERE strategy_id = 0""",
    "v_fills": f"""SELECT l_suppkey % 10 AS account, {_ROOT} AS root, CAST(l_shipdate AS DATE) AS d,
        CAST((CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE -1 END) * (1 + l_linenumber % 3) AS BIGINT) AS qty,
        CAST(floor(l_extendedprice * 100 / l_quantity) / 100 AS DECIMAL(20,8)) AS price,
        row_number() OVER (ORDER BY {", ".join(_FILL_ORDER)}) AS seq FROM lineitem""",
    "v_orders": """SELECT event_id AS order_id, contract, ts, order_type, CASE WHEN buy THEN 'buy' ELSE 'sell' END AS side,
        user_id % 5 + 1 AS quantity,
        CASE WHEN order_type = 'LMT' THEN CAST(CASE WHEN buy THEN px - 5 ELSE px + 5 END AS DECIMAL(20,8)) END AS limit_price,
        CASE WHEN order_type = 'STP' THEN CAST(CASE WHEN buy THEN px + 5 ELSE px - 5 END AS DECIMAL(20,8)) END AS stop_price
        FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN 'MKT' WHEN 1 THEN 'LMT' ELSE 'STP' END AS order_type,
          (event_id // 20) % 2 = 0 AS buy FROM v_ticks)""",
    "v_cot": """SELECT 'M' || (o_custkey % 6)::VARCHAR AS code, CAST(date_trunc('week', o_orderdate) AS DATE) + 1 AS report_date,
        count(*) AS open_interest, count(*) FILTER (o_orderpriority[1] = '1') AS spec_long,
        count(*) FILTER (o_orderpriority[1] = '2') AS spec_short, count(*) FILTER (o_orderpriority[1] = '3') AS comm_long,
        count(*) FILTER (o_orderpriority[1] = '4') AS comm_short FROM orders GROUP BY 1, 2""",
    "v_macro": """SELECT series, ref_date, CAST(last_day(ref_date) + CAST(lag AS INTEGER) AS DATE) AS known_at, value FROM (
        SELECT o_orderpriority[1] AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS ref_date,
          CASE o_orderstatus WHEN 'F' THEN 30 WHEN 'O' THEN 60 ELSE 90 END AS lag,
          floor(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) * 100 / count(*)) / 100 AS value FROM orders GROUP BY 1, 2, 3)""",
}


def sql(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the views it mentions, in dependency order."""
    import re

    known = {**SQL, **(extra or {})}
    order: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if re.search(rf"\b{name}\b", text) and name not in order:
                visit(known[name])
                if name not in order:
                    order.append(name)

    visit(body)
    ctes = ",\n".join(f"{n} AS ({known[n]})" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}" if ctes else body
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}" if ctes else body
    return f"WITH {ctes}\n{body}" if ctes else body


def present(df: DataFrame) -> DataFrame:
    """Engine-neutral output: text for dates, times and arrays, doubles to 6 places, 64-bit integers."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind == "date":
            c = c.cast("string")
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind.startswith("decimal") or kind in ("double", "float"):
            c = F.round(c.cast("double"), 6)
            c = F.when(c == 0, F.lit(0.0)).otherwise(c)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        elif kind.startswith("array"):
            c = F.array_join(c.cast("array<string>"), ",", "")
        cols.append(c.alias(name))
    return df.select(*cols)
