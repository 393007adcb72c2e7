"""Registered queries: consensus, fixing and point-in-time reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..operators import consensus, fixing, pit
from .views import load, present, sql, v_cot, v_macro, v_quotes, v_settles, v_ticks, view

EXACT3 = dims.Policy("umbrella_exact", "fail_closed", 3, "NORMAL")
WIDE3 = dims.widen(EXACT3)
SETTLE = dims.policy_for("default", "settle")
OHLC = dims.policy_for("default", "ohlc")


def _sig_sql(p: dims.Policy) -> str:
    text = (
        f'{{"kind": "{p.kind}", "min_quorum": {p.min_quorum}, "policy_id": "{p.policy_id}", '
        f'"require_tier_t2_or_better": true, "tolerance_band": "{p.band}"}}'
    )
    return f"sha256('{text}')"


def _settle_sql(p: dims.Policy, source: str = "v_settles", extra: dict[str, str] | None = None) -> str:
    prov = "sha256(source_id || '||' || strftime(as_of, '%Y-%m-%dT%H:%M:%S') || '+00:00' || '||' || sha)"
    if p.band == "WIDE":
        agreed = "CASE WHEN mid = 0 THEN lo = 0 AND hi = 0 ELSE greatest(abs(hi - mid), abs(lo - mid)) <= abs(mid) * 0.05 END"
        value = "mid"
    else:
        agreed, value = "lo = hi", "first_v"
    return sql(
        f"""
        WITH g AS (SELECT contract, as_of_date, count(*) AS n, min(settle) AS lo, max(settle) AS hi,
            arg_min(settle, source_id) AS first_v, list_sort(list(settle))[count(*) // 2 + 1] AS mid, min(tier) AS tier,
            max(CASE settle_state WHEN 'final' THEN 2 WHEN 'preliminary' THEN 1 ELSE 0 END) AS rk,
            string_agg(source_id, ',' ORDER BY source_id) AS sources, list_sort(list({prov})) AS prov
          FROM {source} WHERE tier <= 4 GROUP BY 1, 2),
        o AS (SELECT *, CASE WHEN n < {p.min_quorum} THEN 'incomplete' WHEN {agreed} THEN 'verified' ELSE 'disagreement' END AS outcome FROM g)
        SELECT contract, as_of_date::VARCHAR AS as_of_date, outcome,
          CASE WHEN outcome = 'verified' THEN CAST({value} AS DOUBLE) END AS settle,
          CASE WHEN outcome = 'verified' THEN ['live', 'preliminary', 'final'][rk + 1] END AS settle_state,
          n AS n_sources, CASE WHEN outcome = 'verified' THEN tier::BIGINT END AS tier, sources,
          CASE WHEN outcome = 'verified' THEN sha256('{p.policy_id}' || '||' || array_to_string(prov, '||') || '||' || {_sig_sql(p)} || '||'
            || contract || '||' || as_of_date::VARCHAR || '||settle') END AS run_hash FROM o
        """,
        extra,
    )


def _settles_out(df):
    return present(df.select("contract", "as_of_date", "outcome", "settle", "settle_state", "n_sources", "tier", "sources", "run_hash"))


def a1_exact(spark, sf):
    return _settles_out(consensus.settle_consensus(v_settles(spark, sf), SETTLE))


def a1_wide(spark, sf):
    return _settles_out(consensus.settle_consensus(v_settles(spark, sf), WIDE3))


def _bars_out(df):
    return present(df.select("contract", "ts", "outcome", "open", "high", "low", "close", "volume", "n_sources", "tier", "sources", "run_hash"))


def a2_exact(spark, sf):
    return _bars_out(consensus.bar_consensus(v_quotes(spark, sf), OHLC))


def a2_wide(spark, sf):
    return _bars_out(consensus.bar_consensus(v_quotes(spark, sf), WIDE3))


def _bars_sql(p: dims.Policy) -> str:
    prov = "sha256(source_id || '||' || strftime(as_of, '%Y-%m-%dT%H:%M:%S') || '+00:00' || '||' || sha)"
    agreed = (
        "CASE WHEN mid = 0 THEN lo = 0 AND hi = 0 ELSE greatest(abs(hi - mid), abs(lo - mid)) <= abs(mid) * 0.05 END"
        if p.band == "WIDE" else "nb = 1"
    )
    ok = "CASE WHEN outcome = 'verified' THEN"
    return f"""
        WITH g AS (SELECT contract, ts, count(*) AS n, min(close) AS lo, max(close) AS hi,
            list_sort(list(close))[count(*) // 2 + 1] AS mid, min(tier) AS tier,
            count(DISTINCT (open, high, low, close, volume)) AS nb,
            arg_min({{'o': open, 'h': high, 'l': low, 'c': close, 'v': volume}}, source_id) AS b,
            string_agg(source_id, ',' ORDER BY source_id) AS sources, list_sort(list({prov})) AS prov
          FROM v_quotes WHERE tier <= 4 GROUP BY 1, 2),
        o AS (SELECT *, CASE WHEN n < {p.min_quorum} THEN 'incomplete' WHEN {agreed} THEN 'verified' ELSE 'disagreement' END AS outcome FROM g),
        done AS (SELECT contract, ts, outcome, {ok} b.o::DOUBLE END AS open, {ok} b.h::DOUBLE END AS high, {ok} b.l::DOUBLE END AS low,
          {ok} b.c::DOUBLE END AS close, {ok} b.v END AS volume, n AS n_sources, {ok} tier::BIGINT END AS tier, sources,
          {ok} sha256('{p.policy_id}' || '||' || array_to_string(prov, '||') || '||' || {_sig_sql(p)} || '||'
            || contract || '||' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00||1h') END AS run_hash FROM o)
    """


_BARS_SELECT = """SELECT contract, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, outcome, open, high, low, close, volume,
    n_sources, tier, sources, run_hash FROM done"""


def a3(spark, sf):
    """Policies per quote field over the fields quoted by each source (requests derive from the data)."""
    req = v_quotes(spark, sf).select("source_id").distinct().select(
        "source_id",
        F.explode(F.array(*[F.lit(p) for p in dims.POLICY_SETS])).alias("policy_set"),
    ).select("*", F.explode(F.array(*[F.lit(f) for f in ("settle", "ohlc", "volume", "oi", "tick", "close")])).alias("field"))
    return present(consensus.resolve_policies(req).drop("trusted_only"))


_POLICY_ROWS = ", ".join(
    f"('{s}', {'NULL' if f is None else chr(39) + f + chr(39)}, '{p.policy_id}', '{p.kind}', {p.min_quorum}, '{p.band}', {p.timeout_seconds})"
    for s, fs in dims.POLICY_SETS.items() for f, p in fs.items()
)
A3_SQL = sql(
    f"""WITH pol(ps, f, policy_id, kind, min_quorum, band, timeout_seconds) AS (VALUES {_POLICY_ROWS}),
    req AS (SELECT * FROM (SELECT DISTINCT source_id FROM v_quotes),
      (SELECT unnest(['default', 'shadow', 'live']) AS policy_set), (SELECT unnest(['settle','ohlc','volume','oi','tick','close']) AS field))
    SELECT source_id, policy_set, field, coalesce(o.policy_id, u.policy_id) AS policy_id, coalesce(o.kind, u.kind) AS kind,
      coalesce(o.min_quorum, u.min_quorum)::BIGINT AS min_quorum, coalesce(o.band, u.band) AS band,
      coalesce(o.timeout_seconds, u.timeout_seconds)::BIGINT AS timeout_seconds
    FROM req LEFT JOIN pol o ON o.ps = policy_set AND o.f = field JOIN pol u ON u.ps = policy_set AND u.f IS NULL"""
)


def a4_majority(spark, sf):
    p = dims.Policy("ohlc_majority_v1", "majority_vote", 2, "NORMAL")
    out = consensus.field_consensus(v_quotes(spark, sf), ["contract", "ts"], "close", p, "documented")
    return present(out.select("contract", "ts", "outcome", "close", "n_sources"))


A4_MAJORITY_SQL = sql(
    """WITH q AS (SELECT * FROM v_quotes WHERE tier <= 4),
    c AS (SELECT contract, ts, close, count(*) AS c, min(source_id) AS s FROM q GROUP BY 1, 2, 3),
    b AS (SELECT contract, ts, sum(c)::BIGINT AS n, (list({'c': c, 'close': close} ORDER BY c DESC, s))[1] AS b FROM c GROUP BY 1, 2),
    o AS (SELECT *, CASE WHEN n < 2 THEN 'incomplete' WHEN b.c >= 2 THEN 'verified' ELSE 'disagreement' END AS outcome FROM b)
    SELECT contract, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, outcome, CASE WHEN outcome = 'verified' THEN b.close::DOUBLE END AS close,
      n AS n_sources FROM o"""
)


def a4_tier(spark, sf):
    p = dims.policy_for("default", "oi")
    q = v_quotes(spark, sf).withColumn("oi", F.col("volume") + F.col("tier"))
    out = consensus.field_consensus(q, ["contract", "ts"], "oi", p, "documented")
    return present(out.select("contract", "ts", "outcome", "oi", "n_sources"))


A4_TIER_SQL = sql(
    """SELECT contract, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, 'verified' AS outcome,
      arg_min(volume + tier, (tier, source_id))::BIGINT AS oi, count(*) AS n_sources FROM v_quotes WHERE tier <= 4 GROUP BY contract, v_quotes.ts"""
)


def w6(spark, sf):
    bars = consensus.bar_consensus(v_quotes(spark, sf), WIDE3).filter("outcome = 'verified'")
    return present(consensus.chain_hashes(bars).select("contract", "ts", "run_hash", "prev_hash"))


def p14(spark, sf):
    out = consensus.settle_consensus(v_settles(spark, sf), EXACT3)
    src = v_settles(spark, sf).select("source_id", "tier").distinct()
    return present(consensus.pending_sources(out, src, EXACT3).select("contract", "as_of_date", "n_sources", "quorum", "sources", "pending"))


P14_SQL = sql(
    """SELECT contract, as_of_date::VARCHAR AS as_of_date, count(*) AS n_sources, 3::BIGINT AS quorum,
      string_agg(source_id, ',' ORDER BY source_id) AS sources,
      array_to_string(list_sort(list_filter((SELECT list(DISTINCT source_id) FROM v_settles WHERE tier <= 4), lambda s: NOT list_contains(list(source_id), s))), ',') AS pending
    FROM v_settles WHERE tier <= 4 GROUP BY contract, v_settles.as_of_date HAVING count(*) < 3"""
)


@view(stored=True)
def v_venue_bars(spark, sf):
    """Five-minute venue bars whose times fall into the London fixing hour, over a whole year."""
    t = v_ticks(spark, sf)
    day = F.date_add(F.to_date("ts"), ((F.col("event_id") % 12) * 30).cast("int"))
    minute = F.minute("ts")
    london = F.to_timestamp(F.concat(day.cast("string"), F.lit(" 15:"), F.lpad(minute.cast("string"), 2, "0"), F.lit(":00")))
    t = t.withColumn("ts", F.to_utc_timestamp(london, "Europe/London")).withColumn("venue", F.concat(F.lit("venue_"), (F.col("user_id") % 4).cast("string")))
    t = t.withColumn("contract", F.when(F.col("contract").isin("ESH24", "CLH24"), "BTCUSD").otherwise("ETHUSD"))
    five = F.timestamp_seconds((F.floor(F.unix_timestamp("ts") / 300) * 300).cast("long"))
    return t.withColumn("bar", five).groupBy("contract", "venue", "bar").agg(
        F.max_by("px", F.struct("ts", "event_id")).alias("close"), F.count(F.lit(1)).alias("volume")
    ).withColumnRenamed("bar", "ts")


VENUE_SQL = {
    "v_venue_bars": """SELECT contract, venue, to_timestamp((CAST(floor(epoch(uts)) AS BIGINT) // 300) * 300) AT TIME ZONE 'UTC' AS ts,
        arg_max(px, (uts, event_id)) AS close, count(*) AS volume FROM (
        SELECT event_id, px, CASE WHEN contract IN ('ESH24', 'CLH24') THEN 'BTCUSD' ELSE 'ETHUSD' END AS contract,
          'venue_' || (user_id % 4)::VARCHAR AS venue,
          (CAST(CAST(ts AS DATE) + CAST((event_id % 12) * 30 AS INTEGER) AS TIMESTAMP) + INTERVAL 15 HOUR + to_minutes(minute(ts)))
            AT TIME ZONE 'Europe/London' AT TIME ZONE 'UTC' AS uts FROM v_ticks) GROUP BY 1, 2, 3"""
}


def a6(spark, sf):
    return present(fixing.reference_rate(v_venue_bars(spark, sf)).select("contract", "fix_date", "fix", "slots_valid", "venues", "sha"))


A6_SQL = sql(
    """WITH b AS (SELECT *, CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/London' AS TIMESTAMP) AS lt FROM v_venue_bars),
    w AS (SELECT *, CAST(lt AS DATE) AS fix_date, minute(lt) // 5 AS slot FROM b WHERE hour(lt) = 15),
    v AS (SELECT contract, fix_date, slot, venue, arg_max(close, ts) AS close FROM w GROUP BY 1, 2, 3, 4),
    s AS (SELECT contract, fix_date, slot, count(*) AS n, CAST(sum(close) AS DOUBLE) / count(*) AS m FROM v GROUP BY 1, 2, 3),
    h AS (SELECT contract, fix_date, array_to_string(list_sort(list(venue || '|' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00|' || close::VARCHAR || '|' || volume::VARCHAR)), chr(10)) AS body,
        array_to_string(list_sort(list(DISTINCT venue)), ',') AS venues FROM w GROUP BY 1, 2)
    SELECT s.contract, s.fix_date::VARCHAR AS fix_date, round(avg(m) FILTER (n >= 2), 6) AS fix, count(*) FILTER (n >= 2) AS slots_valid,
      any_value(venues) AS venues, sha256(s.contract || '|' || s.fix_date::VARCHAR || chr(10) || any_value(body)) AS sha
    FROM s JOIN h ON s.contract = h.contract AND s.fix_date = h.fix_date GROUP BY s.contract, s.fix_date""",
    VENUE_SQL,
)


def _asof_points(spark, sf):
    s = v_settles(spark, sf)
    w = s.select("contract", F.last_day("as_of_date").alias("as_of_date")).distinct()
    return w.select("contract", "as_of_date", F.explode(F.array(*[F.lit(x) for x in ("src_a", "src_b", "src_c", "src_d")])).alias("source_id"))


def j1(spark, sf):
    got = pit.latest_settle(v_settles(spark, sf).drop("root"), _asof_points(spark, sf), ["contract", "source_id"])
    got = got.filter("found IS NOT NULL")
    return present(got.select("contract", "source_id", "as_of_date", F.col("found.date").alias("found_date"),
                              F.col("found.settle").alias("settle"), F.col("found.settle_state").alias("settle_state"), F.col("found.sha").alias("sha")))


J1_POINTS = {
    "v_points": """SELECT contract, pt, source_id FROM (SELECT DISTINCT contract, last_day(as_of_date) AS pt FROM v_settles),
      (SELECT unnest(['src_a','src_b','src_c','src_d']) AS source_id)"""
}
_J1_BODY = """SELECT p.contract, p.source_id, p.pt, arg_max(s, (s.as_of_date, CASE s.settle_state WHEN 'final' THEN 2 WHEN 'preliminary' THEN 1 ELSE 0 END, s.sha)) AS f
    FROM v_points p JOIN v_settles s ON s.contract = p.contract AND s.source_id = p.source_id AND s.as_of_date <= p.pt GROUP BY 1, 2, 3"""
J1_SQL = sql(
    f"""WITH x AS ({_J1_BODY})
    SELECT contract, source_id, pt::VARCHAR AS as_of_date, f.as_of_date::VARCHAR AS found_date, f.settle::DOUBLE AS settle,
      f.settle_state AS settle_state, f.sha AS sha FROM x""",
    J1_POINTS,
)


def flagship(spark, sf):
    """Verified settle per contract as of each month end: as-of read per source, then consensus."""
    got = pit.latest_settle(v_settles(spark, sf).drop("root"), _asof_points(spark, sf), ["contract", "source_id"])
    got = got.filter("found IS NOT NULL").select("contract", "source_id", "as_of_date", "found.*").drop("date", "rank")
    return _settles_out(consensus.settle_consensus(got, WIDE3))


FLAGSHIP_SQL = _settle_sql(
    WIDE3, "v_asof",
    {**J1_POINTS, "v_asof": f"SELECT f.* EXCLUDE (as_of_date), pt AS as_of_date FROM (SELECT pt, f FROM ({_J1_BODY})) AS x(pt, f)"},
)


def j2(spark, sf):
    cot = v_cot(spark, sf).withColumn("known_at", pit.cot_known_at(F.col("report_date")))
    req = v_cot(spark, sf).select("code", F.date_trunc("quarter", "report_date").alias("as_of")).distinct()
    req = req.withColumn("since", F.date_sub(F.to_date("as_of"), 180))
    return present(pit.cot_history(req, cot).select("code", "as_of", "report_date", "known_at", "open_interest", "spec_long"))


J2_SQL = sql(
    """WITH c AS (SELECT *, (CAST(report_date + 3 AS TIMESTAMP) + INTERVAL 930 MINUTE) AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC' AS known_at FROM v_cot),
    r AS (SELECT DISTINCT code, CAST(date_trunc('quarter', report_date) AS TIMESTAMP) AS as_of FROM v_cot)
    SELECT r.code, strftime(as_of, '%Y-%m-%d %H:%M:%S') AS as_of, report_date::VARCHAR AS report_date, strftime(known_at, '%Y-%m-%d %H:%M:%S') AS known_at,
      open_interest, spec_long FROM r JOIN c ON c.code = r.code AND report_date >= CAST(as_of AS DATE) - 180 AND report_date <= CAST(as_of AS DATE) AND known_at <= as_of"""
)


def p11(spark, sf):
    return present(pit.net_positioning(v_cot(spark, sf)).withColumn("known_at", pit.cot_known_at(F.col("report_date"))).select(
        "code", "report_date", "known_at", "spec_net", "comm_net"))


P11_SQL = sql(
    """SELECT code, report_date::VARCHAR AS report_date, strftime((CAST(report_date + 3 AS TIMESTAMP) + INTERVAL 930 MINUTE) AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS known_at,
      spec_long - spec_short AS spec_net, comm_long - comm_short AS comm_net FROM v_cot"""
)


def _macro_points(spark, sf):
    return v_macro(spark, sf).select("series", F.explode(F.expr("array(date_add(ref_date, 14), last_day(ref_date))")).alias("as_of")).distinct()


def j3(spark, sf):
    got = pit.latest_vintage(_macro_points(spark, sf), v_macro(spark, sf)).filter("found IS NOT NULL")
    return present(got.select("series", "as_of", F.col("found.ref_date").alias("ref_date"), F.col("found.known_at").alias("known_at"), F.col("found.value").alias("value")))


J3_SQL = sql(
    """WITH p AS (SELECT DISTINCT series, unnest([CAST(ref_date + 14 AS DATE), last_day(ref_date)]) AS as_of FROM v_macro),
    x AS (SELECT p.series, p.as_of, arg_max(m, (m.ref_date, m.known_at, m.value)) AS f FROM p JOIN v_macro m ON m.series = p.series AND m.known_at <= p.as_of GROUP BY 1, 2)
    SELECT series, as_of::VARCHAR AS as_of, f.ref_date::VARCHAR AS ref_date, f.known_at::VARCHAR AS known_at, f.value AS value FROM x"""
)


def p12(spark, sf):
    m = v_macro(spark, sf)
    cut = F.date_add(F.col("ref_date"), 75)
    return present(pit.known_by(m, cut).groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.max("known_at").alias("latest")))


P12_SQL = sql("SELECT series, count(*) AS n, max(known_at)::VARCHAR AS latest FROM v_macro WHERE known_at <= ref_date + 75 GROUP BY series")


def p13(spark, sf):
    m = v_macro(spark, sf).withColumn("is_void", F.month("ref_date") == 10)
    m = m.withColumn("v", F.when(~F.col("is_void"), F.col("value")))
    return present(m.withColumn("used", pit.require_value(F.col("v"), F.col("is_void"))).groupBy("series").agg(
        F.count(F.lit(1)).alias("n"), F.count("used").alias("n_used"), F.max("used").alias("top")))


P13_SQL = sql(
    "SELECT series, count(*) AS n, count(*) FILTER (month(ref_date) <> 10) AS n_used, max(value) FILTER (month(ref_date) <> 10) AS top FROM v_macro GROUP BY series"
)


@view(stored=True)
def _events(spark, sf):
    names = F.array(*[F.lit(s[0]) for s in dims.SERIES])
    o = load(spark, sf, "orders").select(
        F.element_at(names, (F.col("o_custkey") % len(dims.SERIES) + 1).cast("int")).alias("series"), F.trunc("o_orderdate", "month").alias("m"))
    return o.distinct().select(
        "series", F.concat_ws("_", "series", F.year("m").cast("string"), F.lpad(F.month("m").cast("string"), 2, "0")).alias("event_id"),
        F.date_add("m", 9).alias("release_date"))


_NAMES_SQL = "[" + ", ".join(f"'{s[0]}'" for s in dims.SERIES) + "]"
EVENTS_SQL = {
    "v_events": f"""SELECT series, series || '_' || year(m)::VARCHAR || '_' || lpad(month(m)::VARCHAR, 2, '0') AS event_id, CAST(m + 9 AS DATE) AS release_date
      FROM (SELECT DISTINCT {_NAMES_SQL}[o_custkey % {len(dims.SERIES)} + 1] AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders)"""
}


def p10(spark, sf):
    e = _events(spark, sf)
    return present(e.select("event_id", pit.series_of_event(F.col("event_id"), [s[0] for s in dims.SERIES]).alias("series")))


P10_SQL = sql(
    f"""SELECT event_id, arg_max(s, length(s)) AS series FROM v_events, (SELECT unnest({_NAMES_SQL}) AS s)
      WHERE event_id = s OR starts_with(event_id, s || '_') GROUP BY event_id""",
    EVENTS_SQL,
)


def j11(spark, sf):
    e = _events(spark, sf).withColumn("release_at", F.col("release_date").cast("timestamp"))
    mon, yr = F.month("release_date"), F.year("release_date")
    current = e.filter(~((mon == 11) & (yr % 2 == 0))).withColumn(
        "release_at", F.when(mon == 7, F.col("release_at") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("release_at")))
    stored = e.filter(mon != 1)
    return present(pit.schedule_drift(stored, current))


J11_SQL = sql(
    """WITH s AS (SELECT series, event_id, CAST(release_date AS TIMESTAMP) AS a FROM v_events WHERE month(release_date) <> 1),
    c AS (SELECT series, event_id, CASE WHEN month(release_date) = 7 THEN CAST(release_date AS TIMESTAMP) + INTERVAL 1 DAY ELSE CAST(release_date AS TIMESTAMP) END AS a
      FROM v_events WHERE NOT (month(release_date) = 11 AND year(release_date) % 2 = 0)),
    j AS (SELECT coalesce(s.series, c.series) AS series, coalesce(s.event_id, c.event_id) AS event_id, s.a AS sa, c.a AS ca FROM s FULL OUTER JOIN c ON s.event_id = c.event_id AND s.series = c.series)
    SELECT series, event_id, strftime(sa, '%Y-%m-%d %H:%M:%S') AS stored_at, strftime(ca, '%Y-%m-%d %H:%M:%S') AS current_at,
      CASE WHEN ca IS NULL THEN 'cancelled' WHEN sa IS NULL THEN 'added' ELSE 'moved' END AS kind FROM j WHERE sa IS DISTINCT FROM ca""",
    EVENTS_SQL,
)

def a5(spark, sf):
    out = consensus.settle_consensus(v_settles(spark, sf), SETTLE).filter("outcome = 'verified'")
    return present(out.select("contract", "as_of_date", F.size("provenance").alias("n_hashes"), "run_hash"))


QUERIES = {
    "A5_run_hash": a5,
    "A1_settle_consensus_exact": a1_exact,
    "A1_settle_consensus_wide": a1_wide,
    "A2_bar_consensus_exact": a2_exact,
    "A2_bar_consensus_wide": a2_wide,
    "A3_policy_resolution": a3,
    "A4_majority_vote": a4_majority,
    "A4_highest_tier": a4_tier,
    "A6_reference_rate_fix": a6,
    "W6_hash_chain": w6,
    "P14_pending_sources": p14,
    "J1_latest_settle_asof": j1,
    "J1_A1_verified_settle_asof": flagship,
    "J2_P12_cot_history": j2,
    "P11_P15_cot_known_at_net": p11,
    "J3_macro_vintage_asof": j3,
    "P12_known_by": p12,
    "P13_void_guard": p13,
    "P10_series_of_event": p10,
    "J11_schedule_drift": j11,
}

ORACLES = {
    "A5_run_hash": "SELECT contract, as_of_date, n_sources AS n_hashes, run_hash FROM (" + _settle_sql(SETTLE) + ") WHERE outcome = 'verified'",
    "A1_settle_consensus_exact": _settle_sql(SETTLE),
    "A1_settle_consensus_wide": _settle_sql(WIDE3),
    "A2_bar_consensus_exact": sql(_bars_sql(OHLC) + _BARS_SELECT),
    "A2_bar_consensus_wide": sql(_bars_sql(WIDE3) + _BARS_SELECT),
    "A3_policy_resolution": A3_SQL,
    "A4_majority_vote": A4_MAJORITY_SQL,
    "A4_highest_tier": A4_TIER_SQL,
    "A6_reference_rate_fix": A6_SQL,
    "W6_hash_chain": sql(_bars_sql(WIDE3) + """SELECT contract, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, run_hash,
        lag(run_hash) OVER (PARTITION BY contract ORDER BY done.ts) AS prev_hash FROM done WHERE outcome = 'verified'"""),
    "P14_pending_sources": P14_SQL,
    "J1_latest_settle_asof": J1_SQL,
    "J1_A1_verified_settle_asof": FLAGSHIP_SQL,
    "J2_P12_cot_history": J2_SQL,
    "P11_P15_cot_known_at_net": P11_SQL,
    "J3_macro_vintage_asof": J3_SQL,
    "P12_known_by": P12_SQL,
    "P13_void_guard": P13_SQL,
    "P10_series_of_event": P10_SQL,
    "J11_schedule_drift": J11_SQL,
}
