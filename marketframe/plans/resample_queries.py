"""Registered queries: resampling, multiple testing and cross-validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import crossval as cv
from ..operators import performance as perf
from ..operators import resample as rs
from ..operators.mergeable import MAX_DRAWDOWN
from . import sqlmath
from .stat_queries import STAT_VIEWS
from .views import present, sql, v_panel, view

SEED, DRAWS, BLOCK, PPY = 7, 10_000, 5, 12.0


@view(stored=True)
def v_fam(spark, sf):
    """Two families of ten strategies; half of the returns are lifted so that some tests reject."""
    lift = F.when(F.col("strategy_id") % 4 < 2, 0.002).otherwise(0.0)
    return v_panel(spark, sf).select((F.col("strategy_id") % 2).alias("family"), "strategy_id", "i", (F.col("r") + lift).alias("r"))


@view(stored=True)
def v_means(spark, sf):
    return rs.draw_means(v_fam(spark, sf), DRAWS, BLOCK, SEED)


def u(tag: str, *counters: str, slot: int = 0) -> str:
    text = " || '|' || ".join(f"({c})::VARCHAR" for c in counters)
    return f"(('0x' || substr(md5('{tag}|{SEED}|' || {text}), {1 + 8 * slot}, 8))::UBIGINT / 4294967296e0)"


def _moving() -> str:
    return f"CAST(floor({u('mb', 'b', f's // {BLOCK}')} * n) AS BIGINT)"


_GRID = f"(SELECT unnest(range({DRAWS})) AS b), (SELECT n, unnest(range(n)) AS s FROM v_n)"
VIEWS = {
    **STAT_VIEWS,
    "v_fam": "SELECT strategy_id % 2 AS family, strategy_id, i, r + CASE WHEN strategy_id % 4 < 2 THEN 0.002e0 ELSE 0e0 END AS r FROM v_panel",
    "v_n": "SELECT max(i) + 1 AS n FROM v_fam",
    "v_sb0": f"SELECT b, s, n, CASE WHEN s = 0 OR {u('sb', 'b', 's')} < {1 / BLOCK}e0 THEN s END AS s0, CAST(floor({u('sb', 'b', 's', slot=1)} * n) AS BIGINT) AS p0 FROM {_GRID}",
    "v_sb": """SELECT b, s, (last_value(CASE WHEN s0 IS NOT NULL THEN p0 END IGNORE NULLS) OVER w + s - last_value(s0 IGNORE NULLS) OVER w) % n AS i FROM v_sb0
        WINDOW w AS (PARTITION BY b ORDER BY s)""",
    "v_mb": f"SELECT b, s, ({_moving()} + s % {BLOCK}) % n AS i FROM {_GRID}",
    "v_fb": f"""WITH p AS (SELECT b, s AS k, n, CAST(floor({u('fb', 'b', 's')} * ceil(n / {BLOCK}e0)) AS BIGINT) * {BLOCK} AS f FROM {_GRID}),
        e AS (SELECT *, least({BLOCK}, n - f) AS l, sum(least({BLOCK}, n - f)) OVER (PARTITION BY b ORDER BY k) AS z FROM p),
        x AS (SELECT b, n, f, z - l AS a, unnest(range(l)) AS j FROM e WHERE z - l < n) SELECT b, CAST(a + j AS BIGINT) AS s, f + j AS i FROM x WHERE a + j < n""",
    "v_iid": f"SELECT b, s, CAST(floor({u('iid', 'b', 's')} * n) AS BIGINT) AS i FROM {_GRID}",
    "v_means": "SELECT family, b, strategy_id, avg(r) AS dstar FROM v_sb d JOIN v_fam f ON f.i = d.i GROUP BY 1, 2, 3",
    "v_obs": "SELECT family, strategy_id, avg(r) AS dbar, count(*) AS n FROM v_fam GROUP BY 1, 2",
    "v_st": """SELECT o.*, omega, CASE WHEN omega > 0 THEN sqrt(n) * dbar / omega ELSE 0e0 END AS t FROM v_obs o JOIN (
        SELECT m.strategy_id, sqrt(avg(n * pow(dstar - dbar, 2))) AS omega FROM v_means m JOIN v_obs o ON o.strategy_id = m.strategy_id GROUP BY 1) w ON w.strategy_id = o.strategy_id""",
}


def rsql(body):
    return sql(body, VIEWS)


def _indices(make, view_name):
    def run(spark, sf):
        sizes = rs.family_sizes(v_fam(spark, sf))
        d = make(sizes)
        return present(d.groupBy("family", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("i").alias("total"), F.sum(F.col("i") * F.col("step")).alias("check")))

    return run, rsql(f"SELECT family, b, count(*) AS n, sum(i)::BIGINT AS total, sum(i * s)::BIGINT AS \"check\" FROM {view_name}, (SELECT DISTINCT family FROM v_fam) GROUP BY family, b")


r1, R1_SQL = _indices(lambda s: rs.stationary_indices(s, DRAWS, BLOCK, SEED), "v_sb")
r2, R2_SQL = _indices(lambda s: rs.moving_indices(s, DRAWS, BLOCK, SEED), "v_mb")
r3, R3_SQL = _indices(lambda s: rs.fixed_indices(s, DRAWS, BLOCK, SEED), "v_fb")


def r4(spark, sf):
    return present(rs.optimal_block_length(v_fam(spark, sf)))


R4_SQL = rsql(
    """WITH c AS (SELECT family, strategy_id, i, r - avg(r) OVER p AS x, count(*) OVER p AS n FROM v_fam WINDOW p AS (PARTITION BY strategy_id)),
    z AS (SELECT *, greatest(5, ceil(sqrt(log10(n))))::BIGINT AS kn, ceil(sqrt(n))::BIGINT + greatest(5, ceil(sqrt(log10(n))))::BIGINT AS mm FROM c),
    l AS (SELECT *, unnest(range(0, mm + 1)) AS lag FROM z),
    v AS (SELECT l.family, l.strategy_id, l.lag, max(l.n) AS n, max(l.kn) AS kn, max(l.mm) AS mm, sum(l.x * z.x) / max(l.n) AS g FROM l JOIN z ON z.strategy_id = l.strategy_id AND z.i = l.i + l.lag GROUP BY 1, 2, 3),
    b AS (SELECT *, abs(g / first_value(g) OVER (PARTITION BY strategy_id ORDER BY lag)) >= 2 * sqrt(log10(n) / n) AS big FROM v),
    q AS (SELECT *, max(big::INT) OVER (PARTITION BY strategy_id ORDER BY lag ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS any_big FROM b),
    m AS (SELECT strategy_id, min(lag) FILTER (any_big = 0 AND lag >= 1 AND lag <= mm - kn + 1) - 1 AS mq, max(lag) FILTER (big AND lag >= 1) AS ml, max(mm) AS mm FROM q GROUP BY 1),
    w AS (SELECT strategy_id, least(2 * greatest(coalesce(mq, ml, 1), 1), mm) AS m FROM m),
    s AS (SELECT v.family, v.strategy_id, max(n) AS n, sum(CASE WHEN lag = 0 THEN 0 ELSE 2 * lam * lag * g END) AS gh, sum(CASE WHEN lag = 0 THEN g ELSE 2 * lam * g END) AS d0 FROM (
      SELECT v.*, CASE WHEN lag / w.m::DOUBLE <= 0.5 THEN 1e0 WHEN lag <= w.m THEN 2 * (1 - lag / w.m::DOUBLE) ELSE 0 END AS lam FROM v JOIN w ON w.strategy_id = v.strategy_id) v GROUP BY 1, 2)
    SELECT family, strategy_id, n, CASE WHEN gh > 0 AND d0 <> 0 THEN greatest(1, least(floor(pow(gh * gh / (d0 * d0), 1 / 3e0) * pow(n, 1 / 3e0) + 0.5), ceil(least(3 * sqrt(n), n / 3e0)))) ELSE 1 END::BIGINT AS block FROM s"""
)


def _r5(scheme, statistic, view_name):
    def run(spark, sf):
        return present(rs.block_bootstrap_ci(v_fam(spark, sf), statistic, scheme, DRAWS, BLOCK, 0.95, SEED).drop("reason"))

    stat = {
        "mean": "avg(r)", "profit_factor": "sum(greatest(r, 0)) / sum(greatest(-r, 0))", "sharpe": "avg(r) / stddev_samp(r)",
    }[statistic]
    text = rsql(
        f"""WITH t AS (SELECT strategy_id, b, {stat} AS th FROM {view_name} d JOIN v_fam f ON f.i = d.i GROUP BY 1, 2),
        q AS (SELECT strategy_id, quantile_cont(th, 0.025) AS lo, quantile_cont(th, 0.975) AS hi FROM t GROUP BY 1),
        p AS (SELECT family, strategy_id, count(*) AS n, {stat} AS pt FROM v_fam GROUP BY 1, 2)
        SELECT family, p.strategy_id, n, round(pt, 6) AS point, round(lo, 6) AS lower, round(hi, 6) AS upper FROM p JOIN q ON q.strategy_id = p.strategy_id"""
    )
    if statistic == "profit_factor":  # the only one with undefined draws and infinite points
        text = rsql(
            f"""WITH t AS (SELECT strategy_id, b, {stat} AS th FROM {view_name} d JOIN v_fam f ON f.i = d.i GROUP BY 1, 2),
            q AS (SELECT strategy_id, quantile_cont(th, 0.025) AS lo, quantile_cont(th, 0.975) AS hi, count(*) AS kept FROM t WHERE NOT isnan(th) GROUP BY 1),
            p AS (SELECT family, strategy_id, count(*) AS n, {stat} AS pt FROM v_fam GROUP BY 1, 2),
            o AS (SELECT *, isfinite(pt) AND coalesce(kept, 0) >= {DRAWS // 2} AS ok FROM p LEFT JOIN q USING (strategy_id))
            SELECT family, strategy_id, n, round(pt, 6) AS point, CASE WHEN ok THEN round(lo, 6) END AS lower, CASE WHEN ok THEN round(hi, 6) END AS upper FROM o"""
        )
    return run, text


r5a, R5A_SQL = _r5("stationary", "mean", "v_sb")
r5b, R5B_SQL = _r5("moving", "profit_factor", "v_mb")
r5c, R5C_SQL = _r5("fixed", "sharpe", "v_fb")


def r6(spark, sf):
    return present(rs.bca_interval(v_fam(spark, sf), "profit_factor", DRAWS, 0.95, SEED).drop("reason"))


_R6 = f"""WITH x AS (SELECT family, strategy_id, i, greatest(r, 0)::DECIMAL(28,18) AS xg, greatest(-r, 0)::DECIMAL(28,18) AS xl FROM v_fam),
    p AS (SELECT family, strategy_id, count(*) AS n, sum(xg) AS eg, sum(xl) AS el, sum(xg)::DOUBLE AS g, sum(xl)::DOUBLE AS l FROM x GROUP BY 1, 2),
    t0 AS (SELECT strategy_id, b, sum(xg)::DOUBLE / sum(xl)::DOUBLE AS th FROM v_iid d JOIN x ON x.i = d.i GROUP BY 1, 2),
    t AS (SELECT * FROM t0 WHERE NOT isnan(th)),
    c AS (SELECT t.strategy_id, count(*) AS m, (count(*) FILTER (th < g / l) + 0.5e0 * count(*) FILTER (th = g / l)) / count(*) AS raw FROM t JOIN p ON p.strategy_id = t.strategy_id GROUP BY 1),
    j AS (SELECT f.strategy_id, (eg - xg)::DOUBLE / (el - xl)::DOUBLE AS j FROM x f JOIN p ON p.strategy_id = f.strategy_id),
    od AS (SELECT strategy_id, count(*) FILTER (NOT isfinite(j)) AS odd FROM j GROUP BY 1),
    jm AS (SELECT *, avg(j) OVER (PARTITION BY strategy_id) - j AS dv FROM j WHERE isfinite(j)),
    a AS (SELECT strategy_id, sum(dv * dv) AS d2, sum(dv * dv * dv) AS d3 FROM jm GROUP BY 1),
    sh AS (SELECT p.strategy_id, coalesce(m, 0) AS m, least(greatest(raw, 0.5e0 / m), 1 - 0.5e0 / m) AS sh, CASE WHEN odd = 0 AND d2 > 0 THEN d3 / (6 * pow(d2, 1.5e0)) ELSE 0e0 END AS ac,
      isfinite(g / l) AND coalesce(m, 0) >= {DRAWS // 2} AS ok FROM p JOIN od USING (strategy_id) LEFT JOIN c USING (strategy_id) LEFT JOIN a USING (strategy_id)),
    z AS (SELECT *, {sqlmath.ppf('sh')} AS z0 FROM sh),
    de AS (SELECT *, z0 - 1.959963984540054e0 AS c1, z0 + 1.959963984540054e0 AS c2 FROM z),
    dn AS (SELECT *, 1 - ac * c1 AS d1, 1 - ac * c2 AS d2 FROM de),
    zz AS (SELECT *, z0 + c1 / CASE WHEN abs(d1) < 1e-12 THEN CASE WHEN d1 < 0 THEN -1e-12 ELSE 1e-12 END ELSE d1 END AS a1,
      z0 + c2 / CASE WHEN abs(d2) < 1e-12 THEN CASE WHEN d2 < 0 THEN -1e-12 ELSE 1e-12 END ELSE d2 END AS a2 FROM dn),
    pr AS (SELECT *, {sqlmath.cdf('a1')} AS p1, {sqlmath.cdf('a2')} AS p2 FROM zz),
    o AS (SELECT strategy_id, list_sort(list(th)) AS ths FROM t GROUP BY 1),
    q AS (SELECT pr.*, ths, CAST(floor((m - 1) * p1) AS BIGINT) AS k1, (m - 1) * p1 - floor((m - 1) * p1) AS w1, CAST(floor((m - 1) * p2) AS BIGINT) AS k2, (m - 1) * p2 - floor((m - 1) * p2) AS w2
      FROM pr LEFT JOIN o USING (strategy_id)),
    e AS (SELECT *, ths[k1 + 1] AS l1, ths[least(k1 + 2, m)] AS h1, ths[k2 + 1] AS l2, ths[least(k2 + 2, m)] AS h2 FROM q),
    r AS (SELECT strategy_id, z0, ac, CASE WHEN NOT ok THEN NULL WHEN w1 = 0 OR l1 = h1 THEN l1 ELSE l1 + w1 * (h1 - l1) END AS lo,
      CASE WHEN NOT ok THEN NULL WHEN w2 = 0 OR l2 = h2 THEN l2 ELSE l2 + w2 * (h2 - l2) END AS hi FROM e)"""
R6_SQL = rsql(_R6 + """ SELECT family, p.strategy_id, n, round(g / l, 6) AS point, round(lo, 6) AS lower, round(hi, 6) AS upper, round(z0, 6) AS z0, round(ac, 6) AS accel,
    coalesce(isfinite(lo) AND lo > 1, false) AS exceeds_one FROM p JOIN r ON r.strategy_id = p.strategy_id""")


def r7_sign(spark, sf):
    return present(rs.permutation_test(v_fam(spark, sf), "sign_flip", "mean", DRAWS, BLOCK, True, SEED))


_PU = u("perm", "b", "s")
_R7 = f"""WITH d AS (SELECT b, s AS i, CASE WHEN {_PU} < 0.5 THEN 1e0 ELSE -1e0 END AS sg FROM {_GRID}),
    x AS (SELECT strategy_id, b, avg(r * sg) AS st FROM d JOIN v_fam f ON f.i = d.i GROUP BY 1, 2)"""
_P_SELECT = """ SELECT family, o.strategy_id, round(dbar, 6) AS observed, count(*) AS valid, round((count(*) FILTER ({cond}) + 1e0) / (count(*) + 1e0), 6) AS p_value
    FROM x JOIN v_obs o ON o.strategy_id = x.strategy_id GROUP BY family, o.strategy_id, dbar"""
R7A_SQL = rsql(_R7 + _P_SELECT.format(cond="st >= dbar"))


def _r7_order(mode, unit):
    def run(spark, sf):
        return present(rs.permutation_test(v_fam(spark, sf), mode, "lag_product", DRAWS, BLOCK, False, SEED))

    key = "i" if unit == 1 else f"i // {unit}"
    text = rsql(
        f"""WITH g AS (SELECT b, s AS i FROM {_GRID}), h AS (SELECT b, i, {u('perm', 'b', key)} AS u, {key} AS un FROM g),
        o AS (SELECT b, i, row_number() OVER (PARTITION BY b ORDER BY u, un, i) AS pos FROM h),
        y AS (SELECT family, strategy_id, b, r * lag(r) OVER (PARTITION BY strategy_id, b ORDER BY pos) AS y FROM o JOIN v_fam f ON f.i = o.i),
        x AS (SELECT family, strategy_id, b, avg(y) AS st FROM y GROUP BY 1, 2, 3),
        ob AS (SELECT strategy_id, avg(y) AS dbar FROM (SELECT strategy_id, r * lag(r) OVER (PARTITION BY strategy_id ORDER BY i) AS y FROM v_fam) GROUP BY 1)
        SELECT family, ob.strategy_id, round(dbar, 6) AS observed, count(*) AS valid, round((count(*) FILTER (abs(st) >= abs(dbar)) + 1e0) / (count(*) + 1e0), 6) AS p_value
        FROM x JOIN ob ON ob.strategy_id = x.strategy_id GROUP BY family, ob.strategy_id, dbar"""
    )
    return run, text


r7_shuffle, R7B_SQL = _r7_order("shuffle", 1)
r7_block, R7C_SQL = _r7_order("block_shuffle", BLOCK)


def r8(spark, sf):
    return present(rs.reality_check(v_fam(spark, sf), v_means(spark, sf)))


R8_SQL = rsql(
    """WITH t AS (SELECT family, max(dbar) AS md, arg_max(strategy_id, (dbar, -strategy_id)) AS best, count(*) AS k, max(n) AS n FROM v_obs GROUP BY 1),
    m AS (SELECT o.family, b, max(sqrt(n) * (dstar - dbar)) AS m FROM v_means x JOIN v_obs o ON o.strategy_id = x.strategy_id GROUP BY 1, 2)
    SELECT t.family, best, round(md, 6) AS max_differential, k AS strategies, n, count(*) AS draws, round((count(*) FILTER (m >= sqrt(n) * md) + 1e0) / (count(*) + 1e0), 6) AS p_value
    FROM t JOIN m ON m.family = t.family GROUP BY t.family, best, md, k, n"""
)


def r9(spark, sf):
    return present(rs.superior_ability(v_fam(spark, sf), v_means(spark, sf)))


R9_SQL = rsql(
    """WITH g AS (SELECT *, CASE WHEN omega > 0 AND t >= -sqrt(2 * ln(ln(greatest(n, 3)))) THEN dbar ELSE 0e0 END AS g FROM v_st),
    t AS (SELECT family, arg_max(strategy_id, (t, -strategy_id)) AS best, max(t) AS mt, max(n) AS n FROM g GROUP BY 1),
    m AS (SELECT g.family, b, greatest(0, max(sqrt(n) * (dstar - g) / omega) FILTER (omega > 0)) AS m FROM v_means x JOIN g ON g.strategy_id = x.strategy_id GROUP BY 1, 2)
    SELECT t.family, best, round(mt, 6) AS max_t, round(greatest(0, mt), 6) AS statistic, n, count(*) AS draws, round((count(*) FILTER (m >= greatest(0, mt)) + 1e0) / (count(*) + 1e0), 6) AS p_value
    FROM t JOIN m ON m.family = t.family GROUP BY t.family, best, mt, n"""
)


def r10(spark, sf):
    return present(rs.stepdown(v_fam(spark, sf), v_means(spark, sf)))


R10_SQL = rsql(
    f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY t DESC, strategy_id) AS k FROM v_st),
    z AS (SELECT k.family, b, k.k, CASE WHEN omega > 0 THEN sqrt(n) * (dstar - dbar) / omega END AS z FROM v_means x JOIN k ON k.strategy_id = x.strategy_id),
    c AS (SELECT k.family, k.strategy_id, k.k, k.t, (SELECT count(*) FROM (SELECT b, max(z) AS m FROM z WHERE z.family = k.family AND z.k >= k.k GROUP BY b) WHERE m >= k.t) AS c FROM k),
    r AS (SELECT *, max((c + 1e0) / {DRAWS + 1}e0) OVER (PARTITION BY family ORDER BY k) AS run FROM c)
    SELECT family, strategy_id, k, round(t, 6) AS t, round(CASE WHEN run <= 0.05 THEN run ELSE min(run) FILTER (run > 0.05) OVER (PARTITION BY family) END, 6) AS adjusted_p, run <= 0.05 AS reject FROM r"""
)

SEGMENTS = 16


def r11(spark, sf):
    return present(cv.overfitting_probability(v_fam(spark, sf), SEGMENTS))


R11_SQL = rsql(
    f"""WITH p AS (SELECT *, i // ((SELECT n FROM v_n) // {SEGMENTS}) AS seg FROM v_fam WHERE i < {SEGMENTS} * ((SELECT n FROM v_n) // {SEGMENTS})),
    m AS (SELECT unnest(range(0, {2 ** SEGMENTS})) AS mask),
    v AS (SELECT family, strategy_id, mask, (mask >> seg) & 1 AS side, avg(r) / stddev_samp(r) AS sr FROM p, m WHERE bit_count(mask) = {SEGMENTS // 2} GROUP BY 1, 2, 3, 4),
    w AS (SELECT a.family, a.strategy_id, a.mask, a.sr AS ins, b.sr AS oos FROM v a JOIN v b ON b.strategy_id = a.strategy_id AND b.mask = a.mask AND a.side = 1 AND b.side = 0),
    b AS (SELECT family, mask, arg_max(oos, (ins, -strategy_id)) AS wo, count(*) AS k FROM w GROUP BY 1, 2),
    l AS (SELECT w.family, w.mask, (count(*) FILTER (oos < wo) + (count(*) FILTER (oos = wo) + 1) / 2e0) / (max(k) + 1) AS rel, max(k) AS k FROM w JOIN b ON b.family = w.family AND b.mask = w.mask GROUP BY 1, 2),
    g AS (SELECT family, ln(rel / (1 - rel)) AS lg, k FROM l), c AS (SELECT family, corr(ins, oos) AS co FROM w GROUP BY 1)
    SELECT g.family, round(avg((lg < 0)::INT), 6) AS pbo, count(*) AS splits, round(avg(lg), 6) AS mean_logit, max(k) AS strategies, round(median(lg), 6) AS median_logit,
      round(any_value(co), 6) AS is_oos_correlation, avg((lg < 0)::INT) < 0.5 AS passes FROM g JOIN c ON c.family = g.family GROUP BY g.family"""
)



def r5_drawdown(spark, sf):
    return present(rs.block_bootstrap_ci(v_fam(spark, sf), MAX_DRAWDOWN, "stationary", DRAWS, BLOCK, 0.95, SEED).drop("reason"))


def _fall(keys: str, order: str, source: str) -> str:
    """Largest drawdown per key: logs of growth against their running peak, both from 0."""
    return f"""SELECT {keys}, max(1 - exp(lg - greatest(pk, 0))) AS dd FROM (SELECT *, max(lg) OVER (PARTITION BY {keys} ORDER BY {order}) AS pk FROM (
        SELECT {keys}, {order}, sum(ln(greatest(1 + r, 1e-300))) OVER (PARTITION BY {keys} ORDER BY {order}) AS lg FROM {source})) GROUP BY ALL"""


R5_DRAWDOWN_SQL = rsql(
    f"""WITH t AS ({_fall("strategy_id, b", "s", "(SELECT strategy_id, b, s, r FROM v_sb d JOIN v_fam f ON f.i = d.i)")}),
    q AS (SELECT strategy_id, quantile_cont(dd, 0.025) AS lo, quantile_cont(dd, 0.975) AS hi FROM t GROUP BY 1), p AS ({_fall("family, strategy_id", "i", "v_fam")})
    SELECT family, p.strategy_id, (SELECT n FROM v_n) AS n, round(dd, 6) AS point, round(lo, 6) AS lower, round(hi, 6) AS upper FROM p JOIN q ON q.strategy_id = p.strategy_id"""
)


def r11_drawdown(spark, sf):
    return present(cv.overfitting_probability(v_fam(spark, sf), SEGMENTS, metric=MAX_DRAWDOWN.negated()))


_SHARPES = "SELECT family, strategy_id, mask, (mask >> seg) & 1 AS side, avg(r) / stddev_samp(r) AS sr FROM p, m WHERE bit_count(mask) = {half} GROUP BY 1, 2, 3, 4"
_FALLS = "SELECT family, strategy_id, mask, side, -dd AS sr FROM ({fall})"
R11_DRAWDOWN_SQL = R11_SQL.replace(
    _SHARPES.format(half=SEGMENTS // 2),
    _FALLS.format(fall=_fall("family, strategy_id, mask, side", "i", f"(SELECT family, strategy_id, mask, (mask >> seg) & 1 AS side, i, r FROM p, m WHERE bit_count(mask) = {SEGMENTS // 2})")),
)


def r12(spark, sf):
    sizes = rs.family_sizes(v_fam(spark, sf))
    out = None
    for mode, kw in (("anchored", {"min_train": 24}), ("rolling", {"train": 24, "step": 7})):
        f = cv.walk_forward(sizes, 12, mode, **kw)
        a = cv.walk_forward_means(v_fam(spark, sf), f).withColumn("mode", F.lit(mode))
        out = a if out is None else out.unionByName(a)
    return present(out)


R12_SQL = rsql(
    """WITH f AS (SELECT 'anchored' AS mode, (v - 24) // 12 AS fold, 0 AS a, v, least(v + 12, n) AS z FROM (SELECT n, unnest(range(24, n, 12)) AS v FROM v_n)
      UNION ALL SELECT 'rolling', (v - 24) // 7, v - 24, v, least(v + 12, n) FROM (SELECT n, unnest(range(24, n, 7)) AS v FROM v_n))
    SELECT family, fold, strategy_id, CASE WHEN i < v THEN 'train' ELSE 'validate' END AS role, count(*) AS n, round(avg(r), 6) AS mean, mode FROM v_fam JOIN f ON i >= a AND i < z GROUP BY ALL"""
)


def r13(spark, sf):
    roles = cv.purged_roles(rs.family_sizes(v_fam(spark, sf)))
    j = v_fam(spark, sf).join(roles, ["family", "i"])
    return present(j.groupBy("family", "mask", "role").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean")))


R13_SQL = rsql(
    """WITH k AS (SELECT n, n // 10 AS q, n % 10 AS x FROM v_n), bl AS (SELECT b, b * q + least(b, x) AS a, (b + 1) * q + least(b + 1, x) AS z FROM k, (SELECT unnest(range(10)) AS b)),
    m AS (SELECT mask FROM (SELECT unnest(range(1024)) AS mask) WHERE bit_count(mask) = 2),
    r AS (SELECT mask, i, max(CASE WHEN i >= a AND i < z THEN 3 WHEN i >= a - 5 AND i < a THEN 2 WHEN i >= z AND i < z + 2 THEN 1 ELSE 0 END) AS c
      FROM m, (SELECT unnest(range(n)) AS i FROM v_n), bl WHERE (mask >> b) & 1 = 1 GROUP BY 1, 2)
    SELECT family, mask, ['train', 'embargoed', 'purged', 'test'][c + 1] AS role, count(*) AS n, round(avg(v.r), 6) AS mean FROM v_fam v JOIN r ON r.i = v.i GROUP BY ALL"""
)

STEPS, FLOOR = 252, 0.995
LEVERS = [float(k) for k in range(1, 12)]  # every whole size up to the largest base


@view(stored=True)
def v_curve(spark, sf):
    return rs.survival(v_fam(spark, sf), LEVERS, STEPS, DRAWS, 0.3, BLOCK, SEED)


def r14(spark, sf):
    return present(v_curve(spark, sf))


VIEWS["v_paths"] = f"""SELECT b, s, (last_value(CASE WHEN s0 IS NOT NULL THEN p0 END IGNORE NULLS) OVER w + s - last_value(s0 IGNORE NULLS) OVER w) % n AS i FROM (
    SELECT b, s, n, CASE WHEN s = 0 OR {u('sb', 'b', 's')} < {1 / BLOCK}e0 THEN s END AS s0, CAST(floor({u('sb', 'b', 's', slot=1)} * n) AS BIGINT) AS p0
    FROM (SELECT unnest(range({DRAWS})) AS b), (SELECT unnest(range({STEPS})) AS s), v_n) WINDOW w AS (PARTITION BY b ORDER BY s)"""
VIEWS["v_series"] = "SELECT family, strategy_id, list(r ORDER BY i) AS rs FROM v_fam GROUP BY 1, 2"
_STEP = "a.e * (1e0 + rs[x.i + 1] * leverage)"
VIEWS["v_surv"] = f"""SELECT family, strategy_id, leverage, avg((lo > 0.7e0)::INT) AS survival FROM (
    SELECT family, strategy_id, leverage, list_reduce(idx, lambda a, x: {{'e': {_STEP}, 'lo': least(a.lo, {_STEP}), 'i': x.i}}, {{'e': 1e0, 'lo': 1e0, 'i': 0::BIGINT}}).lo AS lo
    FROM (SELECT b, list({{'e': 1e0, 'lo': 1e0, 'i': i::BIGINT}} ORDER BY s) AS idx FROM v_paths GROUP BY 1), v_series, (SELECT unnest({LEVERS!r}) AS leverage)) GROUP BY 1, 2, 3"""


def r15(spark, sf):
    c = v_curve(spark, sf).withColumn("contracts", F.col("leverage").cast("long"))
    sizes = v_fam(spark, sf).groupBy("family", "strategy_id").agg((F.lit(6) + F.max("strategy_id") % 6).alias("base"))
    return present(rs.survival_cap(c, sizes, FLOOR))


def _p_values(spark, sf):
    return rs.permutation_test(v_fam(spark, sf), "sign_flip", "mean", DRAWS, BLOCK, True, SEED).select("family", "strategy_id", F.col("p_value").alias("p"))


def r16(spark, sf):
    return present(rs.adjust_p_values(_p_values(spark, sf), ["family"], "strategy_id", 0.2))


R16_SQL = rsql(
    _R7 + """, p AS (SELECT family, o.strategy_id, (count(*) FILTER (st >= dbar) + 1e0) / (count(*) + 1e0) AS p FROM x JOIN v_obs o ON o.strategy_id = x.strategy_id GROUP BY family, o.strategy_id, dbar),
    k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, strategy_id) AS k, count(*) OVER (PARTITION BY family) AS m FROM p),
    a AS (SELECT family, strategy_id, p, least(1, p * m) AS bonferroni, max(least(1, (m - k + 1) * p)) OVER (PARTITION BY family ORDER BY k) AS holm,
      least(1, min(p * m / k) OVER (PARTITION BY family ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS bh FROM k)
    SELECT family, strategy_id, round(p, 6) AS p, round(bonferroni, 6) AS bonferroni, round(holm, 6) AS holm, round(bh, 6) AS bh,
      bonferroni <= 0.2 AS reject_bonferroni, holm <= 0.2 AS reject_holm, bh <= 0.2 AS reject_bh FROM a"""
)


def r17(spark, sf):
    p = v_fam(spark, sf)
    mom = perf.sharpe_moments(p, ["family", "strategy_id"])
    trials = mom.select("family", (F.col("sr") * PPY**0.5).alias("sr_trial"))
    out = rs.promotion(
        perf.deflated_sharpe(mom, trials, ["family"], PPY), perf.probabilistic_sharpe(mom, PPY), rs.bca_interval(p, "profit_factor", DRAWS, 0.95, SEED),
        rs.permutation_test(p, "sign_flip", "mean", DRAWS, BLOCK, True, SEED), rs.superior_ability(p, v_means(spark, sf)), 0.05)
    return present(out.select("family", "strategy_id", "dsr", "psr", "lower", "permutation_p", "superiority_p", "failed_gates", "promoted"))


R17_SQL = rsql(
    _R6 + f""", d7 AS (SELECT b, s AS i, CASE WHEN {_PU} < 0.5 THEN 1e0 ELSE -1e0 END AS sg FROM {_GRID}),
    x7 AS (SELECT strategy_id, b, avg(r * sg) AS st FROM d7 JOIN v_fam f ON f.i = d7.i GROUP BY 1, 2),
    p7 AS (SELECT o.strategy_id, (count(*) FILTER (st >= dbar) + 1e0) / (count(*) + 1e0) AS pp FROM x7 JOIN v_obs o ON o.strategy_id = x7.strategy_id GROUP BY o.strategy_id, dbar),
    g9 AS (SELECT *, CASE WHEN omega > 0 AND t >= -sqrt(2 * ln(ln(greatest(n, 3)))) THEN dbar ELSE 0e0 END AS g FROM v_st),
    t9 AS (SELECT family, greatest(0, max(t)) AS st FROM g9 GROUP BY 1),
    m9 AS (SELECT g9.family, b, greatest(0, max(sqrt(n) * (dstar - g) / omega) FILTER (omega > 0)) AS m FROM v_means x JOIN g9 ON g9.strategy_id = x.strategy_id GROUP BY 1, 2),
    s9 AS (SELECT t9.family, (count(*) FILTER (m >= st) + 1e0) / (count(*) + 1e0) AS sp FROM t9 JOIN m9 ON m9.family = t9.family GROUP BY t9.family, st),
    mo AS (SELECT family, strategy_id, count(*) AS n, CASE WHEN stddev_samp(r) > 0 THEN any_value(mu) / stddev_samp(r) END AS sr, avg(pow(r - mu, 3)) / pow(avg(pow(r - mu, 2)), 1.5e0) AS skew, avg(pow(r - mu, 4)) / pow(avg(pow(r - mu, 2)), 2e0) AS kurt
      FROM (SELECT *, avg(r) OVER (PARTITION BY strategy_id) AS mu FROM v_fam) GROUP BY 1, 2),
    ff AS (SELECT family, count(sr) AS k, var_samp(sr * sqrt(12e0)) AS v, 1e0 - 1e0 / count(sr) AS q1, 1e0 - 1e0 / (count(sr) * exp(1e0)) AS q2 FROM mo GROUP BY 1),
    sf AS (SELECT family, CASE WHEN k < 2 THEN NULL WHEN v > 0 THEN sqrt(v) * ((1 - 0.5772156649015329e0) * {sqlmath.ppf('q1')} + 0.5772156649015329e0 * {sqlmath.ppf('q2')}) ELSE 0e0 END AS star FROM ff),
    vt AS (SELECT mo.*, star, 1 - skew * sr + (kurt - 1) / 4 * sr * sr AS vr FROM mo JOIN sf ON sf.family = mo.family),
    zs AS (SELECT family, strategy_id, CASE WHEN n >= 10 AND vr > 0 THEN (sr - star / sqrt(12e0)) * sqrt(n - 1) / sqrt(CASE WHEN vr > 0 THEN vr END) END AS zd,
      CASE WHEN n >= 10 AND vr > 0 THEN sr * sqrt(n - 1) / sqrt(CASE WHEN vr > 0 THEN vr END) END AS zp FROM vt),
    al AS (SELECT zs.family, zs.strategy_id, {sqlmath.cdf('zd')} AS dsr, {sqlmath.cdf('zp')} AS psr, lo AS lower, pp, sp FROM zs JOIN r ON r.strategy_id = zs.strategy_id
      JOIN p7 ON p7.strategy_id = zs.strategy_id JOIN s9 ON s9.family = zs.family),
    fl AS (SELECT *, list_filter([CASE WHEN NOT coalesce(dsr > 0.95, false) THEN 'deflated_sharpe' END, CASE WHEN NOT coalesce(psr > 0.95, false) THEN 'probabilistic_sharpe' END,
      CASE WHEN NOT coalesce(isfinite(lower) AND lower > 1, false) THEN 'bca_profit_factor' END,
      CASE WHEN NOT pp < 0.05 THEN 'permutation' END, CASE WHEN NOT sp < 0.05 THEN 'superiority' END], lambda g: g IS NOT NULL) AS failed FROM al)
    SELECT family, strategy_id, round(dsr, 6) AS dsr, round(psr, 6) AS psr, round(lower, 6) AS lower, round(pp, 6) AS permutation_p, round(sp, 6) AS superiority_p,
      array_to_string(failed, ',') AS failed_gates, len(failed) = 0 AS promoted FROM fl"""
)

QUERIES = {
    "R1_stationary_bootstrap": r1, "R2_moving_blocks": r2, "R3_fixed_blocks": r3, "R4_block_length": r4, "R5_block_ci_stationary_mean": r5a,
    "R5_block_ci_moving_profit_factor": r5b, "R5_block_ci_fixed_sharpe": r5c, "R6_bca_interval": r6, "R7_permutation_sign_flip": r7_sign,
    "R7_permutation_shuffle": r7_shuffle, "R7_permutation_block_shuffle": r7_block, "R8_T2_reality_check": r8, "R9_superior_ability": r9, "R10_stepdown": r10,
    "R11_U4_overfitting_probability": r11, "R12_walk_forward": r12, "R13_purged_folds": r13, "R14_survival": r14, "R15_survival_cap": r15,
    "R16_adjusted_p_values": r16, "R17_promotion": r17, "R5_block_ci_max_drawdown": r5_drawdown, "R11_max_drawdown_metric": r11_drawdown,
}

ORACLES = {
    "R1_stationary_bootstrap": R1_SQL, "R2_moving_blocks": R2_SQL, "R3_fixed_blocks": R3_SQL, "R4_block_length": R4_SQL, "R5_block_ci_stationary_mean": R5A_SQL,
    "R5_block_ci_moving_profit_factor": R5B_SQL, "R5_block_ci_fixed_sharpe": R5C_SQL, "R6_bca_interval": R6_SQL, "R7_permutation_sign_flip": R7A_SQL,
    "R7_permutation_shuffle": R7B_SQL, "R7_permutation_block_shuffle": R7C_SQL, "R8_T2_reality_check": R8_SQL, "R9_superior_ability": R9_SQL, "R10_stepdown": R10_SQL,
    "R11_U4_overfitting_probability": R11_SQL, "R12_walk_forward": R12_SQL, "R13_purged_folds": R13_SQL,
    "R14_survival": rsql("SELECT family, strategy_id, leverage::DOUBLE AS leverage, round(survival, 6) AS survival FROM v_surv"),
    "R15_survival_cap": rsql(f"""SELECT s.family, s.strategy_id, 6 + s.strategy_id % 6 AS base, coalesce(max(leverage::BIGINT) FILTER (survival >= {FLOOR} AND leverage <= 6 + s.strategy_id % 6), 0) AS cap
        FROM v_surv s GROUP BY 1, 2"""),
    "R16_adjusted_p_values": R16_SQL, "R17_promotion": R17_SQL, "R5_block_ci_max_drawdown": R5_DRAWDOWN_SQL, "R11_max_drawdown_metric": R11_DRAWDOWN_SQL,
}
