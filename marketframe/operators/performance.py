"""Per-strategy statistics: one grouped aggregation wherever possible, undefined values stay null."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normal import normal_cdf, normal_ppf
from ..session import cut_lineage
from .ordered import quantiles, segmented, trailing, value_ranks
from .rolls import month_of

EULER_GAMMA = 0.5772156649015329
PASS_LEVEL = 0.95
MIN_RELIABLE = 10


def _near_constant(lo: Column, hi: Column, mean: Column) -> Column:
    """All values within a relative 1e-9 (absolute 1e-12) of their mean, judged by the extremes."""
    close = lambda x: F.abs(x - mean) <= F.greatest(1e-9 * F.greatest(F.abs(x), F.abs(mean)), F.lit(1e-12))
    return close(lo) & close(hi)


def equity_returns(curves: DataFrame, key: str = "strategy_id", time: str = "d") -> DataFrame:
    """Returns of equity curves with a ruin latch: -1 on the first equity at or below zero, 0 after.

    The first row of a curve has no return and is dropped.
    """
    ruin = curves.groupBy(key).agg(F.min(F.when(F.col("equity") <= 0, F.col(time))).alias("__ruin"))
    e = segmented(curves, [key], [time], month_of(F.col(time)), {"__prev": ("lag", F.col("equity"))})
    e = e.join(ruin, key).filter("__prev IS NOT NULL")
    r = (
        F.when(F.col(time) > F.col("__ruin"), 0.0).when(F.col(time) == F.col("__ruin"), -1.0)
        .otherwise(F.col("equity") / F.when(F.col("__prev") > 0, F.col("__prev")) - 1.0)
    )
    return e.withColumn("r", r).drop("__prev", "__ruin")


def drawdowns(curves: DataFrame, key: str = "strategy_id", time: str = "d") -> DataFrame:
    """Relative distance from the running peak."""
    e = segmented(curves, [key], [time], month_of(F.col(time)), {"peak": ("max", F.col("equity"))})
    return e.withColumn("drawdown", (F.col("peak") - F.col("equity")) / F.col("peak"))


def performance(curves: DataFrame, periods_per_year: float, risk_free: float = 0.0, key: str = "strategy_id", time: str = "d") -> DataFrame:
    """Total and annual return, volatility, Sharpe, drawdown and Calmar of positive equity curves."""
    ok = F.when(F.col("equity") <= 0, F.raise_error(F.lit("equity must stay positive"))).otherwise(F.lit(True))
    e = segmented(curves.filter(ok), [key], [time], month_of(F.col(time)), {
        "peak": ("max", F.col("equity")), "prev": ("lag", F.col("equity")),
    })
    e = e.withColumns({"r": F.col("equity") / F.col("prev") - 1.0, "dd": (F.col("peak") - F.col("equity")) / F.col("peak")})
    g = e.groupBy(key).agg(
        F.count("r").alias("n_periods"), F.min_by("equity", time).alias("first"), F.max_by("equity", time).alias("last"),
        F.max("dd").alias("max_drawdown"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.min("r").alias("lo"), F.max("r").alias("hi"),
    )
    flat = _near_constant(F.col("lo"), F.col("hi"), F.col("mean"))
    ppy = F.lit(float(periods_per_year))
    annual = F.pow(F.col("last") / F.col("first"), ppy / F.col("n_periods")) - 1.0
    enough = F.col("n_periods") >= 2
    return g.select(
        key, "n_periods", (F.col("last") / F.col("first") - 1.0).alias("total_return"), annual.alias("annual_return"),
        F.when(enough & flat, 0.0).when(enough, F.col("sd") * F.sqrt(ppy)).alias("volatility"),
        F.when(enough & ~flat, (F.col("mean") - risk_free / float(periods_per_year)) / F.col("sd") * F.sqrt(ppy)).alias("sharpe"),
        "max_drawdown", F.when(F.col("max_drawdown") > 0, annual / F.col("max_drawdown")).alias("calmar"),
    )


def trade_metrics(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts, averages, payoff, expectancy, profit factor and skew of closed trades (column ``pnl``)."""
    p = F.col("pnl").cast("double")
    wins, losses = F.sum(F.when(p > 0, p)), -F.sum(F.when(p < 0, p))
    g = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"), F.count_if(p > 0).alias("n_wins"), F.count_if(p < 0).alias("n_losses"),
        wins.alias("w"), losses.alias("l"), F.avg(p).alias("expectancy"), F.skewness(p).alias("sk"), F.var_pop(p).alias("vp"),
    )
    n, nw, nl = F.col("n_trades"), F.col("n_wins"), F.col("n_losses")
    avg_win, avg_loss = F.when(nw > 0, F.col("w") / nw), F.when(nl > 0, F.col("l") / nl)
    return g.select(
        *keys, "n_trades", "n_wins", "n_losses", (n - nw - nl).alias("n_scratch"), (nw / n).alias("win_rate"),
        avg_win.alias("avg_win"), avg_loss.alias("avg_loss"), (avg_win / avg_loss).alias("payoff"), "expectancy",
        F.when(F.col("l") > 0, F.coalesce("w", F.lit(0.0)) / F.col("l")).alias("profit_factor"),
        F.when((n >= 3) & (F.col("vp") > 0), F.col("sk")).alias("pnl_skew"),
    )


def sharpe_moments(returns: DataFrame, keys: Sequence[str], r: str = "r") -> DataFrame:
    """n, per-period Sharpe, population skew and raw kurtosis; null without variance."""
    x = F.col(r)
    g = returns.groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.skewness(x).alias("sk"), F.kurtosis(x).alias("ku"),
    )
    ok = (F.col("n") >= 2) & (F.col("sd") > 0)
    return g.select(
        *keys, "n", F.when(ok, F.col("mean") / F.col("sd")).alias("sr"), F.when(ok, F.col("sk")).alias("skew"),
        F.when(ok, F.col("ku") + 3.0).alias("kurt"),
    )


def _variance_term(sr: Column, skew: Column, kurt: Column) -> Column:
    return 1.0 - skew * sr + (kurt - 1.0) / 4.0 * sr * sr


def psr_score(sr: Column, benchmark: Column, n: Column, skew: Column, kurt: Column) -> Column:
    """Normal score of the event that the true Sharpe exceeds a per-period benchmark."""
    var = _variance_term(sr, skew, kurt)
    return (sr - benchmark) * F.sqrt((n - 1).cast("double")) / F.sqrt(F.when(var > 0, var))


def probabilistic_sharpe(moments: DataFrame, periods_per_year: float, threshold: Column | float = 0.0) -> DataFrame:
    """Add ``psr``, annual Sharpe, pass flag and the reason when undefined. ``threshold`` is annual."""
    ppy = float(periods_per_year)
    t = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    enough = F.col("n") >= MIN_RELIABLE
    # the score gets a column of its own: the rational functions name their argument many times
    moments = moments.withColumn("__z", psr_score(F.col("sr"), t / ppy**0.5, F.col("n"), F.col("skew"), F.col("kurt")))
    moments = moments.withColumn("psr", F.when(enough, normal_cdf(F.col("__z")))).drop("__z")
    psr = F.col("psr")
    reason = (
        F.when(F.col("sr").isNull(), "no variance").when(~enough, "too few observations")
        .when(_variance_term(F.col("sr"), F.col("skew"), F.col("kurt")) <= 0, "variance term not positive")
    )
    return moments.withColumns({
        "sr_annual": F.col("sr") * ppy**0.5, "passes": F.coalesce(psr > PASS_LEVEL, F.lit(False)), "reason": reason,
    })


def min_track_record(moments: DataFrame, benchmark: float = 0.0, alpha: float = 0.05) -> DataFrame:
    """Observations needed before the Sharpe beats a per-period benchmark with confidence."""
    sr = F.col("sr")
    var = _variance_term(sr, F.col("skew"), F.col("kurt"))
    z = F.lit(NormalDist().inv_cdf(1.0 - alpha))
    edge = F.when((sr > benchmark) & (var > 0), sr - benchmark)
    return moments.withColumn("min_length", 1.0 + var * F.pow(z / edge, 2))


def expected_max_sharpe(families: DataFrame, n: str, variance: str, out: str) -> DataFrame:
    """Expected best Sharpe of n trials without skill; 0 for one trial or no variance."""
    nn = F.when(F.col(n) >= 2, F.col(n).cast("double"))
    f = families.withColumns({"__p1": 1.0 - 1.0 / nn, "__p2": 1.0 - 1.0 / (nn * F.exp(F.lit(1.0)))})
    f = f.withColumns({"__q1": normal_ppf(F.col("__p1")), "__q2": normal_ppf(F.col("__p2"))})
    best = F.sqrt(variance) * ((1.0 - EULER_GAMMA) * F.col("__q1") + EULER_GAMMA * F.col("__q2"))
    none = (F.col(n) < 2) | F.coalesce(F.col(variance) <= 0, F.lit(True))
    return f.withColumn(out, F.when(none, F.lit(0.0)).otherwise(best)).drop("__p1", "__p2", "__q1", "__q2")


def deflated_sharpe(moments: DataFrame, trials: DataFrame, family: Sequence[str], periods_per_year: float) -> DataFrame:
    """Probabilistic Sharpe against the expected best of the family's trials (annual Sharpes ``sr_trial``)."""
    t = F.col("sr_trial")
    finite = t.isNotNull() & ~F.isnan(t) & (F.abs(t) < float("inf"))
    fam = trials.filter(finite).groupBy(*family).agg(F.count(F.lit(1)).alias("n_trials"), F.var_samp(t).alias("trial_var"))
    fam = expected_max_sharpe(fam, "n_trials", "trial_var", "sr_star")
    m = moments.join(fam, list(family), "left").withColumn("n_trials", F.coalesce("n_trials", F.lit(0)))
    m = m.withColumn("sr_star", F.when(F.col("n_trials") >= 2, F.col("sr_star")))
    out = probabilistic_sharpe(m, periods_per_year, F.col("sr_star"))
    return out.withColumnRenamed("psr", "dsr").withColumn(
        "reason", F.when(F.col("n_trials") < 2, "too few trials").otherwise(F.col("reason"))
    )


def autocovariances(series: DataFrame, key: str, position: str, max_lag: Column, x: str = "x") -> DataFrame:
    """(key, lag, cov) for lags 0 to ``max_lag``: sums of products over n, of a centred dense series.

    Each row is copied once per lag to the position it meets; the join key (key, position, ...) is
    unique on one side, so a long series spreads over all tasks.
    """
    ahead = series.withColumn("lag", F.explode(F.sequence(F.lit(0), max_lag.cast("int")))).select(
        key, (F.col(position) + F.col("lag")).alias(position), "lag", F.col(x).alias("__past")
    )
    pairs = series.select(key, position, x, "n").join(ahead, [key, position])
    return pairs.groupBy(key, "lag").agg((F.sum(F.col(x) * F.col("__past")) / F.max("n")).alias("cov"))


def centred(returns: DataFrame, key: str, r: str = "r") -> DataFrame:
    stats = returns.groupBy(key).agg(F.avg(r).alias("__m"), F.count(r).alias("n"))
    return returns.join(stats, key).withColumn("x", F.col(r) - F.col("__m")).drop("__m")


def lo_factor(returns: DataFrame, q: int, key: str = "strategy_id", position: str = "i") -> DataFrame:
    """Annualisation factor corrected for serial correlation (Lo 2002), with a capped lag count."""
    c = centred(returns, key)
    cap = F.greatest(F.lit(1), F.floor(4.0 * F.pow(F.col("n") / 100.0, F.lit(2.0 / 9.0))))
    lags = F.least(F.lit(q - 1), F.col("n") - 1, cap)
    cov = autocovariances(c, key, position, lags)
    g = cov.groupBy(key).agg(
        F.max(F.when(F.col("lag") == 0, F.col("cov"))).alias("var"),
        F.sum(F.when(F.col("lag") > 0, (q - F.col("lag")) * F.col("cov"))).alias("s"),
    )
    denom = F.lit(float(q)) + 2.0 * F.coalesce(F.col("s"), F.lit(0.0)) / F.when(F.col("var") > 0, F.col("var"))
    return g.select(key, F.when(denom > 0, F.lit(float(q)) / F.sqrt(F.when(denom > 0, denom))).alias("eta"))


def lag_one(returns: DataFrame, key: str = "strategy_id", position: str = "i") -> DataFrame:
    """Lag-1 autocorrelation and whether it leaves the band of 2/sqrt(n)."""
    c = centred(returns, key)
    cov = autocovariances(c, key, position, F.lit(1))
    g = cov.groupBy(key).agg(
        F.max(F.when(F.col("lag") == 0, F.col("cov"))).alias("v"), F.max(F.when(F.col("lag") == 1, F.col("cov"))).alias("c"),
    ).join(returns.groupBy(key).agg(F.count("r").alias("n")), key)
    rho = F.when((F.col("n") >= 3) & (F.col("v") > 0), F.col("c") / F.col("v"))
    return g.select(key, "n", rho.alias("lag1"), F.coalesce(F.abs(rho) > 2.0 / F.sqrt(F.col("n").cast("double")), F.lit(False)).alias("warning"))


def _annual(r: str, ppy: float) -> Column:
    sd = F.stddev_samp(r)
    return F.when((F.count(r) >= 2) & (sd > 0), F.avg(r) / F.when(sd > 0, sd) * ppy**0.5)


def winsorised_sharpe(returns: DataFrame, keys: Sequence[str], trim: float, periods_per_year: float, r: str = "r") -> DataFrame:
    """Annual Sharpe after capping the int(trim * n) lowest and highest returns."""
    keys = list(keys)
    ranks = value_ranks(returns, keys, r)
    k = F.floor(F.lit(trim) * F.col("n"))
    lo, hi = F.col("hi") - F.col("cnt"), F.col("hi")
    at = lambda pos: F.max(F.when((pos >= lo) & (pos < hi), F.col(r)))
    caps = ranks.groupBy(*keys).agg(at(k).alias("__lo"), at(F.col("n") - 1 - k).alias("__hi"))
    capped = returns.join(caps, keys).withColumn("__w", F.least(F.greatest(F.col(r), F.col("__lo")), F.col("__hi")))
    return capped.groupBy(*keys).agg(_annual(r, periods_per_year).alias("sharpe"), _annual("__w", periods_per_year).alias("sharpe_winsorised"))


def tail_contribution(returns: DataFrame, keys: Sequence[str], share: float, r: str = "r") -> DataFrame:
    """Share of total absolute return that comes from the largest max(1, int(share * n)) moves."""
    ranks = value_ranks(returns.withColumn("__a", F.abs(r)), list(keys), "__a")
    k = F.greatest(F.lit(1), F.floor(F.lit(share) * F.col("n")))
    top = F.greatest(F.lit(0), F.col("hi") - F.greatest(F.col("hi") - F.col("cnt"), F.col("n") - k))
    total = F.sum(F.col("__a") * F.col("cnt"))
    return ranks.groupBy(*keys).agg(F.when(total > 0, F.sum(F.col("__a") * top) / F.when(total > 0, total)).otherwise(0.0).alias("tail_share"))


def skew_without_extremes(returns: DataFrame, key: str, position: str, drop: int, r: str = "r") -> DataFrame:
    """Skew with and without the ``drop`` values farthest from the mean; earlier rows go first on ties."""
    mean = returns.groupBy(key).agg(F.avg(r).alias("__m"))
    d = returns.join(mean, key).withColumn("__far", F.abs(F.col(r) - F.col("__m")))
    far = Window.partitionBy(key).orderBy(F.col("__far").desc(), position)
    worst = d.withColumn("__rn", F.row_number().over(far)).filter(F.col("__rn") <= drop).select(key, position)
    kept = d.join(worst, [key, position], "left_anti")
    full = sharpe_moments(returns, [key], r).select(key, "skew")
    return full.join(sharpe_moments(kept, [key], r).select(key, F.col("skew").alias("skew_trimmed")), key)


def quantile_skew(returns: DataFrame, keys: Sequence[str], tail: float = 0.05, r: str = "r") -> DataFrame:
    q = quantiles(value_ranks(returns, list(keys), r), list(keys), r, {"lo": F.lit(tail), "mid": F.lit(0.5), "hi": F.lit(1.0 - tail)})
    spread = F.col("hi") - F.col("lo")
    return q.withColumn("quantile_skew", F.when(spread > 0, (F.col("hi") + F.col("lo") - 2.0 * F.col("mid")) / F.when(spread > 0, spread)))


def tail_means(returns: DataFrame, keys: Sequence[str], tail: float = 0.05, r: str = "r") -> DataFrame:
    """Means of the ceil(tail * n) worst and best returns and the ratio of their sizes."""
    ranks = value_ranks(returns, list(keys), r)
    k = F.greatest(F.lit(1), F.ceil(F.round(F.lit(tail) * F.col("n"), 9)))
    lo, hi = F.col("hi") - F.col("cnt"), F.col("hi")
    low = F.greatest(F.lit(0), F.least(hi, k) - lo)
    top = F.greatest(F.lit(0), hi - F.greatest(lo, F.col("n") - k))
    g = ranks.groupBy(*keys).agg(
        (F.sum(F.col(r) * low) / F.max(k)).alias("left_mean"), (F.sum(F.col(r) * top) / F.max(k)).alias("right_mean"), F.max(k).alias("n_tail")
    )
    size = F.abs("left_mean")
    return g.withColumn("ratio", F.when(size > 0, F.col("right_mean") / F.when(size > 0, size)).when(F.col("right_mean") > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan"))))


def profit_factor(gains: Column, losses: Column) -> Column:
    """Gains over losses: infinite without losses, NaN without either."""
    return F.when(losses > 0, gains / F.when(losses > 0, losses)).when(gains > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))


def profit_factors(returns: DataFrame, keys: Sequence[str], r: str = "r") -> DataFrame:
    g = F.sum(F.when(F.col(r) > 0, F.col(r)).otherwise(0.0))
    lo = F.sum(F.when(F.col(r) < 0, -F.col(r)).otherwise(0.0))
    return returns.groupBy(*keys).agg(g.alias("gains"), lo.alias("losses")).withColumn("profit_factor", profit_factor(F.col("gains"), F.col("losses")))


def trailing_sharpe(returns: DataFrame, key: str, time: str, rows: int, periods_per_year: float, r: str = "r") -> DataFrame:
    """Sharpe over the last ``rows`` rows at every row."""
    n = segmented(returns, [key], [time], month_of(F.col(time)), {"n": ("row_number", None)})
    t = trailing(n, [key], "n", rows, {"__c": F.count(r), "__m": F.avg(r), "__s": F.stddev_samp(r)})
    sr = F.when((F.col("__c") >= 2) & (F.col("__s") > 0), F.col("__m") / F.when(F.col("__s") > 0, F.col("__s")) * periods_per_year**0.5)
    return t.withColumn("trailing_sharpe", sr).drop("__c", "__m", "__s")


def decay_verdicts(sessions: DataFrame, key: str = "strategy_id", time: str = "d", periods_per_year: float = 252.0,
                   window: int = 63, warm_up: int = 21) -> DataFrame:
    """Health of each sleeve from its session profits (decimal column ``pnl``)."""
    run = cut_lineage(segmented(sessions, [key], [time], month_of(F.col(time)), {"cum": ("sum", F.col("pnl"))}), "cum")
    zero = F.lit(0).cast("decimal(38,10)")
    run = segmented(run, [key], [time], month_of(F.col(time)), {"__peak": ("max", F.greatest(F.col("cum"), zero))})
    pnl = F.col("pnl").cast("double")
    g = run.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_sessions"), F.sum("pnl").alias("cumulative"), F.avg(pnl).alias("m"), F.stddev_samp(pnl).alias("s"),
        F.max(F.col("__peak") - F.col("cum")).alias("max_drawdown"),
    )
    last = Window.partitionBy(key).orderBy(F.col(time).desc())
    recent = sessions.withColumn("__rn", F.row_number().over(last)).filter(F.col("__rn") <= window)
    rec = recent.groupBy(key).agg(F.avg(pnl).alias("rm"), F.stddev_samp(pnl).alias("rs"))
    g = g.join(rec, key)
    sharpe = lambda m, s: F.when(F.col(s) > 0, F.col(m) / F.when(F.col(s) > 0, F.col(s)) * periods_per_year**0.5)
    g = g.withColumns({"full_sharpe": sharpe("m", "s"), "rolling_sharpe": sharpe("rm", "rs")})
    verdict = (
        F.when(F.col("n_sessions") < warm_up, "warming_up")
        .when((F.col("cumulative") <= 0) | F.coalesce(F.col("rolling_sharpe") <= 0, F.lit(False)), "decayed").otherwise("healthy")
    )
    return g.select(key, "n_sessions", "cumulative", "full_sharpe", "rolling_sharpe", "max_drawdown", verdict.alias("verdict"))


def sleeve_summaries(sessions: DataFrame, key: str = "strategy_id", time: str = "d", window: int = 63) -> DataFrame:
    """One mergeable row per sleeve of what its verdict needs: count, moments, running total with its highest, lowest
    and largest fall, and the last ``window`` sessions (a parameter bounds that array)."""
    pnl = F.col("pnl").cast("double")
    run = cut_lineage(segmented(sessions, [key], [time], month_of(F.col(time)), {"cum": ("sum", F.col("pnl"))}), "cum")
    run = segmented(run, [key], [time], month_of(F.col(time)), {"__high": ("max", F.col("cum"))})
    money = "decimal(38,10)"
    g = run.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.avg(pnl).alias("mean"), (F.var_pop(pnl) * F.count(F.lit(1))).alias("m2"), F.sum("pnl").cast(money).alias("total"),
        F.max("cum").cast(money).alias("high"), F.min("cum").cast(money).alias("low"), F.max(F.col("__high") - F.col("cum")).cast(money).alias("fall"),
        F.max(time).alias("until"),
    )
    last = Window.partitionBy(key).orderBy(F.col(time).desc())
    recent = sessions.withColumn("__rn", F.row_number().over(last)).filter(F.col("__rn") <= window)
    ring = recent.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(time).alias("at"), pnl.alias("pnl")))).alias("ring"))
    return g.join(ring, key)


def merge_summaries(before: DataFrame, after: DataFrame, key: str = "strategy_id", window: int = 63) -> DataFrame:
    """Summaries of earlier and later sessions as one; a sleeve may be in either table alone."""
    fields = [c for c in before.columns if c != key]
    a = before.select(key, F.struct(*fields).alias("a"))
    b = after.select(key, F.struct(*fields).alias("b"))
    j = a.join(b, key, "full_outer")
    n = F.col("a.n") + F.col("b.n")
    step = F.col("b.mean") - F.col("a.mean")
    joint = F.struct(
        n.alias("n"), (F.col("a.mean") + step * F.col("b.n") / n).alias("mean"), (F.col("a.m2") + F.col("b.m2") + step * step * F.col("a.n") * F.col("b.n") / n).alias("m2"),
        (F.col("a.total") + F.col("b.total")).cast("decimal(38,10)").alias("total"), F.greatest("a.high", F.col("a.total") + F.col("b.high")).cast("decimal(38,10)").alias("high"),
        F.least("a.low", F.col("a.total") + F.col("b.low")).cast("decimal(38,10)").alias("low"),
        F.greatest("a.fall", "b.fall", F.col("a.high") - F.col("a.total") - F.col("b.low")).cast("decimal(38,10)").alias("fall"),
        F.greatest("a.until", "b.until").alias("until"), F.slice(F.concat("a.ring", "b.ring"), F.greatest(F.size("a.ring") + F.size("b.ring") - window, F.lit(0)) + 1, F.lit(window)).alias("ring"),
    )
    whole = F.when(F.col("a").isNull(), F.col("b")).when(F.col("b").isNull(), F.col("a")).otherwise(joint)
    return j.select(key, whole.alias("s")).select(key, *[F.col(f"s.{c}").alias(c) for c in fields])


def summary_verdicts(summaries: DataFrame, key: str = "strategy_id", periods_per_year: float = 252.0, warm_up: int = 21) -> DataFrame:
    """``decay_verdicts`` from summaries."""
    size = F.size("ring")
    rm = F.aggregate("ring", F.lit(0.0), lambda x, r: x + r["pnl"]) / size
    s = summaries.withColumn("__rm", rm)
    rv = F.aggregate("ring", F.lit(0.0), lambda x, r: x + (r["pnl"] - F.col("__rm")) * (r["pnl"] - F.col("__rm")))
    s = s.withColumns({"__rs": F.when(size > 1, F.sqrt(rv / F.when(size > 1, size - 1))), "__s": F.when(F.col("n") > 1, F.sqrt(F.col("m2") / F.when(F.col("n") > 1, F.col("n") - 1)))})
    sharpe = lambda m, d: F.when(F.col(d) > 0, F.col(m) / F.when(F.col(d) > 0, F.col(d)) * periods_per_year**0.5)
    s = s.withColumns({"full_sharpe": sharpe("mean", "__s"), "rolling_sharpe": sharpe("__rm", "__rs")})
    zero = F.lit(0).cast("decimal(38,10)")
    verdict = F.when(F.col("n") < warm_up, "warming_up").when((F.col("total") <= 0) | F.coalesce(F.col("rolling_sharpe") <= 0, F.lit(False)), "decayed").otherwise("healthy")
    return s.select(key, F.col("n").alias("n_sessions"), F.col("total").alias("cumulative"), "full_sharpe", "rolling_sharpe", F.greatest("fall", zero - F.col("low"), zero).alias("max_drawdown"), verdict.alias("verdict"))


def family_from_curves(curves: DataFrame, periods_per_year: float, key: str = "strategy_id", time: str = "d", strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Returns and trial Sharpes of a family of curves of equal length; a constant curve has Sharpe 0."""
    rets = equity_returns(curves, key, time)
    g = rets.groupBy(key).agg(F.count("r").alias("n"), F.avg("r").alias("m"), F.stddev_samp("r").alias("s"), F.min("r").alias("lo"), F.max("r").alias("hi"))
    if strict:
        sizes = g.agg(F.count_distinct("n").alias("__sizes")).withColumn("__k", F.lit(1))
        same = F.when(F.col("__sizes") > 1, F.raise_error(F.lit("curves differ in length"))).otherwise(F.lit(True))
        g = g.withColumn("__k", F.lit(1)).join(F.broadcast(sizes), "__k").filter(same).drop("__k", "__sizes")
    flat = _near_constant(F.col("lo"), F.col("hi"), F.col("m")) | (F.col("n") < 2)
    trial = F.when(flat, 0.0).otherwise(F.col("m") / F.col("s") * periods_per_year**0.5)
    return rets, g.select(key, "n", trial.alias("sr_trial"))


def net_of_cost(returns: DataFrame, cost: float, r: str = "r", traded: str = "traded") -> DataFrame:
    if cost < 0:
        raise ValueError("cost must not be negative")
    return returns.withColumn("net_r", F.when(F.col(traded), F.col(r) - cost).otherwise(F.col(r)))


def periods_per_year(table: DataFrame, resolution: str = "resolution", hours: str = "hours", sessions: str = "sessions") -> DataFrame:
    """Observations per year: sessions times hours times bars per hour; once per session for daily bars."""
    from ..dims import BARS_PER_HOUR, ONE_PER_SESSION

    rate = F.lit(None).cast("double")
    for name, per_hour in BARS_PER_HOUR:
        rate = F.when(F.col(resolution) == name, per_hour).otherwise(rate)
    daily = F.col(resolution).isin(ONE_PER_SESSION)
    known = F.when(daily, F.col(sessions).cast("double")).otherwise(F.col(sessions) * F.col(hours) * rate)
    bad = (F.col(hours) <= 0) | (F.col(sessions) <= 0) | known.isNull()
    return table.withColumn("periods_per_year", F.when(bad, F.raise_error(F.lit("no annual factor")).cast("double")).otherwise(known))
