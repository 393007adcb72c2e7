"""Bootstrap, permutation and survival jobs over return panels.

A panel is a long table (family, strategy, position ``i``, ``r``), dense per family. Draws come from a
counter generator and are shared by all strategies of a family, as in the published family-wise
tests. The draw number ``b`` is the parallel axis: every draw has the same size, so nothing is skewed,
and statistics that are sums need only how often each position was drawn.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normal import normal_cdf, normal_ppf
from ..functions.rng import pick, uniform
from ..session import cut_lineage, spread
from .ordered import quantiles, segmented, value_bucket, value_ranks
from .mergeable import Statistic, draw_states, series_states
from .performance import autocovariances, centred, profit_factor

MIN_DRAWS = 1000
PIECE = 8  # returns of a resampled path that travel together
RANKS = 4096  # ranks handled together in one ordered segment


def family_sizes(panel: DataFrame, strict: bool = True) -> DataFrame:
    """(family, n, strategies); every strategy of a family must have every position."""
    g = panel.groupBy("family").agg(
        (F.max("i") + 1).alias("n"), F.count(F.lit(1)).alias("__rows"), F.count_distinct("strategy_id").alias("strategies"),
        F.count_if(F.isnan("r") | (F.abs("r") == float("inf")) | F.col("r").isNull()).alias("__bad"),
    )
    if strict:
        dense = (F.col("__rows") == F.col("n") * F.col("strategies")) & (F.col("__bad") == 0) & (F.col("n") >= 2)
        g = g.filter(F.when(~dense, F.raise_error(F.lit("panel is not dense and finite"))).otherwise(F.lit(True)))
    return g.select("family", "n", "strategies")


def _counters(sizes: DataFrame, draws: int, length: Column) -> DataFrame:
    """One row per family, draw and step; draws are spread over tasks before steps are generated."""
    b = spread(sizes.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))), "family", "b")
    return b.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), (length - 1).cast("long"))))


def stationary_indices(sizes: DataFrame, draws: int, block: int | Column, seed: int, length: Column | None = None) -> DataFrame:
    """Stationary bootstrap: a new block starts with probability 1/block, else the next position."""
    n = F.col("n")
    block = F.lit(block) if isinstance(block, int) else block
    d = _counters(sizes, draws, n if length is None else length)
    fresh = (F.col("step") == 0) | (uniform("sb", seed, F.col("b"), F.col("step")) < 1.0 / block)
    start = F.when(fresh, F.struct(F.col("step").alias("s0"), pick(uniform("sb", seed, F.col("b"), F.col("step"), slot=1), n).alias("p0")))
    d = d.withColumn("__start", start)
    w = Window.partitionBy("family", "b").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__from", F.last("__start", ignorenulls=True).over(w))
    idx = (F.col("__from.p0") + F.col("step") - F.col("__from.s0")) % n
    return d.select("family", "b", "step", idx.alias("i"))


def moving_indices(sizes: DataFrame, draws: int, block: int, seed: int) -> DataFrame:
    """Circular blocks of fixed length, one random start per block."""
    d = _counters(sizes, draws, F.col("n"))
    blk = F.floor(F.col("step") / block)
    start = pick(uniform("mb", seed, F.col("b"), blk), F.col("n"))
    return d.select("family", "b", "step", ((start + F.col("step") % block) % F.col("n")).alias("i"))


def fixed_indices(sizes: DataFrame, draws: int, block: int, seed: int) -> DataFrame:
    """Disjoint blocks drawn whole (the last one may be short), trimmed to n."""
    n = F.col("n")
    blocks = F.ceil(n / block)
    # a short last block means more draws may be needed; n draws always suffice
    d = spread(sizes.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))), "family", "b")
    d = d.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    which = pick(uniform("fb", seed, F.col("b"), F.col("k")), blocks)
    first = which * block
    d = d.withColumns({"first": first, "len": F.least(F.lit(block), n - first)})
    w = Window.partitionBy("family", "b").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__end", F.sum("len").over(w)).withColumn("__at", F.col("__end") - F.col("len")).filter("__at < n")
    d = d.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("len") - 1)))
    out = d.select("family", "b", "n", (F.col("__at") + F.col("j")).alias("step"), (F.col("first") + F.col("j")).alias("i"))
    return out.filter("step < n").drop("n")


def stationary_blocks(sizes: DataFrame, draws: int, block: int | Column, seed: int, length: Column | None = None) -> DataFrame:
    """The draws of ``stationary_indices`` as circular runs (family, b, step, first, len): one row per block."""
    n = F.col("n")
    block = F.lit(block) if isinstance(block, int) else block
    end = (n if length is None else length).cast("long")
    d = _counters(sizes, draws, end)
    d = d.filter((F.col("step") == 0) | (uniform("sb", seed, F.col("b"), F.col("step")) < 1.0 / block))
    d = d.withColumn("first", pick(uniform("sb", seed, F.col("b"), F.col("step"), slot=1), n))
    w = Window.partitionBy("family", "b").orderBy("step")
    return d.select("family", "n", "b", "step", "first", (F.coalesce(F.lead("step").over(w), end) - F.col("step")).alias("len"))


def moving_blocks(sizes: DataFrame, draws: int, block: int, seed: int) -> DataFrame:
    """The draws of ``moving_indices`` as circular runs."""
    d = _counters(sizes, draws, F.ceil(F.col("n") / block)).withColumnRenamed("step", "k")
    start = pick(uniform("mb", seed, F.col("b"), F.col("k")), F.col("n"))
    return d.select("family", "n", "b", (F.col("k") * block).alias("step"), start.alias("first"), F.least(F.lit(block), F.col("n") - F.col("k") * block).cast("long").alias("len"))


def fixed_blocks(sizes: DataFrame, draws: int, block: int, seed: int) -> DataFrame:
    """The draws of ``fixed_indices`` as runs, trimmed to n in all.

    A short last block is the only one that adds less than ``block``; a few more draws than n / block, found
    by what is missing, would do, but n draws always suffice and only those before n is reached are kept.
    """
    n = F.col("n")
    d = _counters(sizes, draws, n).withColumnRenamed("step", "k")
    first = pick(uniform("fb", seed, F.col("b"), F.col("k")), F.ceil(n / block)) * block
    d = d.withColumns({"first": first, "__len": F.least(F.lit(block), n - first)})
    w = Window.partitionBy("family", "b").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("step", F.sum("__len").over(w) - F.col("__len")).filter("step < n")
    return d.select("family", "n", "b", "step", "first", F.least(F.col("__len"), n - F.col("step")).cast("long").alias("len"))


def independent_indices(sizes: DataFrame, draws: int, seed: int) -> DataFrame:
    d = _counters(sizes, draws, F.col("n"))
    return d.select("family", "b", "step", pick(uniform("iid", seed, F.col("b"), F.col("step")), F.col("n")).alias("i"))


#: Sums are exact decimals: a difference of two prefix sums is what adding up the rows in between gives, and a draw
#: that takes the same returns in another order has the same statistic, not one that differs by rounding.
EXACT = "decimal(28,18)"


def draw_sums(panel: DataFrame, indices: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Per (family, b, strategy): sums of row expressions over the drawn positions.

    A position drawn c times counts c times, so the join carries distinct positions only, and the
    partial sums are formed where a draw lives.
    """
    counts = indices.groupBy("family", "b", "i").agg(F.count(F.lit(1)).cast("decimal(9,0)").alias("c"))
    vals = panel.select("family", "strategy_id", "i", *[c.cast(EXACT).alias(n) for n, c in sums.items()])
    j = counts.join(vals, ["family", "i"])
    return j.groupBy("family", "b", "strategy_id").agg(*[F.sum(F.col(n) * F.col("c")).cast("double").alias(n) for n in sums])


def prefix_sums(panel: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """(family, strategy_id, at, sums...): sums of row expressions over all positions before ``at`` (from 1)."""
    vals = panel.select("family", "strategy_id", "i", *[c.cast(EXACT).alias(f"__x_{n}") for n, c in sums.items()])
    run = segmented(vals, ["family", "strategy_id"], ["i"], F.floor(F.col("i") / RANKS), {n: ("sum", F.col(f"__x_{n}")) for n in sums})
    return run.select("family", "strategy_id", (F.col("i") + 1).alias("at"), *sums)


def block_sums(panel: DataFrame, blocks: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """``draw_sums`` for draws given as circular runs: a run is two prefix sums, or three where it wraps.

    What is joined and shuffled is a draw's runs, not its positions: fewer by about the block length. A run
    may be no longer than the series.
    """
    end = F.col("first") + F.col("len")
    edge = lambda at, plus: F.struct(at.cast("long").alias("at"), F.lit(plus).alias("plus"))
    edges = F.array(edge(F.col("first"), False), edge(F.least(end, F.col("n")), True), edge(F.greatest(end - F.col("n"), F.lit(0)), True))
    e = blocks.select("family", "b", F.explode(edges).alias("e")).select("family", "b", "e.*").filter("at > 0")
    j = e.join(cut_lineage(prefix_sums(panel, sums), "prefix"), ["family", "at"])
    return j.groupBy("family", "b", "strategy_id").agg(*[F.sum(F.when(F.col("plus"), F.col(n)).otherwise(-F.col(n))).cast("double").alias(n) for n in sums])


def draw_means(panel: DataFrame, draws: int, block: int, seed: int) -> DataFrame:
    """Bootstrap means of every strategy: the table shared by the three family-wise tests."""
    sizes = family_sizes(panel)
    s = block_sums(panel, stationary_blocks(sizes, draws, block, seed), {"s": F.col("r")})
    return s.join(sizes.select("family", "n"), "family").select("family", "b", "strategy_id", (F.col("s") / F.col("n")).alias("dstar"))


def differentials(panel: DataFrame, benchmark: DataFrame | None = None) -> DataFrame:
    """Returns minus the benchmark's return at the same position."""
    if benchmark is None:
        return panel
    b = benchmark.select("family", "i", F.col("r").alias("__b"))
    return panel.join(b, ["family", "i"], "left").withColumn("r", F.col("r") - F.col("__b")).drop("__b")


def _observed(panel: DataFrame) -> DataFrame:
    return panel.groupBy("family", "strategy_id").agg(F.avg("r").alias("dbar"), F.count("r").alias("n"))


def reality_check(panel: DataFrame, means: DataFrame) -> DataFrame:
    """Does the best strategy beat the benchmark? Compares its root-n mean with the recentred maximum."""
    obs = _observed(panel)
    top = obs.groupBy("family").agg(
        F.max("dbar").alias("max_differential"), F.max_by("strategy_id", F.struct("dbar", -F.col("strategy_id"))).alias("best"),
        F.count(F.lit(1)).alias("strategies"), F.max("n").alias("n"),
    )
    boot = means.join(obs, ["family", "strategy_id"]).groupBy("family", "b").agg(F.max(F.col("dstar") - F.col("dbar")).alias("m"))
    hits = boot.join(top, "family").groupBy("family").agg(
        F.count_if(F.sqrt("n") * F.col("m") >= F.sqrt("n") * F.col("max_differential")).alias("c"), F.count(F.lit(1)).alias("draws")
    )
    p = (F.col("c") + 1) / (F.col("draws") + 1)
    return top.join(hits, "family").select("family", "best", "max_differential", "strategies", "n", "draws", p.alias("p_value"))


def studentised(panel: DataFrame, means: DataFrame) -> DataFrame:
    """Per strategy: mean, bootstrap scale omega and t; a strategy without spread gets t = 0."""
    obs = _observed(panel)
    dev = F.sqrt("n") * (F.col("dstar") - F.col("dbar"))
    om = means.join(obs, ["family", "strategy_id"]).groupBy("family", "strategy_id").agg(F.sqrt(F.avg(dev * dev)).alias("omega"))
    s = obs.join(om, ["family", "strategy_id"])
    return s.withColumn("t", F.when(F.col("omega") > 0, F.sqrt("n") * F.col("dbar") / F.when(F.col("omega") > 0, F.col("omega"))).otherwise(0.0))


def superior_ability(panel: DataFrame, means: DataFrame) -> DataFrame:
    """Hansen's consistent test: studentised, and clearly poor strategies are not recentred."""
    s = studentised(panel, means)
    tau = F.sqrt(2.0 * F.log(F.log(F.greatest(F.col("n"), F.lit(3)).cast("double"))))
    g = F.when((F.col("omega") > 0) & (F.col("t") >= -tau), F.col("dbar")).otherwise(0.0)
    s = s.withColumn("g", g)
    top = s.groupBy("family").agg(
        F.max_by("strategy_id", F.struct("t", -F.col("strategy_id"))).alias("best"), F.max("t").alias("max_t"),
        F.greatest(F.lit(0.0), F.max("t")).alias("statistic"), F.max("n").alias("n"),
    )
    z = F.when(F.col("omega") > 0, F.sqrt("n") * (F.col("dstar") - F.col("g")) / F.when(F.col("omega") > 0, F.col("omega")))
    boot = means.join(s, ["family", "strategy_id"]).groupBy("family", "b").agg(F.greatest(F.lit(0.0), F.max(z)).alias("m"))
    hits = boot.join(top.select("family", "statistic"), "family").groupBy("family").agg(
        F.count_if(F.col("m") >= F.col("statistic")).alias("c"), F.count(F.lit(1)).alias("draws")
    )
    p = (F.col("c") + 1) / (F.col("draws") + 1)
    return top.join(hits, "family").select("family", "best", "max_t", "statistic", "n", "draws", p.alias("p_value"))


def stepdown(panel: DataFrame, means: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Romano-Wolf stepdown: adjusted p-values and rejections in order of t.

    Hypotheses leave the set from the top of the order only, so the set still standing at rank k is
    the tail from k on. Each draw needs, for every k, the maximum over that tail: the strategies of one
    draw, in order. What comes out of the draws is one count per rank.
    """
    s = studentised(panel, means).withColumn("__nt", -F.col("t"))
    s = segmented(s, ["family"], ["__nt", "strategy_id"], value_bucket(F.col("__nt")), {"k": ("row_number", None)})
    s = cut_lineage(s.drop("__nt"), "ranked")
    z = F.when(F.col("omega") > 0, F.sqrt("n") * (F.col("dstar") - F.col("dbar")) / F.when(F.col("omega") > 0, F.col("omega")))
    d = means.join(s, ["family", "strategy_id"]).select("family", "b", "k", "t", z.alias("z"), (-F.col("k")).alias("__nk"))
    d = segmented(d, ["family", "b"], ["__nk"], F.floor(F.col("__nk") / RANKS), {"m": ("max", F.col("z"))})
    hits = F.coalesce("m", F.lit(0.0)) >= F.col("t")
    counts = d.groupBy("family", "k").agg(F.count_if(hits).alias("c"), F.count(F.lit(1)).alias("draws"))
    r = cut_lineage(s.join(counts, ["family", "k"]), "counts")
    r = segmented(r, ["family"], ["k"], F.floor(F.col("k") / RANKS), {"running": ("max", (F.col("c") + 1) / (F.col("draws") + 1))})
    kept = r.groupBy("family").agg(F.min(F.when(F.col("running") > alpha, F.col("running"))).alias("__kept"))
    r = r.join(kept, "family")
    first_kept = F.col("__kept")
    rejected = F.col("running") <= alpha
    return r.select(
        "family", "strategy_id", "k", "t", F.when(rejected, F.col("running")).otherwise(first_kept).alias("adjusted_p"), rejected.alias("reject")
    )


def _statistic(name: str) -> tuple[dict[str, Column], Column]:
    """Row sums a named statistic needs, and the statistic from those sums and ``n``."""
    r, n = F.col("r"), F.col("n")
    if name == "mean":
        return {"s": r}, F.col("s") / n
    if name == "profit_factor":
        return {"g": F.greatest(r, F.lit(0.0)), "l": F.greatest(-r, F.lit(0.0))}, profit_factor(F.col("g"), F.col("l"))
    if name == "sharpe":
        var = (F.col("q") - F.col("s") * F.col("s") / n) / (n - 1)
        return {"s": r, "q": r * r}, F.when(var > 0, F.col("s") / n / F.sqrt(F.when(var > 0, var))).otherwise(F.lit(float("nan")))
    raise ValueError(f"unknown statistic {name!r}")


KEYS = ["family", "strategy_id"]


def _point(panel: DataFrame, statistic: str | Statistic) -> DataFrame:
    if isinstance(statistic, Statistic):
        n = panel.groupBy(*KEYS).agg(F.count("r").alias("n"))
        return series_states(panel, KEYS, statistic).join(n, KEYS).select(*KEYS, "n", statistic.value(F.col("state")).alias("point"))
    sums, stat = _statistic(statistic)
    g = panel.groupBy(*KEYS).agg(*[F.sum(c.cast(EXACT)).alias(f"__e_{k}") for k, c in sums.items()], F.count("r").alias("n"))
    return g.withColumns({k: F.col(f"__e_{k}").cast("double") for k in sums}).withColumn("point", stat)


def _resampled(panel: DataFrame, draws: DataFrame, sizes: DataFrame, statistic: str | Statistic) -> DataFrame:
    """The statistic of every draw; ``draws`` are runs (with ``first`` and ``len``) or positions."""
    if isinstance(statistic, Statistic):
        return draw_states(panel, draws, statistic).select(*KEYS, "b", statistic.value(F.col("state")).alias("theta"))
    sums, stat = _statistic(statistic)
    d = (block_sums if "first" in draws.columns else draw_sums)(panel, draws, sums).join(sizes.select("family", "n"), "family")
    return d.select(*KEYS, "b", stat.alias("theta"))


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def block_bootstrap_ci(panel: DataFrame, statistic: str | Statistic = "mean", scheme: str = "stationary", draws: int = 10000, block: int = 5,
                       confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """Percentile interval under one of three block schemes, of a named statistic or one of the caller's own.

    NaN draws are dropped and infinite ones kept; an infinite point or mostly NaN draws leave the
    bounds null, with a reason.
    """
    if draws < MIN_DRAWS:
        raise ValueError(f"draws must be at least {MIN_DRAWS}")
    sizes = family_sizes(panel)
    make = {"stationary": stationary_blocks, "moving": moving_blocks, "fixed": fixed_blocks}[scheme]
    drawn = make(sizes, draws, block, seed)
    if isinstance(statistic, Statistic):
        drawn = cut_lineage(drawn, "drawn")  # read for its longest run, then for its runs
    theta = cut_lineage(_resampled(panel, drawn, sizes, statistic).filter(~F.isnan("theta")), "theta")
    alpha = 1.0 - confidence
    q = quantiles(value_ranks(theta, KEYS, "theta"), KEYS, "theta", {"lower": F.lit(alpha / 2), "upper": F.lit(1 - alpha / 2)})
    kept = theta.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("kept"))
    out = _point(panel, statistic).select(*KEYS, "n", "point").join(q, KEYS, "left").join(kept, KEYS, "left")
    reason = F.when(~_finite(F.col("point")), "point is not finite").when(F.coalesce("kept", F.lit(0)) < draws // 2, "too many undefined draws")
    ok = reason.isNull()
    return out.select(*KEYS, "n", "point", F.when(ok, F.col("lower")).alias("lower"), F.when(ok, F.col("upper")).alias("upper"), reason.alias("reason"))


def bca_interval(panel: DataFrame, statistic: str = "profit_factor", draws: int = 10000, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """Bias-corrected accelerated interval; the jackknife comes in closed form from the sums."""
    if draws < MIN_DRAWS:
        raise ValueError(f"draws must be at least {MIN_DRAWS}")
    sizes = family_sizes(panel)
    point = _point(panel, statistic)
    # one row per draw and strategy, read by the bias correction and by the quantiles
    theta = cut_lineage(_resampled(panel, independent_indices(sizes, draws, seed), sizes, statistic).filter(~F.isnan("theta")), "theta")
    t = theta.join(point.select(*KEYS, "point"), KEYS)
    place = t.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("m"), F.count_if(F.col("theta") < F.col("point")).alias("less"), F.count_if(F.col("theta") == F.col("point")).alias("same")
    )
    sums, stat = _statistic(statistic)
    names = list(sums)
    left = panel.select(*KEYS, *[c.cast(EXACT).alias(f"__x_{k}") for k, c in sums.items()]).join(point, KEYS)
    left = left.select(*KEYS, *[(F.col(f"__e_{k}") - F.col(f"__x_{k}")).cast("double").alias(k) for k in names], (F.col("n") - 1).alias("n")).withColumn("j", stat)
    jm = left.groupBy(*KEYS).agg(F.avg("j").alias("jm"), F.count_if(~_finite(F.col("j"))).alias("odd"))
    dv = F.col("jm") - F.col("j")
    acc = left.join(jm, KEYS).groupBy(*KEYS).agg(F.sum(dv * dv).alias("d2"), F.sum(dv * dv * dv).alias("d3"), F.max("odd").alias("odd"))
    # a strategy whose draws are all undefined keeps its row
    g = point.select(*KEYS, "n", "point").join(place, KEYS, "left").join(acc, KEYS)
    half = 0.5 / F.col("m")
    share = F.when(F.col("m") > 0, F.least(F.greatest((F.col("less") + 0.5 * F.col("same")) / F.col("m"), half), 1.0 - half))
    usable = (F.col("odd") == 0) & (F.col("d2") > 0)
    g = g.withColumn("__share", share)
    g = g.withColumns({"z0": normal_ppf(F.col("__share")), "accel": F.when(usable, F.col("d3") / (6.0 * F.pow(F.when(usable, F.col("d2")), F.lit(1.5)))).otherwise(0.0)})

    def adjusted(p: float) -> Column:
        z = F.col("z0") + NormalDist().inv_cdf(p)
        den = 1.0 - F.col("accel") * z
        den = F.when(F.abs(den) < 1e-12, F.when(den < 0, -1e-12).otherwise(1e-12)).otherwise(den)
        return F.col("z0") + z / den

    alpha = 1.0 - confidence
    g = cut_lineage(g, "bca").withColumns({"__zl": adjusted(alpha / 2), "__zu": adjusted(1 - alpha / 2)})
    g = g.withColumns({"__pl": normal_cdf(F.col("__zl")), "__pu": normal_cdf(F.col("__zu"))})
    ranked = value_ranks(theta, KEYS, "theta").join(g.select(*KEYS, "__pl", "__pu"), KEYS)
    q = quantiles(ranked, KEYS, "theta", {"lower": F.col("__pl"), "upper": F.col("__pu")})
    reason = F.when(~_finite(F.col("point")), "point is not finite").when(F.coalesce("m", F.lit(0)) < draws // 2, "too many undefined draws")
    ok = reason.isNull()
    lower = F.when(ok, F.col("lower"))
    out = g.join(q, KEYS, "left")
    return out.select(*KEYS, "n", "point", lower.alias("lower"), F.when(ok, F.col("upper")).alias("upper"), "z0", "accel", reason.alias("reason"),
                      F.coalesce(_finite(lower) & (lower > 1.0), F.lit(False)).alias("exceeds_one"))


def permutation_test(panel: DataFrame, mode: str = "sign_flip", statistic: str = "mean", draws: int = 10000, block: int = 5,
                     one_sided: bool = True, seed: int = 0) -> DataFrame:
    """Permutation p-values per strategy.

    ``sign_flip`` flips signs at random; ``shuffle`` and ``block_shuffle`` reorder, which only matters
    for an order-dependent statistic: ``lag_product`` is the mean product of neighbouring returns.
    """
    if draws < MIN_DRAWS:
        raise ValueError(f"draws must be at least {MIN_DRAWS}")
    sizes = family_sizes(panel)
    p = panel.select(*KEYS, "i", "r")
    c = _counters(sizes, draws, F.col("n")).withColumnRenamed("step", "i")
    if mode == "sign_flip":
        moved = c.select("family", "b", "i", F.col("i").alias("pos"), F.when(uniform("perm", seed, F.col("b"), F.col("i")) < 0.5, 1.0).otherwise(-1.0).alias("sign"))
    elif mode in ("shuffle", "block_shuffle"):
        unit = F.col("i") if mode == "shuffle" else F.floor(F.col("i") / block)
        w = Window.partitionBy("family", "b").orderBy("__u", "__unit", "i")
        moved = c.withColumn("__unit", unit).withColumn("__u", uniform("perm", seed, F.col("b"), F.col("__unit")))
        moved = moved.withColumn("pos", (F.row_number().over(w) - 1).cast("long")).select("family", "b", "i", "pos", F.lit(1.0).alias("sign"))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    j = moved.join(p, ["family", "i"]).withColumn("x", F.col("sign") * F.col("r"))
    if statistic == "mean":
        obs = p.groupBy(*KEYS).agg(F.avg("r").alias("observed"))
        null = j.groupBy(*KEYS, "b").agg(F.avg("x").alias("s"))
    elif statistic == "lag_product":
        step = Window.partitionBy(*KEYS).orderBy("i")
        obs = p.withColumn("y", F.col("r") * F.lag("r").over(step)).groupBy(*KEYS).agg(F.avg("y").alias("observed"))
        step = Window.partitionBy(*KEYS, "b").orderBy("pos")
        null = j.withColumn("y", F.col("x") * F.lag("x").over(step)).groupBy(*KEYS, "b").agg(F.avg("y").alias("s"))
    else:
        raise ValueError(f"unknown statistic {statistic!r}")
    n = null.join(obs, KEYS)
    at_least = (F.col("s") >= F.col("observed")) if one_sided else (F.abs("s") >= F.abs("observed"))
    g = n.groupBy(*KEYS).agg(F.count_if(at_least & _finite(F.col("s"))).alias("c"), F.count_if(_finite(F.col("s"))).alias("valid"), F.max("observed").alias("observed"))
    unstable = F.when(F.col("valid") < 0.9 * draws, F.raise_error(F.lit("statistic is not finite in too many permutations"))).otherwise(F.lit(True))
    return g.filter(unstable).select(*KEYS, "observed", "valid", ((F.col("c") + 1) / (F.col("valid") + 1)).alias("p_value"))


def optimal_block_length(panel: DataFrame) -> DataFrame:
    """Automatic block length (Politis and White 2004, stationary bootstrap) per strategy."""
    key = "__key"
    p = panel.withColumn(key, F.struct(*KEYS))
    c = centred(p, key)
    kn = F.greatest(F.lit(5), F.ceil(F.sqrt(F.log10(F.col("n").cast("double")))))
    mmax = F.ceil(F.sqrt(F.col("n").cast("double"))) + kn
    cov = autocovariances(c, key, "i", F.when(F.col("n") >= 8, mmax).otherwise(F.lit(0)))
    n = panel.groupBy(F.struct(*KEYS).alias(key)).agg(F.count("r").alias("n"))
    # lags are about the square root of n, so one strategy's autocovariances fit in an array
    g = cov.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("lag", "cov"))).alias("a")).join(n, key)
    g = g.withColumns({"kn": kn.cast("int"), "mmax": mmax.cast("int"), "gamma": F.transform("a", lambda s: s["cov"])})
    g0 = F.element_at("gamma", 1)
    limit = 2.0 * F.sqrt(F.log10(F.col("n").cast("double")) / F.col("n"))
    big = lambda k: F.abs(F.element_at("gamma", (k + 1).cast("int")) / g0) >= limit
    starts = F.sequence(F.lit(1), F.col("mmax") - F.col("kn") + 1)
    quiet = F.filter(starts, lambda k: ~F.exists(F.sequence(k, k + F.col("kn") - 1), big))
    loud = F.filter(F.sequence(F.lit(1), F.col("mmax")), big)
    m_hat = F.when(F.size(quiet) > 0, F.element_at(quiet, 1) - 1).otherwise(F.coalesce(F.array_max(loud), F.lit(1)))
    usable = (F.col("n") >= 8) & (g0 > 0)
    g = g.filter(usable).withColumn("m", F.least(2 * F.greatest(m_hat, F.lit(1)), F.col("mmax")))
    weight = lambda k: F.when(k / F.col("m") <= 0.5, 1.0).otherwise(2.0 * (1.0 - k / F.col("m")))
    at = lambda k: F.element_at("gamma", (k + 1).cast("int"))
    lags = F.sequence(F.lit(1), F.col("m"))
    total = lambda f: F.aggregate(F.transform(lags, f), F.lit(0.0), lambda a, x: a + x)
    g = g.withColumns({"g_hat": 2.0 * total(lambda k: weight(k) * k * at(k)), "d0": g0 + 2.0 * total(lambda k: weight(k) * at(k))})
    d_sb = 2.0 * F.col("d0") * F.col("d0")
    good = (d_sb > 0) & (F.col("g_hat") > 0)
    nn = F.col("n").cast("double")
    b = F.pow(2.0 * F.col("g_hat") * F.col("g_hat") / F.when(good, d_sb), F.lit(1.0 / 3.0)) * F.pow(nn, F.lit(1.0 / 3.0))
    top = F.ceil(F.least(3.0 * F.sqrt(nn), nn / 3.0))
    best = F.when(good, F.greatest(F.lit(1), F.least(F.floor(b + 0.5), top))).otherwise(F.lit(1))
    found = g.select(key, best.cast("long").alias("block"))
    return n.join(found, key, "left").select(f"{key}.*", "n", F.coalesce("block", F.lit(1)).cast("long").alias("block"))


def survival(panel: DataFrame, leverages: Sequence[float], horizon: int = 252, paths: int = 10000, kill: float = 0.3, block: int = 5,
             seed: int = 0) -> DataFrame:
    """Share of resampled paths that never lose ``kill`` of the start, for each leverage.

    The same paths serve every leverage, which makes the curve monotone. A path is an array of
    ``horizon`` returns, and ``horizon`` is a parameter, not the data's size. Paths are joined by runs of
    returns, not by single ones.
    """
    sizes = family_sizes(panel)
    runs = stationary_blocks(sizes, paths, block, seed, F.lit(horizon))
    # runs in pieces of up to PIECE returns; every position holds its own and the next ones, past the end from the start
    at = F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("len") - 1, F.lit(PIECE).cast("long"))).alias("__k", "skip")
    runs = runs.select("family", "n", "b", "step", "first", "len", at)
    runs = runs.select("family", "b", (F.col("step") + F.col("skip")).alias("step"), ((F.col("first") + F.col("skip")) % F.col("n")).alias("i"), F.least(F.lit(PIECE), F.col("len") - F.col("skip")).cast("int").alias("len"))
    ahead = panel.join(sizes.select("family", "n"), "family").select(*KEYS, "n", "r", F.col("i").alias("__at"), F.explode(F.sequence(F.lit(0), F.lit(PIECE - 1))).alias("__k"))
    ahead = ahead.groupBy(*KEYS, F.pmod(F.col("__at") - F.col("__k"), F.col("n")).alias("i")).agg(F.transform(F.array_sort(F.collect_list(F.struct("__k", "r"))), lambda x: x["r"]).alias("next"))
    steps = runs.join(cut_lineage(ahead, "ahead"), ["family", "i"]).select(*KEYS, "b", "step", F.slice("next", F.lit(1), F.col("len")).alias("rs"))
    path = steps.groupBy(*KEYS, "b").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("step", "rs"))), lambda x: x["rs"])).alias("p"))
    floor = 1.0 - kill
    grid = F.array(*[F.lit(float(x)) for x in leverages])

    def low_point(lev: Column) -> Column:
        start = F.struct(F.lit(1.0).alias("e"), F.lit(1.0).alias("lo"))
        walk = F.aggregate("p", start, lambda a, s: F.struct(
            (a["e"] * (1.0 + s * lev)).alias("e"), F.least(a["lo"], a["e"] * (1.0 + s * lev)).alias("lo")))
        return F.struct(lev.alias("leverage"), (walk["lo"] > F.lit(max(floor, 0.0))).alias("alive"))

    each = path.select(*KEYS, F.explode(F.transform(grid, low_point)).alias("o"))
    return each.groupBy(*KEYS, F.col("o.leverage").alias("leverage")).agg(F.avg(F.col("o.alive").cast("double")).alias("survival"))


def survival_cap(curve: DataFrame, sizes: DataFrame, floor: float = 0.995) -> DataFrame:
    """Largest number of contracts whose survival clears the floor.

    ``curve``: keys, ``contracts``, ``survival``; ``sizes``: keys, ``base`` (the cap before survival). The
    curve must hold every whole size from 1 to ``base``; a gap fails, since the cap could lie in it.
    """
    within = curve.join(sizes, KEYS).filter("contracts BETWEEN 1 AND base")
    best = within.groupBy(*KEYS).agg(F.max(F.when(F.col("survival") >= floor, F.col("contracts"))).alias("__best"), F.count_distinct("contracts").alias("__n"))
    whole = F.when(F.coalesce("__n", F.lit(0)) < F.col("base"), F.raise_error(F.lit("the survival curve lacks sizes up to the base"))).otherwise(F.lit(True))
    return sizes.join(best, KEYS, "left").filter(whole).withColumn("cap", F.coalesce("__best", F.lit(0))).drop("__best", "__n")


def adjust_p_values(p_values: DataFrame, family: Sequence[str], item: str, level: float = 0.05) -> DataFrame:
    """Bonferroni, Holm and Benjamini-Hochberg adjusted p-values, one row per hypothesis."""
    fam = list(family)
    bad = F.col("p").isNull() | (F.col("p") < 0) | (F.col("p") > 1)
    ok = F.when(bad, F.raise_error(F.lit("p-values must lie in [0, 1]"))).otherwise(F.lit(True))
    n = p_values.groupBy(*fam).agg(F.count(F.lit(1)).alias("__n"))
    d = p_values.filter(ok).join(n, fam)
    bucket = value_bucket(F.col("p"))
    d = cut_lineage(segmented(d, fam, ["p", item], bucket, {"__k": ("row_number", None)}), "ranked")
    one, k, m, p = F.lit(1.0), F.col("__k"), F.col("__n"), F.col("p")
    d = segmented(d, fam, ["p", item], bucket, {"holm": ("max", F.least(one, (m - k + 1) * p))}).withColumn("__nk", -k)
    d = segmented(d, fam, ["__nk"], value_bucket(-p), {"__bh": ("min", p * m / k)})
    return d.select(
        *fam, item, "p", F.least(one, p * m).alias("bonferroni"), "holm", F.least(one, F.col("__bh")).alias("bh")
    ).withColumns({f"reject_{c}": F.col(c) <= level for c in ("bonferroni", "holm", "bh")})


GATES = ["deflated_sharpe", "probabilistic_sharpe", "bca_profit_factor", "permutation", "superiority"]


def promotion(deflated: DataFrame, probabilistic: DataFrame, profit: DataFrame, permutation: DataFrame, superiority: DataFrame, alpha: float = 0.05) -> DataFrame:
    """All five gates per strategy, with the names of those that failed."""
    d = deflated.select(*KEYS, "dsr", F.col("passes").alias("deflated_sharpe"))
    d = d.join(probabilistic.select(*KEYS, "psr", F.col("passes").alias("probabilistic_sharpe")), KEYS)
    d = d.join(profit.select(*KEYS, "lower", F.col("exceeds_one").alias("bca_profit_factor")), KEYS)
    d = d.join(permutation.select(*KEYS, F.col("p_value").alias("permutation_p"), (F.col("p_value") < alpha).alias("permutation")), KEYS)
    d = d.join(superiority.select("family", F.col("p_value").alias("superiority_p"), (F.col("p_value") < alpha).alias("superiority")), "family")
    failed = F.filter(F.array(*[F.when(~F.col(g), F.lit(g)) for g in GATES]), lambda g: g.isNotNull())
    return d.withColumn("failed_gates", failed).withColumn("promoted", F.size("failed_gates") == 0)
