"""Cross-validation folds and the probability of backtest overfitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, spread
from .mergeable import Statistic, merged, series_states
from .ordered import quantiles, value_ranks
from .resample import prefix_sums

EPS = 1e-9


def split_masks(segments: int) -> Column:
    """Bit masks of all ways to choose half of ``segments`` (a parameter of at most about 20)."""
    if segments < 2 or segments % 2 or segments > 24:
        raise ValueError("segments must be even, from 2 to 24")
    return F.filter(F.sequence(F.lit(0), F.lit(2**segments - 1)), lambda m: F.bit_count(m) == segments // 2)


def overfitting_splits(panel: DataFrame, segments: int = 16, min_obs: int = 2, metric: Statistic | None = None) -> DataFrame:
    """In-sample and out-of-sample Sharpe (or ``metric``, the greater the better) of every strategy in every half/half split.

    Each strategy is reduced to (n, sum, sum of squares) per segment, taken around its own mean, so a
    split is a sum of ``segments / 2`` triples and its complement is the total minus that. A metric has one
    state per segment, and a split merges the states of either half in order. Rows past the last full
    segment are left out.
    """
    size = panel.groupBy("family").agg(F.floor((F.max("i") + 1) / segments).alias("size"))
    short = F.when(F.col("size") < min_obs, F.raise_error(F.lit("too few observations per segment"))).otherwise(F.lit(True))
    p = panel.join(size.filter(short), "family").withColumn("seg", F.floor(F.col("i") / F.col("size")).cast("int")).filter(F.col("seg") < segments)
    if metric is not None:
        one = series_states(p, ["family", "strategy_id", "seg"], metric).groupBy("family", "strategy_id").agg(F.array_sort(F.collect_list(F.struct("seg", "state"))).alias("t"))
        d = spread(one.withColumn("mask", F.explode(split_masks(segments))), "family", "strategy_id", "mask")

        def half(side: int) -> Column:
            chosen = F.filter("t", lambda e: F.call_function("getbit", F.col("mask"), e["seg"]) == side)
            return metric.value(merged(F.transform(chosen, lambda e: e["state"]), metric.merge))

        return d.select("family", "strategy_id", "mask", half(1).alias("ins"), half(0).alias("oos"))
    mean = p.groupBy("family", "strategy_id").agg(F.avg("r").alias("m"))
    x = F.col("r") - F.col("m")
    per_seg = p.join(mean, ["family", "strategy_id"]).groupBy("family", "strategy_id", "m", "seg").agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    one = per_seg.groupBy("family", "strategy_id", "m").agg(
        F.array_sort(F.collect_list(F.struct("seg", "n", "s", "q"))).alias("t"),
        F.sum("n").alias("tn"), F.sum("s").alias("ts"), F.sum("q").alias("tq"))
    d = spread(one.withColumn("mask", F.explode(split_masks(segments))), "family", "strategy_id", "mask")
    inside = F.filter("t", lambda e: F.expr("true") & (F.call_function("getbit", F.col("mask"), e["seg"]) == 1))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    d = d.withColumn("a", F.aggregate(inside, zero, lambda acc, e: F.struct(
        (acc["n"] + e["n"]).alias("n"), (acc["s"] + e["s"]).alias("s"), (acc["q"] + e["q"]).alias("q"))))

    def sharpe(n: Column, s: Column, q: Column) -> Column:
        var = (q - s * s / n) / (n - 1)
        flat = var <= 1e-15 * F.col("tq") / F.col("tn")
        return F.when((n < 2) | flat, 0.0).otherwise((F.col("m") + s / n) / F.sqrt(F.when(~flat, var)))

    a = F.col("a")
    ins = sharpe(a["n"], a["s"], a["q"])
    out = sharpe(F.col("tn") - a["n"], F.col("ts") - a["s"], F.col("tq") - a["q"])
    return d.select("family", "strategy_id", "mask", ins.alias("ins"), out.alias("oos"))


def overfitting_probability(panel: DataFrame, segments: int = 16, min_obs: int = 2, metric: Statistic | None = None) -> DataFrame:
    """Share of splits whose in-sample winner ranks below the out-of-sample median."""
    d = cut_lineage(overfitting_splits(panel, segments, min_obs, metric), "splits")
    win = d.groupBy("family", "mask").agg(
        F.max_by("oos", F.struct("ins", -F.col("strategy_id"))).alias("w"), F.count(F.lit(1)).alias("m"))
    ranks = d.join(win, ["family", "mask"]).groupBy("family", "mask").agg(
        F.count_if(F.col("oos") < F.col("w")).alias("below"), F.count_if(F.col("oos") == F.col("w")).alias("equal"), F.max("m").alias("m"))
    rel = (F.col("below") + (F.col("equal") + 1) / 2.0) / (F.col("m") + 1)
    rel = F.least(F.greatest(rel, F.lit(EPS)), F.lit(1 - EPS))
    logits = ranks.select("family", "m", F.log(rel / (1.0 - rel)).alias("logit"))
    g = logits.groupBy("family").agg(
        F.avg((F.col("logit") < 0).cast("double")).alias("pbo"), F.count(F.lit(1)).alias("splits"), F.avg("logit").alias("mean_logit"), F.max("m").alias("strategies"))
    med = quantiles(value_ranks(logits, ["family"], "logit"), ["family"], "logit", {"median_logit": F.lit(0.5)})
    corr = d.groupBy("family").agg(F.coalesce(F.corr("ins", "oos"), F.lit(0.0)).alias("is_oos_correlation"))
    return g.join(med, "family").join(corr, "family").withColumn("passes", F.col("pbo") < 0.5)


def overfitting_with_metric(panel: DataFrame, metric, segments: int = 8) -> DataFrame:
    """In/out values of a user metric: ``metric`` is a grouped-aggregate pandas UDF over returns."""
    size = panel.groupBy("family").agg(F.floor((F.max("i") + 1) / segments).alias("size"))
    p = panel.join(size, "family").withColumn("seg", F.floor(F.col("i") / F.col("size")).cast("int")).filter(F.col("seg") < segments)
    d = p.withColumn("mask", F.explode(split_masks(segments)))
    d = d.withColumn("side", F.call_function("getbit", F.col("mask"), F.col("seg")))
    v = d.groupBy("family", "strategy_id", "mask", "side").agg(metric(F.col("r")).alias("v"))
    return v.groupBy("family", "strategy_id", "mask").agg(
        F.max(F.when(F.col("side") == 1, F.col("v"))).alias("ins"), F.max(F.when(F.col("side") == 0, F.col("v"))).alias("oos"))


def walk_forward(sizes: DataFrame, window: int, mode: str = "anchored", train: int | None = None, step: int | None = None, min_train: int = 1) -> DataFrame:
    """Fold boundaries per family: validation follows training, the last window may be short."""
    step = step or window
    if mode == "rolling":
        if not train:
            raise ValueError("rolling folds need a training length")
        first, start = train, F.col("val_start") - train
    elif mode == "anchored":
        if train is not None:
            raise ValueError("a training length is for rolling folds")
        first, start = min_train, F.lit(0).cast("long")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    ok = F.when(F.col("n") <= first, F.raise_error(F.lit("no fold fits"))).otherwise(F.lit(True))
    f = sizes.filter(ok).select("family", "n", F.posexplode(F.sequence(F.lit(first).cast("long"), F.col("n") - 1, F.lit(step).cast("long"))).alias("fold", "val_start"))
    f = f.withColumn("train_start", start).filter(F.col("val_start") - F.col("train_start") >= min_train)
    return f.select("family", "fold", "train_start", F.col("val_start").alias("train_end"), "val_start", F.least(F.col("val_start") + window, F.col("n")).alias("val_end"))


def assign_walk_forward(panel: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows with their role in every fold they belong to.

    Each row finds its folds by position: folds are spread to the positions they cover, at most
    n positions per fold, and rows meet them in an equi-join.
    """
    cover = folds.withColumn("i", F.explode(F.sequence(F.col("train_start"), F.col("val_end") - 1)))
    cover = cover.select("family", "fold", "i", F.when(F.col("i") < F.col("train_end"), "train").otherwise("validate").alias("role"))
    return panel.join(cover, ["family", "i"])


def walk_forward_means(panel: DataFrame, folds: DataFrame) -> DataFrame:
    """``n`` and ``mean`` of r per family, fold, strategy_id and role (train, validate).

    A role is an interval of positions, so it costs two lookups in the strategy's prefix sums however
    long it is. A null r has a place but no value; a role without values has no mean. Positions run from
    0 without gaps, as in ``assign_walk_forward``.
    """
    value = F.col("r").cast("double")
    sums = cut_lineage(prefix_sums(panel, {"s": F.coalesce(value, F.lit(0.0)), "c": F.when(value.isNull(), 0).otherwise(1)}), "prefix")
    role = lambda name, a, z: F.struct(F.lit(name).alias("role"), F.col(a).alias("a"), F.col(z).alias("z"))
    roles = folds.select("family", "fold", F.inline(F.array(role("train", "train_start", "train_end"), role("validate", "val_start", "val_end")))).filter("a < z")
    edge = lambda at, plus: F.struct(F.col(at).alias("at"), F.lit(plus).alias("plus"))
    edges = roles.select("family", "fold", "role", (F.col("z") - F.col("a")).alias("n"), F.inline(F.array(edge("a", False), edge("z", True))))
    found = edges.join(sums, ["family", "at"])
    total = lambda c: F.sum(F.when(F.col("plus"), F.col(c)).otherwise(-F.col(c))).cast("double")
    g = found.groupBy("family", "fold", "strategy_id", "role").agg(F.max("n").alias("n"), total("c").alias("c"), total("s").alias("s"))
    return g.select("family", "fold", "strategy_id", "role", "n", F.when(F.col("c") > 0, F.col("s") / F.col("c")).alias("mean"))


def purged_roles(sizes: DataFrame, blocks: int = 10, test: int = 2, purge: int = 5, embargo: int = 2) -> DataFrame:
    """Role of every position in each combination of test blocks: test, purged, embargoed or train.

    Positions just before a test block are purged and just after it embargoed; purging wins.
    """
    if not 1 <= test < blocks:
        raise ValueError("test blocks must be fewer than all blocks")
    ok = F.when(F.col("n") < blocks, F.raise_error(F.lit("fewer positions than blocks"))).otherwise(F.lit(True))
    base, extra = F.floor(F.col("n") / blocks), F.col("n") % blocks
    at = lambda k: (k * base + F.least(k, extra)).cast("long")
    masks = F.filter(F.sequence(F.lit(0), F.lit(2**blocks - 1)), lambda m: F.bit_count(m) == test)
    d = sizes.filter(ok).withColumn("mask", F.explode(masks))
    chosen = F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: F.call_function("getbit", F.col("mask"), k) == 1)
    d = d.withColumn("spans", F.transform(chosen, lambda k: F.struct(at(k).alias("a"), at(k + 1).alias("z"))))
    d = spread(d, "family", "mask").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    i = F.col("i")
    in_test = F.exists("spans", lambda s: (i >= s["a"]) & (i < s["z"]))
    in_purge = F.exists("spans", lambda s: (i >= s["a"] - purge) & (i < s["a"]))
    in_embargo = F.exists("spans", lambda s: (i >= s["z"]) & (i < s["z"] + embargo))
    role = F.when(in_test, "test").when(in_purge, "purged").when(in_embargo, "embargoed").otherwise("train")
    return d.select("family", "mask", "i", role.alias("role"))
