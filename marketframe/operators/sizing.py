"""Position sizes for whole signal tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import with_facts_as_of, with_root_facts

KELLY_SHARE, MARGIN_SHARE, LEVERAGE_CAP = 0.25, 0.5, 3.0


def _whole(c: Column) -> Column:
    return F.floor(c).cast("long")


def size_positions(signals: DataFrame, kelly_share: float = KELLY_SHARE, margin_share: float = MARGIN_SHARE,
                   leverage_cap: float = LEVERAGE_CAP, margins: DataFrame | None = None, at: str = "d") -> DataFrame:
    """Contracts allowed by kelly, margin, leverage and (optional column) survival caps.

    ``signals``: root, kelly, equity, price, optional ``survival_contracts``. The binding cap is the
    smallest; ties go to kelly, margin, leverage, survival in that order. ``margins`` (root, valid_from,
    margin) takes the place of the constant margins: a signal gets the one in force on its date ``at``.
    """
    if margins is None:
        s = with_root_facts(signals, "multiplier", "margin")
    else:
        s = with_facts_as_of(with_root_facts(signals, "multiplier"), margins, ["margin"], at)
    equity, kelly = F.col("equity").cast("double"), F.col("kelly").cast("double")
    notional = F.col("price").cast("double") * F.col("multiplier").cast("double")
    bad = (equity <= 0) | (F.col("price") <= 0)
    ok = F.when(bad, F.raise_error(F.lit("equity and price must be positive"))).otherwise(F.lit(True))
    s = s.filter(ok).withColumns({
        "notional": notional,
        "margin_contracts": _whole(equity * margin_share / F.col("margin").cast("double")),
        "leverage_contracts": _whole(equity * leverage_cap / notional),
        "kelly_contracts": F.when(kelly <= 0, F.lit(0).cast("long")).otherwise(_whole(kelly * kelly_share * equity / notional)),
    })
    base = F.least("kelly_contracts", "margin_contracts", "leverage_contracts")
    caps = ["kelly_contracts", "margin_contracts", "leverage_contracts"]
    if "survival_contracts" in signals.columns:
        s = s.withColumn("survival_contracts", F.when((kelly > 0) & (base > 0), F.col("survival_contracts")))
        caps.append("survival_contracts")
    smallest = F.least(*caps)  # nulls are skipped
    binding = F.when(kelly <= 0, "no_edge")
    for cap in caps:
        binding = binding.when(F.col(cap) == smallest, cap.split("_")[0])
    return s.withColumns({"binding": binding, "contracts": F.when(kelly <= 0, F.lit(0).cast("long")).otherwise(smallest)})


def size_fixed(signals: DataFrame, contracts: int, **caps) -> DataFrame:
    """A fixed number of contracts, cut to what margin, leverage and survival can carry."""
    s = size_positions(signals, **caps)
    limits = ["margin_contracts", "leverage_contracts"] + (["survival_contracts"] if "survival_contracts" in signals.columns else [])
    return s.withColumn("contracts", F.when(F.col("kelly") <= 0, F.lit(0).cast("long")).otherwise(F.least(F.lit(contracts).cast("long"), *limits)))


def inverse_vol_weights(returns: DataFrame, group: Sequence[str], leg: str) -> DataFrame:
    """Weights proportional to 1/volatility, averaging 1 in each group.

    A leg without measurable volatility gets the mean inverse volatility of the others; a group
    without any measurable leg gets all ones. The leg table has one row per leg.
    """
    group = list(group)
    sd = F.stddev_samp("r")
    legs = returns.groupBy(*group, leg).agg(sd.alias("sd"))
    legs = legs.withColumn("inv", F.when(F.col("sd") > 0, 1.0 / F.col("sd")))
    neutral = legs.groupBy(*group).agg(F.avg("inv").alias("neutral"))
    legs = legs.join(neutral, group).withColumn("raw", F.coalesce("inv", "neutral", F.lit(1.0)))
    level = legs.groupBy(*group).agg(F.avg("raw").alias("level"))
    return legs.join(level, group).select(*group, leg, "sd", (F.col("raw") / F.col("level")).alias("weight"))
