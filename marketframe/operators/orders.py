"""Order-level rules: slippage and order types a venue does not take."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import NATIVE_ORDER_TYPES, ORDER_DOWNGRADES, SLIPPAGE_BANDS, with_facts_as_of, with_root_facts
from ..functions.contracts import contract_root


def slipped_price(price: Column, side: Column, tick: Column, band: str) -> Column:
    """Buys pay, sells give up a band-dependent number of ticks."""
    ticks = dict(SLIPPAGE_BANDS)[band]
    return F.when(side == "buy", price + tick * ticks).otherwise(price - tick * ticks)


def apply_slippage(fills: DataFrame, band: str | Sequence[str] = "CONSERVATIVE", slips: DataFrame | None = None, at: str = "filled_at") -> DataFrame:
    """Market and stop fills move against the trader; limit fills do not.

    Several bands give a row of each fill for every one, named in ``band``, from one reading of the fills.
    ``slips`` (root, valid_from, tick, ticks) takes the place of the constant tick sizes and the band: a fill
    moves by ``tick * ticks`` as in force at its time ``at``.
    """
    f = fills.withColumn("root", contract_root(F.col("contract")))
    moved = F.col("order_type").isin("MKT", "STP")
    if slips is None:
        f = with_root_facts(f, "tick")
        if isinstance(band, str):
            away = slipped_price(F.col("fill_price"), F.col("side"), F.col("tick"), band)
        else:
            each = [F.struct(F.lit(b).alias("band"), slipped_price(F.col("fill_price"), F.col("side"), F.col("tick"), b).alias("__away")) for b in band]
            f = f.select("*", F.inline(F.array(*each)))
            away = F.col("__away")
    else:
        f = with_facts_as_of(f, slips, ["tick", "ticks"], at)
        move = F.col("tick") * F.col("ticks")
        away = F.when(F.col("side") == "buy", F.col("fill_price") + move).otherwise(F.col("fill_price") - move)
    price = F.when(moved, away).otherwise(F.col("fill_price"))
    return f.withColumn("slipped_price", price).drop("__away")


def downgrade_orders(orders: DataFrame) -> DataFrame:
    """Native, rewritten, or rejected, with severity; an unknown type is rejected too."""
    dim = orders.sparkSession.createDataFrame(ORDER_DOWNGRADES, "order_type string, target string, severity string")
    dim = dim.withColumn("__rule", F.lit(True))
    native = F.col("order_type").isin(NATIVE_ORDER_TYPES)
    out = orders.join(F.broadcast(dim), "order_type", "left")
    action = F.when(native, "native").when(F.col("target").isNotNull(), "rewrite").otherwise("reject")
    sent = F.when(native, F.col("order_type")).otherwise(F.col("target"))
    severity = F.when(native, F.lit(None)).when(F.col("__rule").isNull(), "HIGH").otherwise(F.col("severity"))
    return out.withColumns({"action": action, "sent_as": sent, "severity": severity}).drop("target", "__rule")
