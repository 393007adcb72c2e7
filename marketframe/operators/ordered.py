"""Ordered computations that stay parallel inside one key.

A plain ``Window.partitionBy(key).orderBy(t)`` puts a whole key into one task. Here every key is cut
into segments along its order; each segment is a small window of its own, and what earlier segments
contribute comes from one partial aggregate per segment. The table of segment aggregates has keys x
segments rows, and only that table is ordered per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

_SEG = "__seg"
_PIECE = "__piece"


def segmented(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    segment: Column,
    scans: dict[str, tuple[str, Column | None]],
) -> DataFrame:
    """Add running columns over each key's order.

    ``segment`` must not decrease along ``order``. Each scan is ``name: (kind, input)``:
    ``sum``, ``max``, ``min`` (inclusive of the row), ``row_number``, ``lag`` (previous row's input),
    ``last`` (latest non-null input, inclusive). Null keys are a key, and null order comes first, as in
    a plain window: key and segment are joined as one struct, in which nulls are equal.
    """
    keys = list(keys)
    ins = {name: f"__in_{name}" for name in scans}
    base = df.withColumn(_SEG, segment).withColumn(_PIECE, F.struct(*keys, _SEG))
    base = base.withColumns({ins[n]: (c if c is not None else F.lit(1)) for n, (_, c) in scans.items()})
    rank = F.struct(*order)
    w = Window.partitionBy(_PIECE).orderBy(*order)
    running = w.rowsBetween(Window.unboundedPreceding, 0)

    local, total = {}, []
    for name, (kind, _) in scans.items():
        x = F.col(ins[name])
        if kind in ("sum", "max", "min"):
            fn = {"sum": F.sum, "max": F.max, "min": F.min}[kind]
            local[name] = fn(x).over(running)
            total.append(fn(x).alias(f"__t_{name}"))
        elif kind == "row_number":
            local[name] = F.row_number().over(w).cast("long")
            total.append(F.count(F.lit(1)).alias(f"__t_{name}"))
        elif kind == "lag":
            local[name] = F.lag(x).over(w)
            local[f"__f_{name}"] = F.row_number().over(w) == 1
            total.append(F.max_by(x, rank).alias(f"__t_{name}"))
        elif kind == "last":
            local[name] = F.last(x, ignorenulls=True).over(running)
            total.append(F.max_by(x, F.when(x.isNotNull(), rank)).alias(f"__t_{name}"))
        else:
            raise ValueError(f"unknown scan kind {kind!r}")

    per_segment = base.groupBy(_PIECE).agg(*total)
    whole, place = [F.col(f"{_PIECE}.`{k}`") for k in keys], F.col(f"{_PIECE}.{_SEG}")
    before = Window.partitionBy(*whole).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    step = Window.partitionBy(*whole).orderBy(place)
    carry = []
    for name, (kind, _) in scans.items():
        t = F.col(f"__t_{name}")
        if kind in ("sum", "row_number"):
            carry.append(F.sum(t).over(before).alias(f"__c_{name}"))
        elif kind in ("max", "min"):
            carry.append({"max": F.max, "min": F.min}[kind](t).over(before).alias(f"__c_{name}"))
        elif kind == "lag":
            carry.append(F.lag(t).over(step).alias(f"__c_{name}"))
        else:
            carry.append(F.last(t, ignorenulls=True).over(before).alias(f"__c_{name}"))
    carried = per_segment.select(_PIECE, *carry)

    out = base.withColumns(local).join(carried, _PIECE)
    types = {f.name: f.dataType for f in out.schema.fields}
    final = {}
    for name, (kind, _) in scans.items():
        mine, prior = F.col(name), F.col(f"__c_{name}")
        if kind == "sum":
            t = types[name]
            if isinstance(t, DecimalType):
                # one digit of headroom, so that adding does not shorten the scale
                t = DecimalType(min(t.precision, 37), t.scale)
                mine, prior = mine.cast(t), prior.cast(t)
            final[name] = F.when(prior.isNull(), mine).when(mine.isNull(), prior).otherwise(mine + prior)
        elif kind == "row_number":
            final[name] = mine + F.coalesce(prior, F.lit(0))
        elif kind == "max":
            final[name] = F.greatest(mine, prior)
        elif kind == "min":
            final[name] = F.least(mine, prior)
        elif kind == "lag":
            final[name] = F.when(F.col(f"__f_{name}"), prior).otherwise(mine)
        else:
            final[name] = F.coalesce(mine, prior)
    return out.select(*df.columns, *[c.alias(n) for n, c in final.items()])


def running_max_struct(mine: Column, prior: Column) -> Column:
    """The larger of two structs, either of which may be null."""
    return F.when(prior.isNull() | (mine >= prior), mine).otherwise(prior)


def best_so_far(
    points: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    point_at: Column,
    fact_at: Column,
    best: Column,
    width: float,
    name: str = "found",
) -> DataFrame:
    """For every point, the largest ``best`` struct among facts of its key with ``fact_at <= point_at``.

    The general as-of join: ``best`` leads with what decides (time, rank, tie-break) and carries the
    payload behind it. Points and facts are laid on one timeline, so cost is linear in both and no
    point is paired with all earlier facts. Times are numbers; ``width`` is the segment length in
    the same unit. For a forward search, negate both times and lead ``best`` with the negated time.
    Points keep all their columns; ``name`` is null where nothing qualifies, as for a null key or time.
    """
    keys = list(keys)
    side = F.struct(*[F.col(c) for c in points.columns])
    left = points.select(
        *keys, point_at.cast("double").alias("__at"), F.lit(1).alias("__side"),
        side.alias("__row"),
    )
    right = facts.select(*keys, fact_at.cast("double").alias("__at"), best.alias("__best")).dropna(subset=[*keys, "__at"])
    right = right.groupBy(*keys, "__at").agg(F.max("__best").alias("__best")).withColumn("__side", F.lit(0))
    line = left.unionByName(right, allowMissingColumns=True)
    line = line.withColumn(_PIECE, F.struct(*keys, F.floor(F.col("__at") / F.lit(float(width))).alias(_SEG)))
    w = (
        Window.partitionBy(_PIECE)
        .orderBy("__at", "__side")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    here = line.withColumn("__mine", F.max("__best").over(w)).filter("__side = 1")
    per_segment = (
        right.withColumn(_PIECE, F.struct(*keys, F.floor(F.col("__at") / F.lit(float(width))).alias(_SEG)))
        .groupBy(_PIECE)
        .agg(F.max("__best").alias("__t"))
    )
    marks = here.select(_PIECE).distinct().unionByName(per_segment, allowMissingColumns=True)
    marks = marks.groupBy(_PIECE).agg(F.max("__t").alias("__t"))
    whole = [F.col(f"{_PIECE}.`{k}`") for k in keys]
    before = Window.partitionBy(*whole).orderBy(f"{_PIECE}.{_SEG}").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select(_PIECE, F.max("__t").over(before).alias("__prior"))
    out = here.join(carried, _PIECE)
    return out.select("__row.*", running_max_struct(F.col("__mine"), F.col("__prior")).alias(name))


def trailing(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    rows: int,
    aggregates: dict[str, Column],
    block: int = 4096,
) -> DataFrame:
    """Aggregates over the last ``rows`` rows of each key, the current one included.

    ``position`` is the row's 1-based place in its key. Rows go to blocks by position; a row within
    reach of the next block is copied there once, so every block can be computed alone.
    """
    block = max(block, rows)
    own = F.floor((F.col(position) - 1) / block)
    reach = (F.col(position) - 1) % block >= block - (rows - 1)
    spread = df.withColumn("__own", own).withColumn(
        "__block", F.explode(F.when(reach, F.array(own, own + 1)).otherwise(F.array(own)))
    )
    w = Window.partitionBy(*keys, "__block").orderBy(position).rowsBetween(-(rows - 1), 0)
    out = spread.select("*", *[c.over(w).alias(n) for n, c in aggregates.items()])
    return out.filter("__own = __block").drop("__own", "__block")


def value_bucket(v: Column, per_e: int = 16) -> Column:
    """A scale-free bucket that never decreases with ``v``: about 6% wide, whatever the unit.

    Infinities and NaN have buckets of their own at the ends.
    """
    big = F.lit(100000)
    x = v.cast("double")
    return (
        F.when(F.isnan(x), F.lit(300000))
        .when(F.abs(x) == float("inf"), F.when(x > 0, F.lit(200000)).otherwise(F.lit(-200000)))
        .when(v == 0, F.lit(0))
        .when(v > 0, big + F.floor(F.log(v) * per_e))
        .otherwise(-big - F.floor(F.log(-v) * per_e))
        .cast("long")
    )


def value_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values per key with how often they occur and the ranks they cover.

    Output: keys, value, ``cnt``, ``hi`` (ranks ``hi - cnt`` up to ``hi - 1``, zero based) and ``n``.
    Equal values are merged map-side first, so a hot key costs its distinct values, not its rows.
    """
    keys = list(keys)
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("cnt"))
    ranked = segmented(counts, keys, [value], value_bucket(F.col(value)), {"hi": ("sum", F.col("cnt"))})
    sizes = counts.groupBy(*keys).agg(F.sum("cnt").alias("n"))
    return ranked.join(sizes, keys)


def quantiles(ranked: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, Column]) -> DataFrame:
    """Type-7 quantiles of a ``value_ranks`` table; probabilities may differ per key."""
    keys = list(keys)
    lo_rank, hi_rank = F.col("hi") - F.col("cnt"), F.col("hi")
    picks = []
    for name, p in probabilities.items():
        h = (F.col("n") - 1) * p
        lo = F.floor(h)
        hi = F.least(lo + 1, F.col("n") - 1)
        at_lo = (lo >= lo_rank) & (lo < hi_rank)
        at_hi = (hi >= lo_rank) & (hi < hi_rank)
        picks += [
            F.max(F.when(at_lo, F.col(value))).alias(f"__{name}_lo"),
            F.max(F.when(at_hi, F.col(value))).alias(f"__{name}_hi"),
            F.max(h - lo).alias(f"__{name}_w"),
        ]
    out = ranked.groupBy(*keys).agg(*picks)
    return out.select(
        *keys,
        *[
            # nothing is added to a value that is taken whole: the next may be infinite
            F.when((F.col(f"__{n}_lo") == F.col(f"__{n}_hi")) | (F.col(f"__{n}_w") == 0), F.col(f"__{n}_lo"))
            .otherwise(F.col(f"__{n}_lo") + F.col(f"__{n}_w") * (F.col(f"__{n}_hi") - F.col(f"__{n}_lo")))
            .alias(n)
            for n in probabilities
        ],
    )
