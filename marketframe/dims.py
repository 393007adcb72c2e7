"""Fixed reference tables. Sizes are constants of this file, so broadcasting them is safe."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Per root the contract multiplier, initial margin, tick size, month cycle, rule family
# for last trade and first notice, anchor of the roll, and the target and deadline offsets in
# trading days (no rule for the micro contracts).
ROOTS = [
    ("ES", "50", "15400", "0.25", "HMUZ", "third_friday", "LTD", 5, 2),
    ("MES", "5", "1540", "0.25", "HMUZ", None, None, None, None),
    ("NQ", "20", "22800", "0.25", "HMUZ", "third_friday", "LTD", 5, 2),
    ("MNQ", "2", "2280", "0.25", "HMUZ", None, None, None, None),
    ("CL", "1000", "7200", "0.01", "FGHJKMNQUVXZ", "crude", "LTD", 5, 3),
    ("MCL", "100", "720", "0.01", "FGHJKMNQUVXZ", None, None, None, None),
    ("GC", "100", "26100", "0.10", "GJMQVZ", "metal", "FND", 7, 3),
    ("MGC", "10", "2610", "0.10", "GJMQVZ", None, None, None, None),
    ("MBT", "0.1", "2800", "5", "FGHJKMNQUVXZ", "last_friday", "LTD", 7, 3),
    ("MET", "0.1", "1800", "0.5", "FGHJKMNQUVXZ", "last_friday", "LTD", 7, 3),
    ("YM", "5", "1700", "1", "HMUZ", "third_friday", "LTD", 5, 2),
    ("RTY", "50", "3000", "0.10", "HMUZ", "third_friday", "LTD", 5, 2),
    ("6E", "125000", "2600", "0.00005", "HMUZ", "currency", "LTD", 5, 2),
    ("6A", "100000", "1800", "0.00005", "HMUZ", "currency", "LTD", 5, 2),
    ("ZN", "1000", "2200", "0.015625", "HMUZ", "treasury", "FND", 5, 2),
    ("ZB", "1000", "4000", "0.03125", "HMUZ", "treasury", "FND", 5, 2),
    ("6J", "12500000", "2860", "0.0000005", "HMUZ", "currency", "LTD", 5, 2),
    ("6B", "62500", "2090", "0.0001", "HMUZ", "currency", "LTD", 5, 2),
    ("6C", "100000", "990", "0.00005", "HMUZ", "currency", "LTD", 5, 2),
    ("6S", "125000", "4400", "0.0001", "HMUZ", "currency", "LTD", 5, 2),
    ("HG", "25000", "13200", "0.0005", "HKNUZ", "metal", "FND", 7, 3),
    ("SI", "5000", "46230", "0.005", "HKNUZ", "metal", "FND", 7, 3),
    ("ZT", "2000", "1320", "0.00390625", "HMUZ", "treasury", "FND", 5, 2),
    ("ZF", "1000", "1375", "0.0078125", "HMUZ", "treasury", "FND", 5, 2),
    ("UB", "1000", "5665", "0.03125", "HMUZ", "treasury", "FND", 5, 2),
    ("NKD", "5", "21874", "5", "HMUZ", "second_friday", "LTD", 5, 2),
]

# Ticks per side of each slippage band.
SLIPPAGE_BANDS = [("CONSERVATIVE", 2), ("REALISTIC", 1), ("PESSIMISTIC", 4)]

# Scheduled series, publisher, release time in New York, severity, size multiplier.
SERIES = [
    ("NFP", "BLS", "08:30:00", "HIGH", 0.5),
    ("CPI", "BLS", "08:30:00", "HIGH", 0.5),
    ("PPI", "BLS", "08:30:00", "LOW", 1.0),
    ("GDP_ADVANCE", "BEA", "08:30:00", "LOW", 1.0),
    ("GDP_SECOND", "BEA", "08:30:00", "LOW", 1.0),
    ("GDP_THIRD", "BEA", "08:30:00", "LOW", 1.0),
    ("PCE", "BEA", "08:30:00", "LOW", 1.0),
    ("RETAIL_SALES", "CENSUS", "08:30:00", "LOW", 1.0),
    ("HOUSING_STARTS", "CENSUS", "08:30:00", "LOW", 1.0),
    ("JOBLESS_CLAIMS", "DOL", "08:30:00", "MEDIUM", 1.0),
    ("ISM_MFG", "ISM", "10:00:00", "LOW", 1.0),
    ("ISM_SERVICES", "ISM", "10:00:00", "LOW", 1.0),
    ("JOLTS", "BLS", "10:00:00", "LOW", 1.0),
    ("CONSUMER_CONF", "CONFERENCE_BOARD", "10:00:00", "LOW", 1.0),
    ("FOMC_STATEMENT", "FED", "14:00:00", "CRITICAL", 0.5),
    ("FOMC_PRESS_CONF", "FED", "14:30:00", "LOW", 1.0),
    ("FOMC_MINUTES", "FED", "14:00:00", "LOW", 1.0),
    ("BEIGE_BOOK", "FED", "14:00:00", "LOW", 1.0),
]

# Bars per hour of each resolution; daily and settle bars come once per session.
BARS_PER_HOUR = [("1s", 3600.0), ("5s", 720.0), ("1m", 60.0), ("5m", 12.0), ("15m", 4.0), ("1h", 1.0)]
ONE_PER_SESSION = ["1d", "settle"]

# Order types one venue takes as they are, and what becomes of the others.
NATIVE_ORDER_TYPES = ["MKT", "LMT", "STP", "STP_LMT", "TRAIL", "JOIN_BID", "JOIN_ASK"]
ORDER_DOWNGRADES = [
    ("STP_PRT", "STP", "LOW"),
    ("MIT", "STP", "MEDIUM"),
    ("LIT", "LMT", "MEDIUM"),
    ("MOC", None, "HIGH"),
    ("MOO", None, "HIGH"),
    ("TRAIL_LMT", None, "HIGH"),
]

MAX_TRUSTED_TIER = 4
WIDE_TOLERANCE = "0.05"
SETTLE_STATES = ["live", "preliminary", "final"]


@dataclass(frozen=True)
class Policy:
    """How quotes of several sources are combined for one field."""

    policy_id: str
    kind: str
    min_quorum: int
    band: str
    timeout_seconds: int = 60
    trusted_only: bool = True

    def signature(self) -> Column:
        text = (
            f'{{"kind": "{self.kind}", "min_quorum": {self.min_quorum}, "policy_id": "{self.policy_id}", '
            f'"require_tier_t2_or_better": {str(self.trusted_only).lower()}, "tolerance_band": "{self.band}"}}'
        )
        return F.sha2(F.lit(text), 256)


# Policy sets. The row without a field is the umbrella that other fields fall back to.
_COMMON = {
    "settle": Policy("settle_exact_v1", "fail_closed", 2, "TIGHT"),
    "tick": Policy("tick_exact_v1", "fail_closed", 2, "TIGHT", 15),
    "oi": Policy("oi_tier_v1", "highest_tier", 1, "NORMAL"),
}
_A1_FIELDS = {
    **_COMMON,
    "ohlc": Policy("ohlc_majority_v1", "majority_vote", 3, "NORMAL"),
    "volume": Policy("volume_majority_v1", "majority_vote", 3, "WIDE"),
}
_C_FIELDS = {
    **_COMMON,
    "ohlc": Policy("ohlc_majority_c_v1", "majority_vote", 3, "NORMAL"),
    "volume": Policy("volume_majority_c_v1", "majority_vote", 3, "WIDE"),
}
POLICY_SETS = {
    "default": {None: Policy("phase_a1_default_v1", "fail_closed", 3, "NORMAL"), **_A1_FIELDS},
    "shadow": {None: Policy("phase_b1_shadow_v1", "fail_closed", 3, "NORMAL"), **_A1_FIELDS},
    "live": {None: Policy("phase_c_live_v1", "majority_vote", 3, "NORMAL"), **_C_FIELDS},
}


def policy_for(policy_set: str, field: str) -> Policy:
    fields = POLICY_SETS[policy_set]
    return fields.get(field, fields[None])


def policy_table(spark: SparkSession) -> DataFrame:
    rows = [
        (s, f, p.policy_id, p.kind, p.min_quorum, p.band, p.timeout_seconds, p.trusted_only)
        for s, fields in POLICY_SETS.items()
        for f, p in fields.items()
    ]
    return spark.createDataFrame(
        rows,
        "policy_set string, field string, policy_id string, kind string, min_quorum int, band string, "
        "timeout_seconds int, trusted_only boolean",
    )


def widen(policy: Policy) -> Policy:
    return replace(policy, band="WIDE")


def root_table(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame(
        ROOTS,
        "root string, multiplier string, margin string, tick string, cycle string, family string, anchor string, "
        "target_offset int, deadline_offset int",
    )
    return df.withColumns({c: F.col(c).cast("decimal(20,8)") for c in ("multiplier", "margin", "tick")})


def series_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        SERIES, "series string, publisher string, release_time string, severity string, size_multiplier double"
    )


def with_root_facts(df: DataFrame, *facts: str, root: str = "root", strict: bool = True) -> DataFrame:
    """Attach per-root constants; in strict mode a root without an entry fails the job."""
    dim = root_table(df.sparkSession).select(F.col("root").alias(root), *facts, F.lit(True).alias("__known"))
    out = df.join(F.broadcast(dim), root, "left")
    if strict:
        known = F.when(
            F.col("__known").isNull(), F.raise_error(F.concat(F.lit("no constants for root "), F.col(root)))
        ).otherwise(F.lit(True))
        out = out.filter(known)
    return out.drop("__known")


def with_facts_as_of(df: DataFrame, facts: DataFrame, names: list[str], at: str, root: str = "root") -> DataFrame:
    """Attach the latest ``facts`` (root, valid_from and ``names``) on or before date or time ``at``.

    Of several facts of one day the greatest in order of ``names`` holds; later facts are never seen. A row
    without a fact by then, or with a null one, fails the job, as a root without constants does.
    """
    from .operators.ordered import best_so_far
    from .operators.pit import days

    best = F.struct(F.col("valid_from"), *[F.col(c) for c in names])
    dated = facts.select(F.col("root").alias(root), "valid_from", *names)
    out = best_so_far(df, dated, [root], days(F.to_date(at)), days(F.to_date("valid_from")), best, 366.0, "__fact")
    missing = F.lit(False)
    for c in names:
        missing = missing | F.col(f"__fact.{c}").isNull()
    text = F.concat(F.lit("no facts for root "), F.coalesce(F.col(root), F.lit("(null)")), F.lit(" by "), F.coalesce(F.col(at).cast("string"), F.lit("(null)")))
    out = out.filter(F.when(missing, F.raise_error(text)).otherwise(F.lit(True)))
    return out.withColumns({c: F.col(f"__fact.{c}") for c in names}).drop("__fact")
