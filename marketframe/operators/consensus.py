"""Cross-source agreement checks.

Quotes of one key (contract and date, or contract, bar time and resolution) are grouped once. Revisions
are reduced to the latest of each source first, so a group holds at most one row per source and its arrays are bounded by the number of sources. The outcome is
``verified``, ``disagreement`` or ``incomplete``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import MAX_TRUSTED_TIER, SETTLE_STATES, WIDE_TOLERANCE, Policy, policy_table
from ..functions.text import iso_utc, provenance_hash
from .ordered import segmented


def trusted(quotes: DataFrame, policy: Policy) -> DataFrame:
    """Drop sources below the trusted tiers when the policy asks for it (a lower tier is better)."""
    return quotes.filter(F.col("tier") <= MAX_TRUSTED_TIER) if policy.trusted_only else quotes


def state_rank(state: Column) -> Column:
    rank = F.lit(None).cast("int")
    for i, s in enumerate(SETTLE_STATES):
        rank = F.when(state == s, i).otherwise(rank)
    return F.when(rank.isNull() & state.isNotNull(), F.raise_error(F.concat(F.lit("unknown settle state "), state))).otherwise(rank)


def state_of(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SETTLE_STATES]), (rank + 1).cast("int"))


def resolve_policies(requests: DataFrame) -> DataFrame:
    """Attach to each (policy_set, field) its own policy, or the set's umbrella."""
    dim = policy_table(requests.sparkSession)
    facts = ["policy_id", "kind", "min_quorum", "band", "timeout_seconds", "trusted_only"]
    own = dim.filter("field IS NOT NULL").select("policy_set", "field", F.struct(*facts).alias("own"))
    umbrella = dim.filter("field IS NULL").select("policy_set", F.struct(*facts).alias("umbrella"))
    out = requests.join(F.broadcast(own), ["policy_set", "field"], "left").join(F.broadcast(umbrella), "policy_set")
    return out.withColumn("p", F.coalesce("own", "umbrella")).select(*requests.columns, "p.*")


def _spread(band: str, n: Column, values: Column, lo: Column, hi: Column, first: Column) -> tuple[Column, Column, Column]:
    """(agreed, representative value, largest difference) of one group's values."""
    if band == "WIDE":
        mid = F.element_at(values, (F.floor(n / 2) + 1).cast("int"))
        width = F.greatest(F.abs(hi - mid), F.abs(lo - mid))
        relative = F.when(mid != 0, width.cast("double") / F.abs(mid).cast("double")).otherwise(
            F.greatest(F.abs(hi), F.abs(lo)).cast("double")
        )
        limit = F.lit(WIDE_TOLERANCE).cast("decimal(4,2)")
        agreed = F.when(mid == 0, (lo == 0) & (hi == 0)).otherwise(width <= F.abs(mid) * limit)
        return agreed, mid, relative
    return lo == hi, first, F.greatest(F.abs(hi - first), F.abs(lo - first)).cast("double")


def run_hash(policy: Policy, provenance: Column, identifier: Column) -> Column:
    return F.sha2(
        F.concat_ws("||", F.lit(policy.policy_id), F.array_join(F.array_sort(provenance), "||"), policy.signature(), identifier),
        256,
    )


def _outcome(policy: Policy, n: Column, agreed: Column) -> Column:
    return F.when(n < policy.min_quorum, "incomplete").when(agreed, "verified").otherwise("disagreement")


def _ordered(column: str) -> Column:
    """Values of a group in source order."""
    pairs = F.array_sort(F.collect_list(F.struct("source_id", F.col(column).alias("v"))))
    return F.transform(pairs, lambda p: p["v"])


def _combine(
    quotes: DataFrame, keys: Sequence[str], value: str, policy: Policy, mode: str, same: Column, extras: list[Column]
) -> DataFrame:
    """Group quotes and decide; ``mode='documented'`` follows the policy kind instead of unanimity.

    A source counts once: of its revisions the latest (by ``as_of``, then hash) is its quote.
    """
    q = trusted(quotes, policy).filter(F.col(value).isNotNull())
    by_source = [*keys, "source_id"]
    rest = [c for c in q.columns if c not in by_source]
    q = q if q.isStreaming else q.repartition(*keys)  # one shuffle for both groupings
    q = q.groupBy(*by_source).agg(F.max_by(F.struct(*rest), F.struct("as_of", "sha")).alias("__q")).select(*by_source, "__q.*")
    q = q.withColumn("__prov", provenance_hash(F.col("source_id"), F.col("as_of"), F.col("sha")))
    grouped = q.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sort_array(F.collect_list(value)).alias("__values"),
        F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.min_by(value, "source_id").alias("__first"),
        F.min("tier").alias("tier"), same.alias("__same"),
        F.sort_array(F.collect_list("source_id")).alias("sources"),
        _ordered(value).alias("__quoted"), _ordered("__prov").alias("provenance"),
        F.min_by(value, F.struct("tier", "source_id")).alias("__top"),
        *extras,
    )
    agreed, rep, diff = _spread(policy.band, F.col("n"), F.col("__values"), F.col("__lo"), F.col("__hi"), F.col("__first"))
    if policy.band != "WIDE":
        agreed = agreed & F.col("__same")
    if mode == "documented" and policy.kind == "majority_vote":
        counts = F.transform(
            F.array_distinct("__quoted"), lambda v: F.struct(F.size(F.filter("__quoted", lambda x: x == v)).alias("c"), v.alias("v"))
        )
        best = F.aggregate(
            counts, F.element_at(counts, 1), lambda a, x: F.when(x["c"] > a["c"], x).otherwise(a)
        )
        grouped = grouped.withColumn("__vote", best)
        agreed, rep = F.col("__vote.c") >= policy.min_quorum, F.col("__vote.v")
    elif mode == "documented" and policy.kind == "highest_tier":
        agreed, rep = F.lit(True), F.col("__top")
    return grouped.withColumn("outcome", _outcome(policy, F.col("n"), agreed)).withColumn("value", rep).withColumn("max_diff", diff)


def settle_consensus(quotes: DataFrame, policy: Policy, mode: str = "implemented") -> DataFrame:
    """One row per (contract, as_of_date) with outcome, value, best state and tier, hashes."""
    out = _combine(
        quotes, ["contract", "as_of_date"], "settle", policy, mode, F.lit(True),
        [F.max(state_rank(F.col("settle_state"))).alias("__rank")],
    )
    identifier = F.concat_ws("||", "contract", F.col("as_of_date").cast("string"), F.lit("settle"))
    done = F.col("outcome") == "verified"
    return out.select(
        "contract", "as_of_date", "outcome", F.when(done, F.col("value")).alias("settle"),
        F.when(done, state_of(F.col("__rank"))).alias("settle_state"), F.col("n").alias("n_sources"),
        F.lit(policy.min_quorum).alias("quorum"), F.when(done, F.col("tier")).alias("tier"), "sources",
        F.transform("__quoted", lambda v: v.cast("string")).alias("quoted"),
        F.when(F.col("outcome") != "incomplete", F.col("max_diff")).alias("max_diff"),
        F.when(done, F.col("provenance")).alias("provenance"),
        F.when(done, run_hash(policy, F.col("provenance"), identifier)).alias("run_hash"),
        F.lit(policy.policy_id).alias("policy_id"),
    )


def bar_consensus(quotes: DataFrame, policy: Policy, mode: str = "implemented") -> DataFrame:
    """One row per (contract, ts, resolution). Exact bands compare the whole bar, WIDE the close."""
    bar = F.struct("open", "high", "low", "close", "volume")
    out = _combine(
        quotes, ["contract", "ts", "resolution"], "close", policy, mode,
        F.min(bar) == F.max(bar), [F.min_by(bar, "source_id").alias("__bar")],
    )
    identifier = F.concat_ws("||", F.col("contract"), iso_utc(F.col("ts")), F.col("resolution"))
    done = F.col("outcome") == "verified"
    return out.select(
        "contract", "ts", "resolution", "outcome",
        *[F.when(done, F.col(f"__bar.{f}")).alias(f) for f in ("open", "high", "low", "close", "volume")],
        F.col("n").alias("n_sources"), F.lit(policy.min_quorum).alias("quorum"), F.when(done, F.col("tier")).alias("tier"),
        "sources", F.when(F.col("outcome") != "incomplete", F.col("max_diff")).alias("max_diff"),
        F.when(done, run_hash(policy, F.col("provenance"), identifier)).alias("run_hash"),
        F.lit(policy.policy_id).alias("policy_id"),
    )


def field_consensus(quotes: DataFrame, keys: Sequence[str], field: str, policy: Policy, mode: str = "implemented") -> DataFrame:
    """Consensus on any single numeric field (volume, open interest, ...)."""
    out = _combine(quotes, keys, field, policy, mode, F.lit(True), [])
    done = F.col("outcome") == "verified"
    return out.select(*keys, "outcome", F.when(done, F.col("value")).alias(field), F.col("n").alias("n_sources"),
                      F.lit(policy.policy_id).alias("policy_id"))


def pending_sources(outcomes: DataFrame, sources: DataFrame, policy: Policy) -> DataFrame:
    """For incomplete rows, the eligible sources that did not answer.

    ``sources`` is the (source_id, tier) dimension; it becomes one array on one row.
    """
    eligible = trusted(sources, policy).agg(F.sort_array(F.collect_set("source_id")).alias("__eligible"))
    eligible = eligible.withColumn("policy_id", F.lit(policy.policy_id))
    return (
        outcomes.filter("outcome = 'incomplete'")
        .join(F.broadcast(eligible), "policy_id")
        .withColumn("pending", F.array_except("__eligible", "sources"))
        .drop("__eligible")
    )


def chain_hashes(verified: DataFrame, segment: str = "day") -> DataFrame:
    """Attach to each verified bar the hash of the one before it (per contract and resolution)."""
    return segmented(
        verified, ["contract", "resolution"], ["ts"], F.unix_timestamp(F.date_trunc(segment, "ts")),
        {"prev_hash": ("lag", F.col("run_hash"))},
    )
