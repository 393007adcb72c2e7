"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores. ``prepare`` is the time to derive and store
the market-data views from the given tables; each query is then run once to completion into a no-op
sink, so nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

from marketframe.plans import catalog, quote_queries, resample_queries, stat_queries, trade_queries, views
from marketframe.session import local_session

HEADLINES = [
    "A1_settle_consensus_exact", "A2_bar_consensus_wide", "J1_latest_settle_asof", "J1_A1_verified_settle_asof", "J3_macro_vintage_asof",
    "J4_T5_splice", "J5_roll_events", "J6_carry_inputs", "J8_order_fills", "J13_mark_price", "W1_roll_flags", "W2_roll_clean_returns",
    "W7_trade_ledger", "W8_average_cost", "W10_loss_limits", "W11_equity_curve", "X1_capped_sizing", "A7_performance", "A10_probabilistic_sharpe",
    "A12_deflated_sharpe", "A14_winsorised_sharpe", "A17_quantile_skew", "W9_trailing_sharpe", "R1_stationary_bootstrap", "R5_block_ci_stationary_mean",
    "R6_bca_interval", "R7_permutation_sign_flip", "R8_T2_reality_check", "R9_superior_ability", "R10_stepdown", "R11_U4_overfitting_probability",
    "R14_survival", "R17_promotion", "C3_roll_calendar", "S7_venue_bars", "S17_marker_lines",
]
STORED = [
    views.v_bars, views.v_quotes, views.v_base, views.v_roll, views.v_contract_bars, views.v_settles, views.v_ret, views.v_ret_m, views.v_panel,
    views.v_equity, views.v_fills, views.v_orders, views.v_macro, trade_queries.v_win, trade_queries.v_spliced, trade_queries.v_flags,
    trade_queries.v_events, trade_queries.v_signals, resample_queries.v_fam, resample_queries.v_means, stat_queries.v_cal, quote_queries.v_venue_bars,
]


def main(names: list[str]) -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    t0 = time.time()
    for build in STORED:
        build(spark, sf)
    times = {"prepare": round(time.time() - t0, 3)}
    for name in names or HEADLINES:
        t0 = time.time()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main(sys.argv[1:])
