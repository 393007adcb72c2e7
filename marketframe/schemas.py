"""Record schemas and the rules every record must obey."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dims import SETTLE_STATES
from .functions.contracts import is_contract

PRICE = "decimal(20,8)"

SCHEMAS = {
    "bar": f"contract string, ts timestamp, resolution string, open {PRICE}, high {PRICE}, low {PRICE}, close {PRICE}, volume bigint, "
           "oi bigint, source_id string, as_of timestamp, sha string",
    "settle": f"contract string, as_of_date date, settle {PRICE}, settle_state string, open {PRICE}, high {PRICE}, low {PRICE}, last {PRICE}, "
              f"change {PRICE}, volume_est bigint, oi_prior bigint, source_id string, as_of timestamp, sha string",
    "tick": f"contract string, ts timestamp, price {PRICE}, size bigint, side string, source_id string, as_of timestamp, sha string",
    "macro_event": "event_id string, series string, publisher string, release_at timestamp, source_url string, sha string, embargo_minutes int",
    "macro_value": "event_id string, series string, ref_date date, known_at timestamp, value double, is_void boolean, sha string",
    "cot": "code string, flavor string, report_date date, known_at timestamp, open_interest bigint, spec_long bigint, spec_short bigint, "
           "comm_long bigint, comm_short bigint, traders bigint, sha string",
    "signal": "contract string, ts timestamp, strategy_id string, direction int, kelly double, confidence double",
    "order": f"order_id bigint, contract string, ts timestamp, side string, quantity bigint, order_type string, limit_price {PRICE}, stop_price {PRICE}",
    "fill_event": f"order_id bigint, event_type string, fill_price {PRICE}, fill_quantity bigint, cumulative_filled bigint, remaining bigint, ts timestamp, sha string",
    "position": f"contract string, quantity bigint, avg_entry_price {PRICE}, margin_used {PRICE}",
    "session": "session_date date, qualified boolean, contracts bigint, entry_price string, exit_price string, session_pnl string, cost string, cumulative_pnl string",
}

# Order types that need a limit or a stop price.
NEEDS_LIMIT = ["LMT", "STP_LMT", "LIT", "TRAIL_LMT"]
NEEDS_STOP = ["STP", "STP_LMT", "STP_PRT", "MIT"]


def _at_least(column: str, low: int = 0) -> Column:
    return F.col(column) < low


def _sha() -> Column:
    return F.length("sha") != 64


def rules(kind: str) -> dict[str, Column]:
    """Name and violation test of each rule of a record kind; a null test means no violation."""
    c = F.col
    price_range = {"high below low": c("high") < c("low")}
    book = {
        "bar": {**price_range, "negative volume": _at_least("volume"), "negative oi": _at_least("oi"), "bad sha": _sha(),
                "no time": c("ts").isNull() | c("as_of").isNull(), "bad contract": ~is_contract(c("contract"))},
        "settle": {**price_range, "negative volume": _at_least("volume_est"), "negative oi": _at_least("oi_prior"), "bad sha": (c("sha") != "") & _sha(),
                   "unknown state": ~c("settle_state").isin(SETTLE_STATES)},
        "tick": {"size not positive": c("size") <= 0, "price not positive": c("price") <= 0, "bad side": ~c("side").isin("bid", "ask", "trade"), "bad sha": _sha()},
        "macro_event": {"no event id": F.coalesce(c("event_id"), F.lit("")) == "", "no source url": F.coalesce(c("source_url"), F.lit("")) == "",
                        "negative embargo": _at_least("embargo_minutes"), "bad sha": _sha()},
        "macro_value": {"no event id": F.coalesce(c("event_id"), F.lit("")) == "", "void with a value": c("is_void") & c("value").isNotNull(),
                        "no value": ~c("is_void") & c("value").isNull(), "value not finite": F.isnan("value") | (F.abs("value") == float("inf")), "bad sha": _sha()},
        "cot": {"no code": F.coalesce(c("code"), F.lit("")) == "",
                **{f"negative {n}": _at_least(n) for n in ("open_interest", "spec_long", "spec_short", "comm_long", "comm_short", "traders")}, "bad sha": _sha()},
        "signal": {"bad direction": ~c("direction").isin(-1, 0, 1), "negative kelly": c("kelly") < 0, "confidence out of range": (c("confidence") < 0) | (c("confidence") > 1),
                   "flat with size": (c("direction") == 0) & (c("kelly") != 0)},
        "order": {"quantity not positive": c("quantity") <= 0, "limit price missing": c("order_type").isin(NEEDS_LIMIT) & c("limit_price").isNull(),
                  "stop price missing": c("order_type").isin(NEEDS_STOP) & c("stop_price").isNull()},
        "fill_event": {"negative filled": _at_least("cumulative_filled"), "negative remaining": _at_least("remaining"), "negative quantity": _at_least("fill_quantity"), "bad sha": _sha()},
        "position": {"negative margin": _at_least("margin_used"), "no entry price": (c("quantity") != 0) & (c("avg_entry_price") <= 0)},
        "carry": {"price not positive": (c("front_close") <= 0) | (c("back_close") <= 0), "bad day counts": ~((c("days_front") > 0) & (c("days_front") < c("days_back")))},
        "roll_entry": {"target after deadline": c("roll_target") > c("roll_deadline"), "deadline after last trade": c("roll_deadline") > c("ltd")},
    }
    return book[kind]
