"""All registered queries and SQL twins."""

from __future__ import annotations

from . import feed_queries, quote_queries, resample_queries, stat_queries, stream_queries, trade_queries

_MODULES = [quote_queries, trade_queries, stat_queries, resample_queries, feed_queries, stream_queries]

QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: text for m in _MODULES for name, text in m.ORACLES.items()}
