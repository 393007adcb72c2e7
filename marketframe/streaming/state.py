"""Keyed state in event-time order: positions per account and root, and the loss-limit latch per account.

Fills may come in any order. A key's rows are held, in pieces by bucket of event time, until the watermark has
passed the bucket; then the bucket is sorted and folded into the key's state. What a task holds of a key is one
bucket, whatever the key's share of all rows; ``width`` makes buckets as narrow as the busiest key needs. A row
whose bucket was folded before it came changes nothing: it goes out marked ``late``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

POSITION_OUT = "account bigint, root string, d date, qty bigint, net bigint, avg_price double, realised double, gain double, trade_pnl double, late boolean"
LATCH_OUT = "account bigint, session string, d date, verdict string, equity_before double, late boolean"
DAY = 86_400_000
_AT = "__at"


def _rankable(column: pd.Series) -> np.ndarray:
    """Values that sort as numbers; dates and texts, which come as objects, by the places of their distinct values."""
    return column.to_numpy() if column.dtype != object else pd.factorize(column, sort=True)[0]


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


class InOrder(StatefulProcessor):
    """Hands each key's rows to ``fold`` in order, a bucket of event time at a time.

    Held rows lie in map state as Arrow pieces, one for each chunk of input that met the bucket, so nothing
    that is held is read or written again before its time. A timer at the end of a bucket wakes the key.
    """

    OUT = STATE = ""
    START: tuple = ()

    def __init__(self, names: list[str], order: list[str], width: int) -> None:
        self.names, self.order, self.width = names, order, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.STATE)
        self.done = handle.getValueState("done", "bucket bigint")
        self.held = handle.getMapState("held", "bucket bigint, piece int", "piece binary")
        self.pieces = handle.getMapState("pieces", "bucket bigint", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done = self.done.get()[0] if self.done.exists() else None
        for frame in rows:
            if frame.empty:  # a key that only its timer wakes
                continue
            frame.columns = self.names  # a computed column can come without its name
            for bucket, part in frame.groupby(frame[_AT] // self.width):
                bucket = int(bucket)
                if done is not None and bucket <= done:
                    yield self.late(key, part)
                    continue
                n = self.pieces.getValue((bucket,))[0] if self.pieces.containsKey((bucket,)) else 0
                table = pa.Table.from_pandas(part, preserve_index=False)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema) as writer:
                    writer.write_table(table)
                self.held.updateValue((bucket, n), (sink.getvalue().to_pybytes(),))
                self.pieces.updateValue((bucket,), (n + 1,))
                if not n:
                    self.handle.registerTimer((bucket + 1) * self.width)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = expiredTimerInfo.getExpiryTimeInMs() // self.width - 1
        state = self.state.get() if self.state.exists() else self.START
        for bucket in sorted(int(b) for (b,) in self.pieces.keys() if b <= last):
            n = self.pieces.getValue((bucket,))[0]
            rows = pd.concat([pa.ipc.open_stream(self.held.getValue((bucket, k))[0]).read_pandas() for k in range(n)])
            state, out = self.fold(key, state, rows.iloc[np.lexsort([_rankable(rows[c]) for c in reversed([_AT, *self.order])])])
            for k in range(n):
                self.held.removeKey((bucket, k))
            self.pieces.removeKey((bucket,))
            yield out
        self.state.update(state)
        if not self.done.exists() or self.done.get()[0] < last:
            self.done.update((last,))

    def late(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        """The output rows of what came too late: what is known of them, and the mark."""
        known = {n: rows[n] for n in _names(self.OUT) if n in rows}
        out = pd.DataFrame(known, index=rows.index).assign(**self.key_columns(key), late=True)
        return out.reindex(columns=_names(self.OUT))

    def key_columns(self, key) -> dict:
        return {"account": key[0]}

    def fold(self, key, state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Positions(InOrder):
    """Average-cost position after every fill; a closed trade reports its profit."""

    OUT = POSITION_OUT
    STATE = "net bigint, cost double, realised double, open_pnl double"
    START = (0, 0.0, 0.0, 0.0)

    def key_columns(self, key) -> dict:
        return {"account": key[0], "root": key[1]}

    def fold(self, key, state, rows):
        net, avg, realised, open_pnl = state
        out = {c: [] for c in ("net", "avg_price", "realised", "gain", "trade_pnl")}
        for qty, price, multiplier in zip(rows["qty"].tolist(), rows["price"].astype("float64").tolist(), rows["multiplier"].astype("float64").tolist()):
            gain, closed = 0.0, None
            after = net + qty
            if net * qty < 0:
                gain = (price - avg) * min(abs(net), abs(qty)) * (1 if net > 0 else -1) * multiplier
                realised, open_pnl = realised + gain, open_pnl + gain
                if after * net <= 0:
                    closed, open_pnl = open_pnl, 0.0
                    avg = price if after else 0.0
            elif after:
                avg = (avg * abs(net) + price * abs(qty)) / abs(after)
            net = after
            for name, x in zip(out, (net, avg, realised, gain, closed)):
                out[name].append(x)
        known = rows[["d", "qty"]].reset_index(drop=True).assign(account=key[0], root=key[1], late=False, **out)
        return (net, avg, realised, open_pnl), known[_names(self.OUT)]


class LossLatch(InOrder):
    """Judges each fill of a log on the profit known before it; the first breach halts the account.

    A new session starts over: nothing realised, the peak at the start, not halted. Sessions follow each
    other in time.
    """

    OUT = LATCH_OUT
    STATE = "total double, peak double, halted boolean, session string"
    START = (0.0, 0.0, False, None)

    def __init__(self, names: list[str], order: list[str], width: int, daily_loss: float, trailing_loss: float, max_contracts: int, start: float) -> None:
        super().__init__(names, order, width)
        self.daily, self.trailing, self.cap, self.start = daily_loss, trailing_loss, max_contracts, start

    def fold(self, key, state, rows):
        total, peak, halted, session = state
        verdicts, equity = [], []
        for now, net, qty, gain in zip(rows["session"].tolist(), rows["net"].tolist(), rows["qty"].tolist(), rows["gain"].tolist()):
            if now != session:
                total, peak, halted, session = 0.0, 0.0, False, now
            if abs(net) < abs(net - qty):
                verdict = "reduce"
            elif halted:
                verdict = "halted"
            elif abs(net) > self.cap:
                verdict = "max_contracts"
            else:
                peak = max(peak, total)
                verdict = "loss_limit" if total <= -self.daily else "trailing_limit" if peak - total >= self.trailing else "allowed"
                halted = verdict != "allowed"
            verdicts.append(verdict)
            equity.append(self.start + total)
            total += gain
        known = rows[["session", "d"]].reset_index(drop=True).assign(account=key[0], verdict=verdicts, equity_before=equity, late=False)
        return (total, peak, halted, session), known[_names(self.OUT)]


def _held(rows: DataFrame, time: str, delay: str) -> DataFrame:
    """Rows under a watermark, their time as milliseconds.

    The time column itself is left out: with it, Spark would drop late rows before the state sees them.
    """
    return rows.withWatermark(time, delay).withColumn(_AT, F.unix_millis(time)).drop(time)


def position_stream(fills: DataFrame, order: list[str], time: str = "ts", delay: str = "1 day", width: int = DAY) -> DataFrame:
    """Fills (account, root, d, qty, price, multiplier, ``time`` and the ordering columns) to positions.

    ``delay`` is how much later than the newest fill another may come; ``width`` (milliseconds) is the span
    of time that is sorted at once. ``order`` must agree with ``time``.
    """
    held = _held(fills, time, delay)
    return held.groupBy("account", "root").transformWithStateInPandas(Positions(held.columns, order, width), POSITION_OUT, "Append", "EventTime")


def latch_stream(log: DataFrame, order: list[str], daily_loss: float, trailing_loss: float, max_contracts: int, start: float = 50000.0,
                 time: str = "ts", delay: str = "1 day", width: int = DAY, session: Column | None = None) -> DataFrame:
    """Fill log (account, d, qty, net, gain, ``time`` and the ordering columns) to verdicts.

    ``session`` names the session a row belongs to; limits start over with each. Without it there is one.
    """
    named = log.withColumn("session", F.lit("") if session is None else session.cast("string"))
    held = _held(named, time, delay)
    latch = LossLatch(held.columns, order, width, daily_loss, trailing_loss, max_contracts, start)
    return held.groupBy("account").transformWithStateInPandas(latch, LATCH_OUT, "Append", "EventTime")
