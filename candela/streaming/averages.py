"""Recursive indicators of a stream: an exponential average and Wilder's relative strength, kept as state by asset."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

COLUMNS = "asset string, ts timestamp, close double, ema double, rsi double"
_STATE = "n long, close double, ema double, gain double, loss double"


def step(state: tuple | None, close: float, span: int, n: int) -> tuple:
    """The state after one more close: closes so far, the last one, the average, and the average gain and loss (until there
    are n changes: their sums)."""
    if state is None:
        return 1, close, close, 0.0, 0.0
    seen, before, ema, gain, loss = state
    alpha, change = 2.0 / (span + 1), close - before
    up, down = max(change, 0.0), max(-change, 0.0)
    if seen < n:
        gain, loss = gain + up, loss + down
    elif seen == n:
        gain, loss = (gain + up) / n, (loss + down) / n
    else:
        gain, loss = gain + (up - gain) / n, loss + (down - loss) / n
    return seen + 1, close, (1 - alpha) * ema + alpha * close, gain, loss


def told(state: tuple, span: int, n: int) -> tuple[float | None, float | None]:
    """The average, from `span` closes on, and the relative strength, from n changes on (50 without any change)."""
    seen, _, ema, gain, loss = state
    rsi = None if seen <= n else 50.0 if gain + loss == 0 else 100 * gain / (gain + loss)
    return ema if seen >= span else None, rsi


class _Averages(StatefulProcessor):
    """Closes wait until the watermark has passed them, each with a timer; then they are taken in order of time, in
    whatever batches and order they came. Of closes of one time the last to come counts."""

    def __init__(self, span: int, n: int) -> None:
        self.span, self.n = span, n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", _STATE)
        self.waiting = handle.getMapState("waiting", "ms long", "close double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for ts, close in zip(frame["ts"], frame["close"]):
                at = int(ts.value // 1_000_000)
                self.waiting.updateValue((at,), (float(close),))
                self.handle.registerTimer(at)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if not self.waiting.containsKey((at,)):
            return
        close = self.waiting.getValue((at,))[0]
        self.waiting.removeKey((at,))
        state = step(tuple(self.state.get()) if self.state.exists() else None, close, self.span, self.n)
        self.state.update(state)
        ema, rsi = told(state, self.span, self.n)
        yield pd.DataFrame({"asset": [key[0]], "ts": [pd.Timestamp(at, unit="ms")], "close": [close], "ema": pd.Series([ema], dtype="float64"), "rsi": pd.Series([rsi], dtype="float64")})

    def close(self) -> None:
        pass


def averages(closes: DataFrame, span: int = 12, n: int = 14, late: str = "1 hour") -> DataFrame:
    """asset, ts, close, ema and rsi of a stream (asset, ts, close): a close is given out once nothing earlier can come any
    more, `late` after it in event time; what comes later is dropped. Times count to the millisecond; closes that are
    null aren't taken. The state of an asset is five numbers and the closes that wait.

    The session's state store has to be the one of RocksDB (spark.sql.streaming.stateStore.providerClass)."""
    timed = closes.where("close IS NOT NULL").select("asset", F.col("ts").cast("timestamp").alias("ts"), "close").withWatermark("ts", late)
    return timed.groupBy("asset").transformWithStateInPandas(_Averages(span, n), outputStructType=COLUMNS, outputMode="Append", timeMode="EventTime")
