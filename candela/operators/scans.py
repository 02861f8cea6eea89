"""Recursive (exponential) indicators: one grouped pass over each asset's series computes all of them.

Spark SQL has no prefix fold, so the recursions run in NumPy on one asset's days at a time, a bounded series; everything
that doesn't recur stays a window expression. Missing inputs keep the last output and let its weight decay.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela import config
from candela.operators import indicators
from candela.windows import ordered


def decayed(x: np.ndarray, alpha: float) -> np.ndarray:
    """m = (1 - alpha) m + alpha x from the first value on; after a gap the old weight has decayed with each day of it."""
    out, m, w = np.full(len(x), np.nan), np.nan, 1.0
    for k, value in enumerate(x):
        if m != m:
            m, w = value, 1.0
        elif value == value:
            w *= 1 - alpha
            m = (1 - alpha) * m + alpha * value if w == 1 - alpha else (w * m + alpha * value) / (w + alpha)
            w = 1.0
        else:
            w *= 1 - alpha
        out[k] = m
    return out


def ema(x: np.ndarray, span: int, masked: bool = True) -> np.ndarray:
    """Exponential average by span; masked: missing until there are so many values."""
    out = decayed(x, 2.0 / (span + 1))
    return np.where(np.cumsum(~np.isnan(x)) >= span, out, np.nan) if masked else out


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    """Wilder's average: the mean of the first n values at the n-th, then alpha = 1 / n."""
    at = np.flatnonzero(~np.isnan(x))
    out = np.full(len(x), np.nan)
    if len(at) >= n:
        rest = x[at[n - 1] :].copy()
        rest[0] = x[at[:n]].mean()
        out[at[n - 1] :] = decayed(rest, 1.0 / n)
    return out


def rsi(close: np.ndarray, n: int = 14) -> np.ndarray:
    """100 where there were no losses, 50 where there was no change."""
    change = np.r_[np.nan, np.diff(close)]
    gain, loss = wilder(np.where(np.isnan(change), np.nan, np.maximum(change, 0)), n), wilder(np.where(np.isnan(change), np.nan, np.maximum(-change, 0)), n)
    with np.errstate(divide="ignore", invalid="ignore"):
        value = 100 - 100 / (1 + gain / loss)
    return np.where(np.isnan(gain), np.nan, np.where(loss == 0, np.where(gain == 0, 50.0, 100.0), value))


def macd(close: np.ndarray, fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[np.ndarray, np.ndarray]:
    line = np.where(np.cumsum(~np.isnan(close)) >= slow, ema(close, fast, False) - ema(close, slow, False), np.nan)
    return line, decayed(line, 2.0 / (signal + 1))


def directional(high: np.ndarray, low: np.ndarray, span: np.ndarray, n: int = 14) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ADX and the two directional indicators, from the true range."""
    up, down = np.r_[np.nan, np.diff(high)], np.r_[np.nan, -np.diff(low)]
    plus = np.where(np.isnan(up), np.nan, np.where((up > down) & (up > 0), up, 0.0))
    minus = np.where(np.isnan(up), np.nan, np.where((down > up) & (down > 0), down, 0.0))
    with np.errstate(divide="ignore", invalid="ignore"):
        atr = wilder(span, n)
        atr = np.where(atr == 0, np.nan, atr)
        di_plus, di_minus = 100 * wilder(plus, n) / atr, 100 * wilder(minus, n) / atr
        total = di_plus + di_minus
        dx = 100 * np.abs(di_plus - di_minus) / np.where(total == 0, np.nan, total)
    return wilder(dx, n), di_plus, di_minus


def ewma_volatility(returns: np.ndarray, decay: float = 0.94) -> np.ndarray:
    """RiskMetrics volatility, annualised, in percent."""
    return np.sqrt(decayed(returns * returns, 1 - decay) * config.PERIODS) * 100


OUTPUTS = ("ema_12", "ema_26", "ema_50", "macd", "macd_signal", "macd_hist", "rsi", "atr", "adx", "di_plus", "di_minus", "ewma_vol")


def _columns(frame: pd.DataFrame) -> dict[str, np.ndarray]:
    close, high, low, span, returns = (frame[c].to_numpy(dtype=float) for c in ("close", "__high", "__low", "__tr", "__r"))
    line, signal = macd(close)
    adx, plus, minus = directional(high, low, span)
    values = (ema(close, 12), ema(close, 26), ema(close, 50), line, signal, line - signal, rsi(close), wilder(span, 14), adx, plus, minus, ewma_volatility(returns))
    return dict(zip(OUTPUTS, values))


def recursive(panel: DataFrame) -> DataFrame:
    """The panel with all recursive indicators."""
    high, low = indicators.high_low(panel.columns)
    extra = {"__high": F.col(high), "__low": F.col(low), "__tr": indicators.true_range(high, low), "__r": F.col("close") / F.lag("close").over(ordered()) - 1}
    fields = [f for f in panel.schema.fields]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"{c} double" for c in OUTPUTS])
    names = [f.name for f in fields]

    def scan(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("d")
        return frame[names].assign(**_columns(frame))

    out = panel.withColumns(extra).groupBy("asset").applyInPandas(scan, schema)
    return out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in OUTPUTS})


def pulled(rows: DataFrame, shock: str, mean: float = 0.0, keeps: float = 1.0, low: float = float("-inf"), high: float = float("inf"), start: float | None = None, key: str = "asset", at: str = "d") -> DataFrame:
    """rows with `level`, by key in order of `at`: each keeps a part of the last level's distance from the mean and adds its
    shock, and the level is held between low and high before the next row takes it (which no window can say). It
    begins at the mean, if not at `start`; a missing shock is none. A key's rows are one task's."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "level double"])

    def scan(frame: pd.DataFrame) -> pd.DataFrame:
        frame, level, out = frame.sort_values(at, kind="stable"), mean if start is None else start, []
        for x in np.nan_to_num(frame[shock].to_numpy(dtype=float)).tolist():
            level = min(max(mean + keeps * (level - mean) + x, low), high)
            out.append(level)
        return frame.assign(level=out)

    return rows.groupBy(key).applyInPandas(scan, schema)


def bundle(panel: DataFrame) -> DataFrame:
    """All indicators, with the average range in percent of the close."""
    return recursive(indicators.declarative(panel)).withColumn("atr_pct", F.col("atr") / F.col("close") * 100)
