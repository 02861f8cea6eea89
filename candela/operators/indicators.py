"""Technical indicators that are plain window expressions over a normalised panel.

Each builder takes the panel's column names for granted (asset, d, close and, where there are, open, high, low, volume)
and returns named columns, so that any choice of them is one projection over one exchange and sort. Without high or low
the close stands in; volume indicators need a volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.windows import full, ordered, ratio, rows, so_far

C = F.col


def sma(n: int, value: str = "close") -> Column:
    return full(C(value), F.avg(value).over(rows(n)), n)


def bollinger(n: int = 20, k: float = 2.0) -> dict[str, Column]:
    """Middle, bands at k population deviations, place within them and their width in percent of the middle."""
    middle = sma(n)
    sigma = full(C("close"), F.stddev_pop("close").over(rows(n)), n)
    upper, lower = middle + k * sigma, middle - k * sigma
    return {"bb_mid": middle, "bb_up": upper, "bb_low": lower, "bb_pct": ratio(C("close") - lower, upper - lower), "bb_width": ratio(upper - lower, middle) * 100}


def high_low(columns: list[str]) -> tuple[str, str]:
    return ("high" if "high" in columns else "close", "low" if "low" in columns else "close")


def stochastic(high: str = "high", low: str = "low", n: int = 14) -> dict[str, Column]:
    """%K over n days; 50 where the range is nothing. %D is its average over three days: see with_stochastic."""
    top, bottom = full(C(high), F.max(high).over(rows(n)), n), full(C(low), F.min(low).over(rows(n)), n)
    k = F.when(top.isNotNull() & bottom.isNotNull(), F.coalesce(ratio(C("close") - bottom, top - bottom) * 100, F.lit(50.0)))
    williams = F.when(top.isNotNull() & bottom.isNotNull(), F.coalesce(ratio(top - C("close"), top - bottom) * -100, F.lit(-50.0)))
    return {"stoch_k": k, "williams_r": williams}


def with_stochastic(panel: DataFrame) -> DataFrame:
    high, low = high_low(panel.columns)
    return panel.withColumns(stochastic(high, low)).withColumn("stoch_d", sma(3, "stoch_k"))


def true_range(high: str = "high", low: str = "low") -> Column:
    before = F.lag("close").over(ordered())
    return F.when(before.isNotNull(), F.greatest(C(high) - C(low), F.abs(C(high) - before), F.abs(C(low) - before)))


def obv() -> Column:
    """Volume summed with the sign of the close's change, from zero."""
    change = C("close") - F.lag("close").over(ordered())
    return F.sum(F.coalesce(F.signum(change), F.lit(0.0)) * F.coalesce("volume", F.lit(0.0))).over(so_far())


def aroon(high: str = "high", low: str = "low", n: int = 25) -> dict[str, Column]:
    """How recent the oldest extreme of n + 1 days is, in percent."""
    span = rows(n + 1)
    enough = F.count("close").over(span) >= n + 1
    place = lambda c, extreme: F.array_position(F.collect_list(c).over(span), extreme(c).over(span)) - 1
    up, down = (F.when(enough, place(c, f) * 100.0 / n) for c, f in ((high, F.max), (low, F.min)))
    return {"aroon_up": up, "aroon_down": down, "aroon_osc": up - down}


def roc(n: int) -> Column:
    return (ratio(C("close"), F.lag("close", n).over(ordered())) - 1) * 100


def volume_columns(n: int = 20) -> dict[str, Column]:
    average = sma(n, "volume")
    return {"volume_sma": average, "volume_ratio": ratio(C("volume"), average), "obv": obv()}


def declarative(panel: DataFrame) -> DataFrame:
    """The panel with all indicators of this module."""
    high, low = high_low(panel.columns)
    columns = {f"sma_{n}": sma(n) for n in (20, 50, 200)} | bollinger() | stochastic(high, low) | {"true_range": true_range(high, low)} | aroon(high, low) | {f"roc_{n}": roc(n) for n in (10, 20)}
    columns |= volume_columns() if "volume" in panel.columns else {}
    wide = panel.withColumns(columns).withColumn("stoch_d", sma(3, "stoch_k"))
    return wide.withColumn("obv_sma", sma(20, "obv")) if "volume" in panel.columns else wide
