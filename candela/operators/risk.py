"""Return, volatility, tail and drawdown measures by asset, as grouped aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela import config, tables
from candela.operators import normalize
from candela.windows import full, ordered, ratio, rows, so_far, whole

C = F.col
N = config.PERIODS


def safe(a: Column, spread: Column) -> Column:
    """a / spread, null unless the spread is over a tiny number."""
    return F.when(spread > config.EPSILON, a / spread)


def cagr(returns: Column) -> Column:
    """Compound growth a year; -1 if nothing is left. Written with logarithms, which neither overflow nor underflow."""
    lost = F.min(returns) <= -1
    return F.when(lost, -1.0).otherwise(F.exp(F.sum(F.when(returns > -1, F.log1p(returns))) * N / F.count(returns)) - 1)


def sharpe(returns: Column, rate: float) -> Column:
    return F.when(F.count(returns) >= 2, safe((F.avg(returns) - rate / N) * math.sqrt(N), F.stddev_samp(returns)))


def sortino(returns: Column, rate: float) -> Column:
    """The downside deviation is over all days with a return."""
    excess = returns - rate / N
    below = F.when(excess < 0, excess * excess).when(excess >= 0, 0.0)
    return F.when(F.count(returns) >= 2, safe(F.avg(excess) * math.sqrt(N), F.sqrt(F.avg(below))))


def ratios(panel: DataFrame, rate: float = 0.0) -> DataFrame:
    r = C("returns")
    return panel.groupBy("asset").agg(cagr(r).alias("cagr"), (F.stddev_samp(r) * math.sqrt(N)).alias("volatility"), sharpe(r, rate).alias("sharpe"), sortino(r, rate).alias("sortino"))


def window_volatilities(panel: DataFrame, windows: tuple[int, ...] = (7, 30, 90, 365)) -> DataFrame:
    """Annualised volatility of the last days in percent, null if there are fewer returns."""
    last = panel.where("returns IS NOT NULL").withColumn("__n", F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("d")))).where(C("__n") <= max(windows))
    of = lambda w: F.when(F.count_if(C("__n") <= w) == w, F.stddev_samp(F.when(C("__n") <= w, C("returns"))) * math.sqrt(N) * 100)
    return last.groupBy("asset").agg(*(of(w).alias(f"vol_{w}") for w in windows))


def rolling_volatility(n: int = 30) -> Column:
    return full(C("returns"), F.stddev_samp("returns").over(rows(n)), n) * math.sqrt(N) * 100


def value_at_risk(panel: DataFrame) -> DataFrame:
    """Historical, normal and Cornish-Fisher value at risk and the expected shortfall at 95 and 99 percent."""
    r = panel.where("returns IS NOT NULL").select("asset", "returns")
    stats = r.groupBy("asset").agg(*(F.percentile("returns", F.lit(p)).alias(f"var_{q}") for p, q in ((0.05, 95), (0.01, 99))), F.avg("returns").alias("mu"), F.stddev_samp("returns").alias("sd"), F.skewness("returns").alias("s"), F.kurtosis("returns").alias("k"))
    short = r.join(stats.select("asset", "var_95", "var_99"), "asset").groupBy("asset").agg(*(F.avg(F.when(C("returns") <= C(f"var_{q}"), C("returns"))).alias(f"cvar_{q}") for q in (95, 99)))
    cf = lambda z: z + (z * z - 1) * C("s") / 6 + (z**3 - 3 * z) * C("k") / 24 - (2 * z**3 - 5 * z) * C("s") * C("s") / 36
    out = stats.join(short, "asset")
    for q, z in ((95, config.Z05), (99, config.Z01)):
        out = out.withColumns({f"normal_var_{q}": C("mu") + z * C("sd"), f"cf_var_{q}": C("mu") + cf(z) * C("sd")})
    return out.drop("mu", "sd", "s", "k")


def tails(panel: DataFrame) -> DataFrame:
    """Skew, excess kurtosis, the Jarque-Bera test, days beyond three deviations, best and worst day, share of gains."""
    r = panel.where("returns IS NOT NULL").select("asset", "d", "returns")
    stats = r.groupBy("asset").agg(
        F.count("*").alias("n"), F.avg("returns").alias("mu"), F.stddev_samp("returns").alias("sd"), F.skewness("returns").alias("skew"), F.kurtosis("returns").alias("kurtosis"),
        F.max("returns").alias("best"), F.min_by("d", F.struct(-C("returns"), "d")).alias("best_day"), F.min("returns").alias("worst"), F.min_by("d", F.struct("returns", "d")).alias("worst_day"),
        (F.avg((C("returns") > 0).cast("double")) * 100).alias("positive_pct"),
    )
    jb = C("n") / 6.0 * (C("skew") * C("skew") + C("kurtosis") * C("kurtosis") / 4)
    beyond = r.join(stats.select("asset", "mu", "sd"), "asset").groupBy("asset").agg(F.count_if(F.abs(C("returns") - C("mu")) > 3 * C("sd")).alias("extreme_days"))
    out = stats.withColumn("jb_p", F.exp(-jb / 2)).withColumn("is_normal", C("jb_p") > 0.05).withColumn("expected_extremes", C("n") * math.erfc(3 / math.sqrt(2)))
    return out.join(beyond, "asset").drop("mu", "sd")


def drawdowns(panel: DataFrame, value: str = "close") -> DataFrame:
    peak = F.max(value).over(so_far())
    return panel.withColumn("peak", peak).withColumn("drawdown", C(value) / C("peak") - 1)


def drawdown_summary(panel: DataFrame, value: str = "close") -> DataFrame:
    """The deepest fall: its trough (the first such day), its peak (the last day at it before), its recovery (the first
    day at the peak again, if any), the days until then or the end, and the fall on the last day."""
    curve = drawdowns(panel, value)
    troughs = curve.groupBy("asset").agg(F.min("drawdown").alias("max_drawdown"), F.min_by("d", F.struct("drawdown", "d")).alias("trough_day"), F.max("d").alias("last_day"), F.max_by("drawdown", "d").alias("current"))
    level = curve.join(troughs, "asset").withColumn("__top", F.max(F.when(C("d") == C("trough_day"), C("peak"))).over(whole()))
    days = level.groupBy("asset").agg(
        F.first("max_drawdown").alias("max_drawdown"), F.first("trough_day").alias("trough_day"), F.first("current").alias("current"), F.first("last_day").alias("last_day"),
        F.max(F.when((C("d") <= C("trough_day")) & (C(value) == C("__top")), C("d"))).alias("peak_day"),
        F.min(F.when((C("d") > C("trough_day")) & (C(value) >= C("__top")), C("d"))).alias("recovery_day"),
    )
    return days.withColumn("duration", F.datediff(F.coalesce("recovery_day", "last_day"), C("peak_day"))).drop("last_day")


def against(panel: DataFrame, benchmark: DataFrame, least: int = 30) -> DataFrame:
    """Beta, correlation and R-squared with a benchmark (d, bench), null with fewer common days."""
    both = panel.join(benchmark, "d").where("returns IS NOT NULL AND bench IS NOT NULL")
    enough = F.count("*") >= least
    out = both.groupBy("asset").agg(F.when(enough, ratio(F.covar_samp("returns", "bench"), F.var_samp("bench"))).alias("beta"), F.when(enough, F.corr("returns", "bench")).alias("correlation"))
    return out.withColumn("r_squared", C("correlation") * C("correlation"))


def rolling_correlation(panel: DataFrame, benchmark: DataFrame, n: int = 90) -> DataFrame:
    both = panel.join(benchmark, "d").where("returns IS NOT NULL AND bench IS NOT NULL")
    return both.withColumn("rolling_corr", F.when(F.count("*").over(rows(n)) >= n, F.corr("returns", "bench").over(rows(n))))


# Fixed values of the score: each factor's weight, its value without risk and its value at the most.
SCORE = {
    "volatility_score": (0.30, 0.0, 120.0),
    "drawdown_score": (0.25, 0.0, 80.0),
    "var_score": (0.25, 0.0, 8.0),
    "sharpe_score": (0.20, 2.0, -1.0),
}


def _scaled(x: Column, low: float, high: float) -> Column:
    """0 at low to 10 at high; 5 where undefined."""
    # least and greatest skip nulls
    return F.when(x.isNull(), 5.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(10.0), (x - low) / (high - low) * 10)))


def scores(measures: DataFrame) -> DataFrame:
    """A risk score of 0 to 10 from the volatility of 30 days, drawdown, value at risk (all in percent) and Sharpe ratio,
    and its level."""
    factors = {
        "volatility_score": C("vol_30"),
        "drawdown_score": F.abs(C("max_drawdown")) * 100,
        "var_score": F.when(C("var_95") < 0, -C("var_95") * 100).when(C("var_95") >= 0, 0.0),
        "sharpe_score": C("sharpe"),
    }
    parts = {name: _scaled(value, *SCORE[name][1:]) for name, value in factors.items()}
    total = sum((weight * C(name) for name, (weight, *_) in SCORE.items()), F.lit(0.0))
    out = measures.withColumns(parts).withColumn("risk_score", total)
    return out.withColumn("risk_level", F.when(C("risk_score") <= 2.5, "low").when(C("risk_score") <= 5, "moderate").when(C("risk_score") <= 7.5, "high").otherwise("very_high"))


def ewma_volatility(panel: DataFrame, decay: float = 0.94) -> DataFrame:
    """The last day's RiskMetrics volatility, annualised, in percent: of the recursion's weights only the last day's sum is
    needed, and a day's weight follows from how many returns come after it (the first day's takes what is left)."""
    r = panel.where("returns IS NOT NULL").select("asset", "d", "returns")
    after, before = Window.partitionBy("asset").orderBy(F.desc("d")), C("k") == C("n")
    aged = r.withColumns({"k": F.row_number().over(after), "n": F.count("*").over(Window.partitionBy("asset"))})
    weight = F.when(before, 1.0).otherwise(1 - decay) * F.pow(F.lit(decay), C("k") - 1)
    return aged.groupBy("asset").agg((F.sqrt(F.sum(weight * C("returns") * C("returns")) * N) * 100).alias("ewma_vol"))


def report(panel: DataFrame, rate: float = 0.0) -> DataFrame:
    """Everything above, one row an asset. The panel is written once, so its gaps are filled once for all measures."""
    panel = tables.kept(panel.select("asset", "d", "close", "returns"), "risk-panel")
    base = ratios(panel, rate)
    for measure in (drawdown_summary, value_at_risk, tails, window_volatilities, ewma_volatility):
        base = base.join(measure(panel), "asset")
    return scores(base.withColumn("calmar", ratio(C("cagr"), F.abs("max_drawdown"))))


def normal_density(x: Column, mean: Column, sd: Column) -> Column:
    """The density of a normal variable; null without a deviation."""
    z = (x - mean) / F.nullif(sd, F.lit(0.0))
    return F.exp(z * z * -0.5) / (F.nullif(sd, F.lit(0.0)) * math.sqrt(2 * math.pi))


def histogram(panel: DataFrame, bins: int = 70) -> DataFrame:
    """All returns in equal bins from the least to the greatest: the bin's number and middle, its returns, their density
    and that of a normal variable at the middle. Equal returns are all in bin 0, without a density."""
    r = panel.where("returns IS NOT NULL").select("asset", "returns")
    ends = r.groupBy("asset").agg(F.min("returns").alias("a"), F.max("returns").alias("b"), F.avg("returns").alias("mu"), F.stddev_samp("returns").alias("sd"), F.count("*").alias("all"))
    at = F.least(F.coalesce(F.floor(ratio(C("returns") - C("a"), C("b") - C("a")) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    counted = r.join(ends, "asset").withColumn("bin", at).groupBy("asset", "bin", "a", "b", "mu", "sd", "all").agg(F.count("*").alias("n"))
    width = (C("b") - C("a")) / bins
    middle = C("a") + (C("bin") + 0.5) * width
    return counted.select("asset", "bin", middle.alias("middle"), "n", ratio(C("n").cast("double"), C("all") * width).alias("density"), normal_density(middle, C("mu"), C("sd")).alias("normal"))


def position_size(capital: Column, risk_pct: Column, stop_pct: Column) -> Column:
    """How much to hold so that the stop loses the risked share of the capital: never over it, nothing without either."""
    return F.when((capital <= 0) | (stop_pct <= 0), 0.0).otherwise(F.least(capital, capital * risk_pct / F.nullif(stop_pct, F.lit(0.0))))


def ranked(snapshots: DataFrame, value: str = "market_cap") -> DataFrame:
    """The rows (one an asset) with their rank by a value, the greatest first, ties by asset, undefined ones last. Ranks are
    counted within classes of values (a factor of two each), after all rows of the classes above, so no task holds all."""
    size = C(value).cast("double")
    # values of one sign and magnitude are a class; greater classes have greater numbers
    level = F.when(size > 0, F.floor(F.log2(size)) + 2000).when(size == 0, 0).when(size < 0, -2000 - F.floor(F.log2(-size))).otherwise(-9999).cast("long")
    rows = snapshots.withColumn("__level", level)
    sizes = rows.groupBy("__level").agg(F.count("*").alias("__n"))  # a few thousand at most
    above = sizes.withColumn("__above", F.coalesce(F.sum("__n").over(Window.orderBy(F.desc("__level")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("__level").orderBy(size.desc_nulls_last(), "asset"))
    return rows.withColumn("__within", within).join(above, "__level").withColumn("rank", C("__above") + C("__within")).drop("__level", "__within", "__n", "__above")


def snapshot(panel: DataFrame, days: tuple[int, ...] = (1, 7, 30, 365)) -> DataFrame:
    """Last price, its change over some rows in percent, the all-time high with its first day and the distance to it; the
    last day's high, low and volume where the panel has them; with a market_cap also that, its rank and the supply."""
    last = [c for c in ("high", "low", "volume", "market_cap") if c in panel.columns]
    changes = {f"change_{n}": (ratio(C("close"), F.lag("close", n).over(ordered())) - 1) * 100 for n in days}
    high = "high" if "high" in panel.columns else "close"
    out = panel.withColumns(changes).groupBy("asset").agg(F.max_by("close", "d").alias("price"), *(F.max_by(c, "d").alias(c) for c in [*changes, *last]), F.max(high).alias("ath"), F.min_by("d", F.struct(-C(high), "d")).alias("ath_day"))
    out = out.withColumn("ath_distance", (C("price") / C("ath") - 1) * 100)
    return ranked(out.withColumn("supply", ratio(C("market_cap"), C("price")))) if "market_cap" in last else out


def period_extremes(panel: DataFrame) -> DataFrame:
    """The highest high and the lowest low (without them: closes) with their first days, and how far the last close is
    from the highest, in percent."""
    high, low = ("high", "low") if {"high", "low"} <= set(panel.columns) else ("close", "close")
    out = panel.groupBy("asset").agg(
        F.max(high).alias("highest"), F.min_by("d", F.struct(-C(high), "d")).alias("highest_day"), F.min(low).alias("lowest"), F.min_by("d", F.struct(low, "d")).alias("lowest_day"),
        F.max_by("close", "d").alias("price"), F.max("d").alias("last_day"),
    )
    return out.withColumn("from_highest_pct", (C("price") / C("highest") - 1) * 100)


def sentiment_then(panel: DataFrame, sentiment: DataFrame, rows: int = 7) -> DataFrame:
    """asset, last_day, and of the sentiment (d, value, a row a day, with days of its own) the last value by then with its
    day and the value that many of its rows earlier, where it has more than rows + 1 by then."""
    own = Window.partitionBy("index").orderBy("d")  # one series, a row a day
    series = sentiment.select(F.lit(0).alias("index"), "d", "value").where("value IS NOT NULL")
    earlier = F.when(F.row_number().over(own) > rows + 1, F.lag("value", rows).over(own))
    told = series.select("d", F.struct("value", C("d").alias("day"), earlier.alias("earlier")).alias("told"))
    ends = panel.groupBy("asset").agg(F.max("d").alias("d"))
    found = normalize.asof(ends, told, "told").withColumn("told", F.when(C("told.day") <= C("d"), C("told")))
    return found.select("asset", C("d").alias("last_day"), C("told.value").alias("value"), C("told.day").alias("value_day"), C("told.earlier").alias("earlier"))
