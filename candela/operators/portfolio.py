"""Covariances, portfolio points, optimised weights and rebalanced portfolios over the long panel.

Pairs of assets are joined by day and summed by Spark, each pair once. Baskets are optimised in tasks, each from its own
k x k covariances; nothing but the number of assets reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela import config, tables
from candela.operators import normalize, risk
from candela.windows import ordered, ratio, so_far

C = F.col
N = config.PERIODS


def joint_returns(panel: DataFrame) -> DataFrame:
    """Returns between the days on which all assets have a close."""
    shared = normalize.aligned(panel.select("asset", "d", "close"))
    return shared.withColumn("r", C("close") / F.lag("close").over(ordered()) - 1).where("r IS NOT NULL")


def asset_stats(panel: DataFrame, rate: float = 0.0) -> DataFrame:
    r = joint_returns(panel)
    growth = F.sum(F.log1p("r")).over(so_far())
    # the fall is from the first day's value on, not from what was paid for it
    fallen = r.withColumn("ln", growth).withColumn("fall", F.exp(C("ln") - F.max("ln").over(so_far())) - 1)
    return fallen.groupBy("asset").agg((F.sum(F.log1p("r")) * N / F.count("*")).alias("log_cagr"), (F.stddev_samp("r") * N**0.5).alias("volatility"), risk.sharpe(C("r"), rate).alias("sharpe"), F.min("fall").alias("max_drawdown"), F.sum(F.log1p("r")).alias("ln_total"))


def _pairs(r: DataFrame) -> DataFrame:
    """The returns of each pair i <= j by day."""
    a, b = r.select(C("asset").alias("i"), "d", C("r").alias("x")), r.select(C("asset").alias("j"), "d", C("r").alias("y"))
    return a.join(b, "d").where("i <= j")


def _both(upper: DataFrame) -> DataFrame:
    """A symmetric matrix (i, j and values) from its pairs i <= j."""
    values = [c for c in upper.columns if c not in ("i", "j")]
    sides = F.array(F.struct("i", "j"), F.struct(C("j").alias("i"), C("i").alias("j")))
    return upper.select(F.explode(F.when(C("i") == C("j"), F.slice(sides, 1, 1)).otherwise(sides)).alias("e"), *values).select("e.i", "e.j", *values)


def correlations(panel: DataFrame) -> DataFrame:
    return _both(_pairs(joint_returns(panel)).groupBy("i", "j").agg(F.corr("x", "y").alias("corr")))


def mean_correlation(matrix: DataFrame) -> DataFrame:
    return matrix.where("i <> j").agg(F.avg("corr").alias("mean_corr"))


def covariances(panel: DataFrame) -> DataFrame:
    """Annualised covariances (i, j, cov), shrunk as by Ledoit and Wolf (2004) where there are over k + 2 days, else of
    the sample: both need just the sums of products and of squared products of the centred returns."""
    r = tables.kept(joint_returns(panel), "joint-returns")
    means = r.groupBy("asset").agg(F.avg("r").alias("m"), F.count("*").alias("n"))
    centred = tables.kept(r.join(means, "asset").select("asset", "d", "n", (C("r") - C("m")).alias("r")), "centred-returns")
    sums = tables.kept(_pairs(centred).groupBy("i", "j").agg((F.sum(C("x") * C("y"))).alias("p"), F.sum(C("x") * C("x") * C("y") * C("y")).alias("q"), F.count("*").alias("n")), "pair-sums")
    own = sums.withColumns({"s": C("p") / C("n"), "own": C("i") == C("j")})
    twice = F.when(C("own"), 1.0).otherwise(2.0)  # a pair stands for both orders
    totals = own.groupBy("n").agg(F.count_if("own").alias("k"), F.sum(F.when(C("own"), C("s"))).alias("trace"), F.sum(twice * C("q")).alias("qq"), F.sum(twice * C("s") * C("s")).alias("ss"))
    # sum((s - target)^2) with the mean variance on the target's diagonal
    told = totals.withColumns({"mu": C("trace") / C("k"), "delta": (C("ss") - C("trace") * C("trace") / C("k")) / C("k"), "beta": (C("qq") / C("n") - C("ss")) / (C("k") * C("n"))})
    shape = own.join(told, "n").withColumn("target", F.when(C("own"), C("mu")).otherwise(0.0))
    shrunk = shape.withColumn("w", F.coalesce(ratio(F.greatest(F.lit(0.0), F.least("beta", "delta")), C("delta")), F.lit(0.0)))
    wide = (1 - C("w")) * C("s") + C("w") * C("target")
    return _both(shrunk.select("i", "j", (N * F.when(C("n") > C("k") + 2, wide).otherwise(C("p") / (C("n") - 1))).alias("cov")))


def log_growth(panel: DataFrame) -> DataFrame:
    """Expected log growth a year of each asset."""
    return joint_returns(panel).groupBy("asset").agg((F.avg(F.log1p("r")) * N).alias("mu"))


def point(weights: DataFrame, cov: DataFrame, mu: DataFrame, rate: float = 0.0) -> DataFrame:
    """Volatility, expected simple return and Sharpe ratio of the weights (basket, asset, w) of one or more baskets."""
    a, b = weights.select("basket", C("asset").alias("i"), C("w").alias("wi")), weights.select("basket", C("asset").alias("j"), C("w").alias("wj"))
    variance = a.join(cov, "i").join(b, ["basket", "j"]).groupBy("basket").agg(F.sqrt(F.sum(C("wi") * C("wj") * C("cov"))).alias("volatility"))
    growth = weights.join(mu, "asset").groupBy("basket").agg(F.expm1(F.sum(C("w") * C("mu"))).alias("expected_return"))
    return variance.join(growth, "basket").withColumn("sharpe", risk.safe(C("expected_return") - rate, C("volatility")))


def contributions(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """Each asset's share of its basket's variance, in percent."""
    a, b = weights.select("basket", C("asset").alias("i"), C("w").alias("wi")), weights.select("basket", C("asset").alias("j"), C("w").alias("wj"))
    own = a.join(cov, "i").join(b, ["basket", "j"]).groupBy("basket", C("i").alias("asset")).agg(F.sum(C("wi") * C("wj") * C("cov")).alias("part"))
    return own.select("basket", "asset", (C("part") / F.sum("part").over(Window.partitionBy("basket")) * 100).alias("share_pct"))


def equal_weights(panel: DataFrame, basket: str = "equal") -> DataFrame:
    assets = panel.select("asset").distinct()
    return assets.select(F.lit(basket).alias("basket"), "asset", F.lit(1.0 / max(1, assets.count())).alias("w"))


def manual_weights(panel: DataFrame, wanted: dict[str, float], basket: str = "manual") -> DataFrame:
    """The wanted shares (negative or missing ones are none), scaled to one; equal weights if nothing is left."""
    given = F.create_map(*(F.lit(x) for pair in wanted.items() for x in (pair[0], float(pair[1])))) if wanted else F.create_map().cast("map<string,double>")
    raw = panel.select("asset").distinct().withColumn("raw", F.greatest(F.lit(0.0), F.coalesce(F.try_element_at(given, C("asset")), F.lit(0.0))))
    total, n = raw.agg(F.coalesce(F.sum("raw"), F.lit(0.0)), F.count("*")).first()
    return raw.select(F.lit(basket).alias("basket"), "asset", (C("raw") / total if total > 0 else F.lit(1.0 / max(1, n))).alias("w"))


def _capped(w: np.ndarray, cap: float) -> np.ndarray:
    """The nearest weights that sum to one, each from 0 to cap."""
    low, high = w.min() - 1.0, w.max()
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if np.clip(w - mid, 0, cap).sum() > 1 else (low, mid)
    return np.clip(w - (low + high) / 2, 0, cap)


def _descend(f, w: np.ndarray, cap: float, steps: int = 500) -> tuple[float, np.ndarray]:
    """Projected gradient descent with backtracking and central differences."""
    best, rate = f(w), 1.0
    for _ in range(steps):
        h = 1e-6
        g = np.array([(f(w + h * e) - f(w - h * e)) / (2 * h) for e in np.eye(len(w))])
        while rate > 1e-10:
            tried = _capped(w - rate * g, cap)
            if (value := f(tried)) < best - 1e-14:
                best, w, rate = value, tried, rate * 2
                break
            rate /= 2
        else:
            break
    return best, w


def solve(cov: np.ndarray, mu: np.ndarray, method: str, cap: float = 1.0, rate: float = 0.0, seed: int = 7) -> np.ndarray:
    """Weights of a basket: equal, min_variance, max_sharpe or risk_parity. The cap is at least 1/k; tiny weights become
    none; without a finite solution the weights are equal."""
    k = len(mu)
    cap, even = max(cap, 1.0 / k), np.full(k, 1.0 / k)
    if method == "equal" or k == 1:
        return even
    scale = float(np.trace(cov)) / k or 1.0

    def objective(w: np.ndarray) -> float:
        variance = float(w @ cov @ w)
        if method == "min_variance":
            return variance / scale
        if method == "max_sharpe":
            return -(np.expm1(w @ mu) - rate) / np.sqrt(max(variance, 1e-18))
        if method == "risk_parity":
            return float(((w * (cov @ w) / max(variance, 1e-18) - 1.0 / k) ** 2).sum())
        raise ValueError(f"no method named {method}")

    starts = [even, *np.random.default_rng(seed).dirichlet(np.ones(k), 8 if method == "max_sharpe" else 2)]
    value, w = min((_descend(objective, _capped(s, cap), cap) for s in starts), key=lambda x: x[0])
    w = np.where(w < 1e-4, 0.0, w)
    return w / w.sum() if np.isfinite(value) and w.sum() > 0 else even


def optimised(panel: DataFrame, method: str, cap: float = 1.0, rate: float = 0.0) -> DataFrame:
    """basket (the method), asset and weight. The basket's covariances and growth go to one task (k x k numbers)."""
    if method not in ("equal", "min_variance", "max_sharpe", "risk_parity"):
        raise ValueError(f"no method named {method}")
    rows = covariances(panel).join(log_growth(panel).withColumnRenamed("asset", "i"), "i").withColumn("basket", F.lit(method))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        wide = frame.pivot(index="i", columns="j", values="cov").sort_index()
        wide = wide[wide.index]
        mu = frame.drop_duplicates("i").set_index("i")["mu"].loc[wide.index]
        return pd.DataFrame({"basket": method, "asset": wide.index, "w": solve(wide.to_numpy(), mu.to_numpy(), method, cap, rate)})

    return rows.groupBy("basket").applyInPandas(fit, "basket string, asset string, w double")


#: Tries of a gamma variate. About seven in ten are accepted, so all fail with a probability under 1e-30; that is an error.
TRIES = 64


def random_baskets(panel: DataFrame, n: int = 3000, shape: float = 0.7, seed: int = 7) -> DataFrame:
    """n baskets of Dirichlet weights; each basket's are drawn from its own number, whatever partition it is in. Gamma
    variates under one are made as Ahrens and Dieter's: a power of a uniform, thinned by a second; the first accepted
    try counts."""
    key = lambda tag, t: F.md5(F.concat_ws(":", F.lit(f"{seed}{tag}"), C("basket"), C("asset"), t))
    u = lambda tag, t: (F.conv(F.substr(key(tag, t), F.lit(1), F.lit(12)), 16, 10).cast("double") + 1) / float(2**48 + 1)
    e = 1 + shape / np.e

    def tried(t: Column) -> Column:
        p = u("a", t) * e
        small, large = F.pow(p, F.lit(1 / shape)), -F.log((F.lit(e) - p) / shape)
        return F.when((p <= 1) & (u("b", t) <= F.exp(-small)), small).when((p > 1) & (u("b", t) <= F.pow(large, F.lit(shape - 1))), large)

    rows = panel.select("asset").distinct().withColumn("basket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).repartition("basket")
    accepted = F.aggregate(F.sequence(F.lit(0), F.lit(TRIES - 1)), F.lit(None).cast("double"), lambda found, t: F.when(found.isNotNull(), found).otherwise(tried(t)))
    gamma = rows.withColumn("g", F.coalesce(accepted, F.raise_error(F.lit("no gamma variate was accepted")).cast("double")))
    return gamma.select(C("basket").cast("string").alias("basket"), "asset", (C("g") / F.sum("g").over(Window.partitionBy("basket"))).alias("w"))


#: How often a portfolio is brought back to its weights, and the unit of time whose first day that is.
PERIODS = {"none": None, "month": "month", "quarter": "quarter"}


def holdings(panel: DataFrame, weights: DataFrame, period: str = "month") -> DataFrame:
    """basket, asset, d, w, flag (1 on days that bring the basket back to its weights), x: what the holding is worth, for
    each unit that the whole basket was worth at its segment's beginning; old: on any day, by the segment before.

    Segments and their first closes are the same for all baskets, so they are found once an asset, before weights are
    joined."""
    shared = normalize.aligned(panel.select("asset", "d", "close"))
    segment = F.date_trunc(PERIODS[period], "d") if PERIODS[period] else F.lit(0)
    first = shared.withColumn("s", segment).withColumn("p0", F.first("close").over(Window.partitionBy("asset", "s").orderBy("d")))
    turns = first.withColumns({"flag": F.coalesce((F.lag("s").over(ordered()) != C("s")).cast("int"), F.lit(0)), "before": F.lag("p0").over(ordered())})
    held = tables.kept(turns.select("asset", "d", "flag", (C("close") / C("p0")).alias("grown"), (C("close") / C("before")).alias("grown_before")), "segments")
    return held.join(weights.where("w > 0").select("basket", "asset", "w"), "asset").select("basket", "asset", "d", "w", "flag", (C("w") * C("grown")).alias("x"), (C("w") * C("grown_before")).alias("old"))


def rebalanced(panel: DataFrame, weights: DataFrame, period: str = "month", cost: float = config.FEE + config.SLIPPAGE, initial: float = 1.0) -> DataFrame:
    """The value of each basket by day: bought at the given weights at a cost, left to drift, and brought back to them on
    the first day of each new month or quarter at the cost of what is traded.

    Within a segment the value is a fixed sum of prices, and a rebalance multiplies it by a factor that depends on the
    segment's growth alone; so a running product of factors does for a loop over days."""
    legs = holdings(panel, weights, period)
    grown = legs.groupBy("basket", "d", "flag").agg(F.sum("x").alias("growth"), F.sum("old").alias("g"), F.collect_list(F.struct("w", "old")).alias("legs"))
    traded = F.aggregate("legs", F.lit(0.0), lambda a, leg: a + F.abs(leg["w"] - leg["old"] / C("g")))
    factor = F.when(C("flag") == 1, C("g") * (1 - cost * traded))
    by = Window.partitionBy("basket").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    valued = grown.withColumns({"factor": factor, "traded": F.when(C("flag") == 1, traded)})
    return valued.withColumn("value", initial * (1 - cost) * F.coalesce(F.product("factor").over(by), F.lit(1.0)) * C("growth")).select("basket", "d", "flag", "traded", "value")


def effective_weights(panel: DataFrame, weights: DataFrame, period: str = "month") -> DataFrame:
    """basket, asset, d, weight: what part of the basket's value each holding is at the end of the day, drifting from the
    given weights and brought back to them when the basket is."""
    part = C("x") / F.sum("x").over(Window.partitionBy("basket", "d"))
    return holdings(panel, weights, period).select("basket", "asset", "d", part.alias("weight"))


def record(curve: DataFrame, rate: float = 0.0, cost: float = config.FEE + config.SLIPPAGE, initial: float = 1.0) -> DataFrame:
    """One row a basket of its curve: total and annual return, volatility (all in percent), Sharpe and Sortino ratio,
    deepest fall in percent and all costs. Returns are from the first day's value on, the total is of what was paid."""
    order = Window.partitionBy("basket").orderBy("d")
    peak = F.max("value").over(order.rowsBetween(Window.unboundedPreceding, 0))
    r = curve.withColumns({"r": C("value") / F.lag("value").over(order) - 1, "fall": C("value") / peak - 1})
    told = r.groupBy("basket").agg(
        ((F.max_by("value", "d") / initial - 1) * 100).alias("total_return"), (risk.cagr(C("r")) * 100).alias("annual_return"), (F.stddev_samp("r") * N**0.5 * 100).alias("volatility"),
        risk.sharpe(C("r"), rate).alias("sharpe"), risk.sortino(C("r"), rate).alias("sortino"), (F.min("fall") * 100).alias("max_drawdown"),
    )
    return told.join(turnover_cost(curve, cost, initial).withColumnRenamed("cost", "total_costs"), "basket")


def turnover_cost(curve: DataFrame, cost: float = config.FEE + config.SLIPPAGE, initial: float = 1.0) -> DataFrame:
    """What buying and rebalancing cost in all: a rebalance costs its share of the value before it."""
    paid = F.when(C("flag") == 1, C("value") / (1 - cost * C("traded")) * cost * C("traded"))
    return curve.groupBy("basket").agg((initial * cost + F.coalesce(F.sum(paid), F.lit(0.0))).alias("cost"))
