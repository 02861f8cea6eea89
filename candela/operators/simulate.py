"""Monte-Carlo paths, lump sum against regular buying, forecast scenarios.

Random numbers are hashes of (seed, simulation, draw), so results don't depend on partitions or on retries.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela import config
from candela.operators import risk
from candela.windows import ordered, ratio

C = F.col
# Days in a block of the bootstrap, days between purchases, simulations and sample paths.
BLOCK, EVERY, SIMULATIONS, SAMPLES = 5, 7, 5000, 30


def kept(fee: float = config.FEE, slippage: float = config.SLIPPAGE) -> float:
    """What a purchase or a sale leaves of an amount. (Backtests and portfolios charge the sum of both rates instead.)"""
    return (1 - fee) * (1 - slippage)


def hashed(seed: int, *parts: Column) -> Column:
    """A whole number under 2**32 from the seed and some columns."""
    return F.conv(F.substr(F.md5(F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts))), F.lit(1), F.lit(8)), 16, 10).cast("long")


def _log_returns(panel: DataFrame, drift: str) -> DataFrame:
    """asset, pos, x (demeaned for a zero drift) and n."""
    own = Window.partitionBy("asset")
    r = panel.where("log_returns IS NOT NULL").select("asset", (F.row_number().over(ordered()) - 1).alias("pos"), C("log_returns").alias("x"), F.count("*").over(own).alias("n"), F.avg("log_returns").over(own).alias("m"))
    return r.where("n >= 30").select("asset", "pos", "n", (C("x") - C("m") if drift == "zero" else C("x")).alias("x"))


def _grid(assets: DataFrame, sims: int, days: int) -> DataFrame:
    """A row for each asset, simulation and day, dealt by asset and simulation, as their running sums need them."""
    each = assets.withColumn("sim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sims - 1).cast("long")))).repartition("asset", "sim")
    return each.withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(days))))


def bootstrap_paths(panel: DataFrame, sims: int = SIMULATIONS, days: int = 60, block: int = BLOCK, drift: str = "zero", seed: int = 7) -> DataFrame:
    """asset, sim, day, ln (log growth since day 0): circular blocks of historical log returns; 30 returns at least."""
    r = _log_returns(panel, drift)
    sizes = r.groupBy("asset").agg(F.max("n").alias("n")).withColumn("b", F.greatest(F.lit(1), F.least(F.lit(block), F.floor(C("n") / 4))))
    grid = _grid(sizes, sims, days)
    draw = F.floor((C("day") - 1) / C("b"))
    start = hashed(seed, C("sim"), draw) % C("n")
    at = grid.withColumn("pos", ((start + F.pmod(C("day") - 1, C("b"))) % C("n")).cast("int"))
    path = Window.partitionBy("asset", "sim").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return at.join(r.select("asset", "pos", "x"), ["asset", "pos"]).select("asset", "sim", "day", F.sum("x").over(path).alias("ln"))


def gbm_paths(panel: DataFrame, sims: int = SIMULATIONS, days: int = 60, drift: str = "zero", seed: int = 7) -> DataFrame:
    """The same from normal log returns of the historical deviation, by Box and Muller's transform."""
    r = panel.where("log_returns IS NOT NULL").groupBy("asset").agg(F.avg("log_returns").alias("m"), F.stddev_samp("log_returns").alias("sd"), F.count("*").alias("n")).where("n >= 30")
    grid = _grid(r, sims, days)
    u = lambda k: (hashed(seed + k, C("sim"), C("day"), C("asset")) + 0.5) / 2**32
    z = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * math.pi * u(2))
    path = Window.partitionBy("asset", "sim").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return grid.withColumn("x", (F.lit(0.0) if drift == "zero" else C("m")) + C("sd") * z).select("asset", "sim", "day", F.sum("x").over(path).alias("ln"))


def _valued(investment: float, keeps: float) -> Column:
    return F.lit(investment * keeps * keeps) * F.exp("ln")


def fan(paths: DataFrame, investment: float = 1000.0, keeps: float = kept()) -> DataFrame:
    """Percentiles of what a sale would bring, by day from 0 on (after both costs)."""
    ps = (0.05, 0.25, 0.5, 0.75, 0.95)
    every = paths.unionByName(paths.where("day = 1").withColumns({"day": F.lit(0), "ln": F.lit(0.0)})).withColumn("v", _valued(investment, keeps))
    return every.groupBy("asset", "day").agg(F.percentile("v", F.array(*map(F.lit, ps))).alias("p")).select("asset", "day", *(C("p")[k].alias(f"p{int(100 * q)}") for k, q in enumerate(ps)))


def outcome(paths: DataFrame, investment: float = 1000.0, keeps: float = kept()) -> DataFrame:
    """Of the last day: mean, median, 5 and 95 percent points, chances of a loss and of doubling, and the loss at 95
    percent with the mean of what lies beyond, both at least nothing."""
    last = paths.groupBy("asset", "sim").agg(F.max_by("ln", "day").alias("ln")).withColumn("v", _valued(investment, keeps))
    points = F.percentile("v", F.array(*map(F.lit, (0.05, 0.5, 0.95))))
    stats = last.groupBy("asset").agg(F.avg("v").alias("mean"), points.alias("p"), F.avg((C("v") < investment).cast("double")).alias("p_loss"), F.avg((C("v") >= 2 * investment).cast("double")).alias("p_double"))
    named = stats.select("asset", "mean", C("p")[1].alias("median"), C("p")[0].alias("p5"), C("p")[2].alias("p95"), "p_loss", "p_double")
    short = last.join(named.select("asset", "p5"), "asset").where(C("v") <= C("p5")).groupBy("asset").agg(F.avg("v").alias("tail"))
    positive = lambda x: F.greatest(F.lit(0.0), investment - x)
    return named.join(short, "asset").withColumns({"var_95": positive(C("p5")), "cvar_95": positive(C("tail"))}).drop("tail")


def outcome_histogram(paths: DataFrame, investment: float = 1000.0, bins: int = 40, keeps: float = kept()) -> DataFrame:
    """The last day's values in bins that break at the investment: side (loss, gain), bin, from, to, n, density and the
    normal density of all values at the bin's middle. The bins of a loss are from the 0.5th percentile to the investment,
    those of a gain from there to the 99.5th; what lies beyond is counted as a side of its own (below, above), so each
    simulation is counted once."""
    v, a, b = C("v"), C("a"), C("b")
    last = paths.groupBy("asset", "sim").agg(F.max_by("ln", "day").alias("ln")).select("asset", _valued(investment, keeps).alias("v"))
    told = last.groupBy("asset").agg(F.percentile("v", F.lit(0.005)).alias("a"), F.percentile("v", F.lit(0.995)).alias("b"), F.min("v").alias("least"), F.max("v").alias("most"), F.avg("v").alias("mu"), F.stddev_samp("v").alias("sd"), F.count("*").alias("all"))
    side = F.when(v < a, "below").when(v > b, "above").when(v < investment, "loss").otherwise("gain")
    start = F.when(C("side") == "below", C("least")).when(C("side") == "above", b).when(C("side") == "gain", F.greatest(a, F.lit(investment))).otherwise(a)
    stop = F.when(C("side") == "below", a).when(C("side") == "above", C("most")).when(C("side") == "loss", F.least(b, F.lit(investment))).otherwise(b)
    parts = F.when(C("side").isin("below", "above"), 1).otherwise(bins)
    ends = last.join(told, "asset").withColumn("side", side).withColumns({"start": start, "width": (stop - start) / parts, "parts": parts})
    at = F.least(F.coalesce(F.floor(ratio(v - C("start"), C("width"))), F.lit(0)), C("parts") - 1).cast("int")
    counted = ends.withColumn("bin", at).groupBy("asset", "side", "bin", "start", "width", "mu", "sd", "all").agg(F.count("*").alias("n"))
    low = C("start") + C("bin") * C("width")
    return counted.select("asset", "side", "bin", low.alias("from"), (low + C("width")).alias("to"), "n", ratio(C("n").cast("double"), C("all") * C("width")).alias("density"), risk.normal_density(low + C("width") / 2, C("mu"), C("sd")).alias("normal"))


def assumptions(panel: DataFrame, drift: str = "zero") -> DataFrame:
    """The drift and volatility a year, in percent, that the paths of these days assume."""
    r = _log_returns(panel, drift)
    return r.groupBy("asset").agg((F.avg("x") * config.PERIODS * 100).alias("annual_drift"), (F.stddev_samp("x") * math.sqrt(config.PERIODS) * 100).alias("annual_volatility"))


def samples(paths: DataFrame, n: int = SAMPLES, investment: float = 1000.0, keeps: float = kept()) -> DataFrame:
    """The value by day, from 0 on, of n paths (their draws don't depend on their numbers: the first ones)."""
    chosen = paths.where(C("sim") < n)
    start = chosen.where("day = 1").withColumns({"day": F.lit(0), "ln": F.lit(0.0)})
    return chosen.unionByName(start).select("asset", "sim", "day", _valued(investment, keeps).alias("value"))


def purchases(panel: DataFrame, every: int = EVERY, capital: float = 1000.0, keeps: float = kept()) -> DataFrame:
    """Equal amounts invested on each `every`-th day, for assets with two of them at least."""
    own = Window.partitionBy("asset")
    rows = panel.select("asset", "d", "close", (F.row_number().over(ordered()) - 1).alias("i"), F.count("*").over(own).alias("n")).where(C("n") >= 2 * every).where(C("i") % every == 0)
    return rows.withColumn("amount", capital / F.count("*").over(own)).withColumn("units", C("amount") * keeps / C("close"))


def lump_and_regular(panel: DataFrame, every: int = EVERY, capital: float = 1000.0, keeps: float = kept()) -> DataFrame:
    """asset, d, close, the value of buying at once (`lump`) and regularly (`regular`, with the cash not yet invested),
    what is invested and held by then, and the first price."""
    bought = purchases(panel, every, capital, keeps).select("asset", "d", "amount", "units")
    days = panel.select("asset", "d", "close").join(bought.select("asset").distinct(), "asset").join(bought, ["asset", "d"], "left")
    by = ordered().rowsBetween(Window.unboundedPreceding, 0)
    out = days.withColumns({"buys": F.count("amount").over(by), "units": F.coalesce(F.sum("units").over(by), F.lit(0.0)), "invested": F.coalesce(F.sum("amount").over(by), F.lit(0.0)), "first_price": F.first("close").over(by)})
    return out.select("asset", "d", "close", (capital * keeps * C("close") / C("first_price")).alias("lump"), (C("units") * C("close") + capital - C("invested")).alias("regular"), "invested", "units", "buys", "first_price")


def comparison(panel: DataFrame, every: int = EVERY, capital: float = 1000.0, keeps: float = kept()) -> DataFrame:
    """Of both ways: the final value after a sale (which costs what is held, not the cash), the return in percent, the
    average price, the number of purchases and the deepest fall before the sale."""
    curve = lump_and_regular(panel, every, capital, keeps)
    by = ordered().rowsBetween(Window.unboundedPreceding, 0)
    fell = curve.withColumns({f"{c}_fall": C(c) / F.max(c).over(by) - 1 for c in ("lump", "regular")})
    last = ("close", "lump", "regular", "units", "buys", "first_price")
    ends = fell.groupBy("asset").agg(*(F.max_by(c, "d").alias(c) for c in last), *(F.min(f"{c}_fall").alias(f"{c}_drawdown") for c in ("lump", "regular")))
    final = ends.withColumns({"lump_final": C("lump") * keeps, "regular_final": C("regular") - C("units") * C("close") * (1 - keeps)})
    return final.select(
        "asset", "lump_final", "regular_final", *(((C(f"{c}_final") / capital - 1) * 100).alias(f"{c}_return") for c in ("lump", "regular")),
        C("first_price").alias("lump_price"), (capital * keeps / F.nullif("units", F.lit(0.0))).alias("regular_price"), C("buys").alias("regular_buys"), "lump_drawdown", "regular_drawdown",
    )


SCENARIOS = ("lo95", "lo80", "mean", "hi80", "hi95")


def scenarios(forecasts: DataFrame, investment: float = 1000.0, keeps: float = kept()) -> DataFrame:
    """What the investment would be worth at the last step of a price forecast (asset, model, step, last_price, the
    SCENARIOS' prices), after both costs."""
    last = forecasts.withColumn("__n", F.max("step").over(Window.partitionBy("asset", "model"))).where(C("step") == C("__n"))
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("scenario"), C(s).alias("price")) for s in SCENARIOS)))
    rows = last.select("asset", "model", "last_price", each.alias("e")).select("asset", "model", "e.*", "last_price")
    value = investment * keeps * keeps * C("price") / C("last_price")
    return rows.select("asset", "model", "scenario", "price", value.alias("value"), ((value / investment - 1) * 100).alias("result_pct"))
