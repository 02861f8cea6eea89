"""Trading rules as target positions, look-ahead-free backtests, trades and a parameter grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela import config
from candela.operators import indicators, risk, scans
from candela.windows import ordered, so_far

C = F.col
#: Days before each rule's signal means anything.
WARM_UP = {"buy_hold": 0, "sma_cross": 50, "trend_filter": 100, "macd": 35, "rsi": 15, "bollinger": 20, "donchian": 21}
RECURSIVE = ("macd", "rsi")
#: Days that must follow the start; assets with fewer have no backtest.
LEAST_DAYS = 30
# The periods of the grid's averages.
FAST, SLOW = (5, 10, 15, 20, 30, 40), (30, 50, 75, 100, 150, 200)


def held(entry: Column, leave: Column) -> Column:
    """1 from an entry until an exit, 0 before the first; on a day of both the entry wins."""
    return F.coalesce(F.last(F.when(entry, 1.0).when(leave, 0.0), ignorenulls=True).over(so_far()), F.lit(0.0))


def _channel(n: int, f) -> Column:
    before = ordered().rowsBetween(-n, -1)
    return F.when(F.count("close").over(before) >= n, f("close").over(before))


def target(rule: str) -> Column:
    """The position (0 or 1) that a rule wants at the close of a day."""
    on = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    if rule == "buy_hold":
        return F.lit(1.0)
    if rule == "sma_cross":
        return on(indicators.sma(20) > indicators.sma(50))
    if rule == "trend_filter":
        return on(C("close") > indicators.sma(100))
    if rule == "macd":
        return on(C("macd") > C("macd_signal"))
    if rule == "rsi":
        return held(C("rsi") < 30, C("rsi") > 70)
    if rule == "bollinger":
        bands = indicators.bollinger()
        return held(C("close") < bands["bb_low"], C("close") >= bands["bb_mid"])
    if rule == "donchian":
        return held(C("close") > _channel(20, F.max), C("close") < _channel(10, F.min))
    raise ValueError(f"no rule named {rule}")


def numbered(panel: DataFrame) -> DataFrame:
    return panel.withColumn("i", F.row_number().over(ordered()) - 1)


def positions(panel: DataFrame, rules: list[str] | None = None, start: int | None = None) -> DataFrame:
    """asset, strategy, d, i, close, returns, position and turnover from the common start on (the longest warm-up, one day
    at least, if not given): a day's position is the target of the day before; buy and hold holds from the start. Assets
    without LEAST_DAYS days beyond the start are left out."""
    rules = list(rules or WARM_UP)
    first = max(1, *(WARM_UP[s] for s in rules)) if start is None else start
    base = scans.recursive(panel) if any(s in RECURSIVE for s in rules) else panel
    wide = numbered(base).withColumns({f"__{s}": target(s) for s in rules})
    shifted = wide.withColumns({f"__{s}": F.coalesce(F.lag(f"__{s}").over(ordered()), F.lit(0.0)) if s != "buy_hold" else F.lit(1.0) for s in rules})
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("strategy"), C(f"__{s}").alias("position")) for s in rules)))
    enough = shifted.withColumn("__n", F.count("*").over(Window.partitionBy("asset"))).where(C("__n") - LEAST_DAYS > first)
    long = enough.where(C("i") >= first).select("asset", "d", "i", "close", "returns", each.alias("s")).select("asset", "s.strategy", "d", "i", "close", "returns", "s.position")
    order = Window.partitionBy("asset", "strategy").orderBy("d")
    return long.withColumn("turnover", F.abs(C("position") - F.coalesce(F.lag("position").over(order), F.lit(0.0))))


def backtest(panel: DataFrame, rules: list[str] | None = None, fee: float = config.FEE, slippage: float = config.SLIPPAGE, capital: float = 1.0, start: int | None = None) -> DataFrame:
    """positions with the day's net return, the equity and its logarithm (where nothing is lost entirely)."""
    net = C("position") * C("returns") - C("turnover") * (fee + slippage)
    order = Window.partitionBy("asset", "strategy").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    out = positions(panel, rules, start).withColumn("net", net)
    return out.withColumns({"equity": capital * F.product(1 + C("net")).over(order), "ln_equity": F.sum(F.when(C("net") > -1, F.log1p("net"))).over(order)})


def with_start(tested: DataFrame, panel: DataFrame, capital: float = 1.0) -> DataFrame:
    """asset, strategy, d and equity, with the capital on the day before the first."""
    first = tested.groupBy("asset", "strategy").agg(F.min("d").alias("first"))
    before = panel.withColumn("next", F.lead("d").over(ordered())).select("asset", C("next").alias("first"), "d")
    start = first.join(before, ["asset", "first"]).select("asset", "strategy", "d", F.lit(float(capital)).alias("equity"))
    return tested.select("asset", "strategy", "d", "equity").unionByName(start)


def trades(tested: DataFrame, panel: DataFrame, cost: float = config.FEE + config.SLIPPAGE) -> DataFrame:
    """The k-th entry with the k-th exit of each asset and strategy, at the closes of the days before; an open trade is
    valued at the last close. Costs count twice, open or not."""
    order = Window.partitionBy("asset", "strategy").orderBy("d")
    before = panel.withColumns({"price": F.lag("close").over(ordered()), "day": F.lag("d").over(ordered())}).select("asset", "d", "price", "day")
    step = C("position") - F.coalesce(F.lag("position").over(order), F.lit(0.0))
    turns = tested.withColumn("step", step).where("step <> 0").join(before, ["asset", "d"])
    kth = turns.withColumn("k", F.row_number().over(Window.partitionBy("asset", "strategy", F.signum("step")).orderBy("d")))
    sides = lambda sign, a: kth.where(C("step") * sign > 0).select("asset", "strategy", "k", C("day").alias(f"{a}_day"), C("price").alias(f"{a}_price"))
    ends = panel.groupBy("asset").agg(F.max("d").alias("last_day"), F.max_by("close", "d").alias("last_price"))
    both = sides(1, "entry").join(sides(-1, "exit"), ["asset", "strategy", "k"], "left").join(ends, "asset")
    closed = both.withColumn("is_open", C("exit_day").isNull()).withColumns({"exit_day": F.coalesce("exit_day", "last_day"), "exit_price": F.coalesce("exit_price", "last_price")})
    return closed.withColumn("result", C("exit_price") / C("entry_price") * (1 - cost) ** 2 - 1).withColumn("days", F.datediff("exit_day", "entry_day")).drop("last_day", "last_price")


def metrics(tested: DataFrame, traded: DataFrame, rate: float = 0.0) -> DataFrame:
    """Per asset and strategy: log growth, growth in all and a year, volatility, Sharpe, Sortino and Calmar ratio, deepest
    fall, time invested, trades, win rate of closed ones and their average gain and loss."""
    keys = ["asset", "strategy"]
    peak = F.max("ln_equity").over(Window.partitionBy(*keys).orderBy("d").rowsBetween(Window.unboundedPreceding, 0))
    fall = tested.withColumn("fall", F.exp(C("ln_equity") - F.greatest(peak, F.lit(0.0))) - 1)
    curve = fall.groupBy(*keys).agg(
        F.max_by("ln_equity", "d").alias("ln_total"), (F.stddev_samp("net") * config.PERIODS**0.5).alias("volatility"), risk.sharpe(C("net"), rate).alias("sharpe"), F.min("fall").alias("max_drawdown"), (F.avg("position") * 100).alias("invested_pct"),
        risk.cagr(C("net")).alias("annual_return"), risk.sortino(C("net"), rate).alias("sortino"),
    )
    curve = curve.withColumns({"total_return": F.expm1("ln_total"), "calmar": F.when(C("max_drawdown") < 0, C("annual_return") / F.abs("max_drawdown"))})
    closed = ~C("is_open")
    of = traded.groupBy(*keys).agg(
        F.count("*").alias("trades"), (F.avg(F.when(closed, (C("result") > 0).cast("double"))) * 100).alias("win_rate"),
        F.avg(F.when(closed & (C("result") > 0), C("result"))).alias("avg_win"), F.avg(F.when(closed & (C("result") <= 0), C("result"))).alias("avg_loss"),
    )
    return curve.join(of, keys, "left").withColumn("trades", F.coalesce("trades", F.lit(0)))


def better_than_holding(measured: DataFrame) -> DataFrame:
    """Strategies with a larger Sharpe ratio than buy and hold."""
    base = measured.where("strategy = 'buy_hold'").select("asset", C("sharpe").alias("bench"))
    return measured.where("strategy <> 'buy_hold'").join(base, "asset").where("sharpe > bench").select("asset", "strategy", "sharpe", "bench")


def grid(panel: DataFrame, fast: tuple[int, ...] = FAST, slow: tuple[int, ...] = SLOW, fee: float = config.FEE + config.SLIPPAGE, rate: float = 0.0) -> DataFrame:
    """Sharpe ratio and log growth of moving-average crosses for all pairs with fast < slow: each average is computed
    once, and a day's row carries the pairs. An asset is tested from its largest slow period with over LEAST_DAYS days
    beyond it on (without one it has no rows), and has no pairs with a larger one."""
    n = F.count("*").over(Window.partitionBy("asset"))
    start = F.array_max(F.filter(F.array(*map(F.lit, slow)), lambda s: s < n - LEAST_DAYS))
    wide = numbered(panel).withColumns({"start": start} | {f"m{n}": indicators.sma(n) for n in sorted({*fast, *slow})})
    pairs = F.array(*(F.struct(F.lit(a).alias("fast"), F.lit(b).alias("slow"), F.coalesce((C(f"m{a}") > C(f"m{b}")).cast("double"), F.lit(0.0)).alias("target")) for a in fast for b in slow if a < b))
    long = wide.select("asset", "d", "i", "start", "returns", F.explode(pairs).alias("p")).select("asset", "d", "i", "start", "returns", "p.*").where("slow <= start")
    order = Window.partitionBy("asset", "fast", "slow").orderBy("d")
    kept = long.withColumn("position", F.coalesce(F.lag("target").over(order), F.lit(0.0))).where("i >= start")
    net = kept.withColumn("net", C("position") * C("returns") - F.abs(C("position") - F.coalesce(F.lag("position").over(order), F.lit(0.0))) * fee)
    return net.groupBy("asset", "fast", "slow").agg(risk.sharpe(C("net"), rate).alias("sharpe"), F.sum(F.when(C("net") > -1, F.log1p("net"))).alias("ln_total"))


def best_cell(cells: DataFrame) -> DataFrame:
    """The pair with the largest Sharpe ratio (the smallest periods of equals)."""
    return cells.where("sharpe IS NOT NULL").groupBy("asset").agg(F.min_by(F.struct("fast", "slow", "sharpe"), F.struct(-C("sharpe"), "fast", "slow")).alias("b")).select("asset", "b.*")
