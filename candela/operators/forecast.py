"""Forecasts of daily prices, their walk-forward validation and its metrics.

Prices are modelled in logs. The flat and the drift forecast, the folds, the ensemble and all metrics are DataFrame
operations; models that iterate (exponential smoothing, Theta, ARIMA, boosted trees) run in NumPy on one (asset, origin)
at a time, a bounded series, after Spark has dealt the pairs out; the candidate orders of ARIMA are rows that are fitted
apart. These four are approximations of the usual packages' fits: same model, own optimiser.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela import config
from candela.operators import models
from candela.windows import ordered

C = F.col
BANDS = {"lo95": -config.Z95, "lo80": -config.Z80, "hi80": config.Z80, "hi95": config.Z95}
PATHS = ("mean", *BANDS)
ITERATIVE = ("theta", "ets", "arima", "boost")
LEAST_ROWS = 60
LEAST_WINDOWS = 3


def min_train(horizon: int) -> int:
    return max(120, 2 * horizon)


def series(panel: DataFrame) -> DataFrame:
    """asset, i (day number from 0), y (log price), n (days) for days with a price."""
    own = Window.partitionBy("asset")
    return panel.where("close > 0").select("asset", (F.row_number().over(ordered()) - 1).alias("i"), F.log("close").alias("y"), F.count("*").over(own).alias("n"))


def origins(rows: DataFrame, horizon: int, folds: int) -> DataFrame:
    """asset, origin (how many days are known): up to `folds` of them, the last one horizon before the end."""
    step = max(horizon // 2, 5)
    length = rows.groupBy("asset").agg(F.max("n").alias("n"))
    each = F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))
    return length.select("asset", "n", each.alias("k")).select("asset", (C("n") - horizon - C("k") * step).cast("int").alias("origin")).where(C("origin") >= min_train(horizon))


def ends(rows: DataFrame) -> DataFrame:
    """asset, origin: all days are known."""
    return rows.groupBy("asset").agg(F.max("n").cast("int").alias("origin"))


def moments(rows: DataFrame, at: DataFrame) -> DataFrame:
    """Of the days before each origin: the last log price, the number, mean and deviation of the daily changes."""
    change = rows.withColumn("x", C("y") - F.lag("y").over(Window.partitionBy("asset").orderBy("i")))
    known = change.join(at, "asset").where("i < origin")
    return known.groupBy("asset", "origin").agg(F.max_by("y", "i").alias("last"), F.count("x").alias("t"), F.avg("x").alias("mu"), F.stddev_samp("x").alias("sd"))


def _banded(rows: DataFrame, mean: Column, error: Column) -> DataFrame:
    return rows.withColumns({"mean": mean, **{name: mean + z * error for name, z in BANDS.items()}})


def closed_forms(known: DataFrame, horizon: int) -> DataFrame:
    """asset, origin, model, step and the log paths of the flat (naive) and the drift forecast."""
    steps = known.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    keys = ("asset", "origin", "model", "step", *PATHS)
    naive = _banded(steps.withColumn("model", F.lit("naive")), C("last"), C("sd") * F.sqrt("step"))
    error = C("sd") * F.sqrt(C("step") * (1 + C("step") / C("t")))
    drift = _banded(steps.withColumn("model", F.lit("drift")), C("last") + C("mu") * C("step"), error)
    return naive.select(*keys).unionByName(drift.select(*keys))


_SCHEMA = "asset string, origin int, model string, step int, " + ", ".join(f"{p} double" for p in PATHS) + ", error string, info map<string,double>"


def arima_orders(rows: DataFrame, at: DataFrame) -> DataFrame:
    """asset, order (p, q and trend): the candidate with the least AICc on all days before the asset's first origin. Each
    candidate is fitted by itself."""
    first = at.groupBy("asset").agg(F.min("origin").alias("first"))
    candidates = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(q).alias("q"), F.lit(trend).alias("trend")) for p, q, trend in models.ORDERS))
    dealt = rows.join(first, "asset").where("i < first").select("asset", "i", "y", F.explode(candidates).alias("order"))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        order = frame["order"].iloc[0]
        order = dict(order) if isinstance(order, dict) else order.asDict()
        try:
            aicc = models.arima_aicc(frame.sort_values("i")["y"].to_numpy(dtype=float), **order)
        except (ValueError, ArithmeticError):
            aicc = float("nan")
        return pd.DataFrame([{"asset": frame["asset"].iloc[0], **order, "aicc": aicc}])

    fitted = dealt.groupBy("asset", "order").applyInPandas(fit, "asset string, p int, q int, trend boolean, aicc double")
    known = fitted.where("NOT isnan(aicc)")
    return known.groupBy("asset").agg(F.min_by(F.struct("p", "q", "trend"), F.struct("aicc", "p", "q", "trend")).alias("order"))


def iterative(rows: DataFrame, at: DataFrame, horizon: int, names: tuple[str, ...] = ITERATIVE) -> DataFrame:
    """The same columns for the iterative models, with what they tell about their fit. A model that fails, or whose mean
    isn't finite, has one row with the error and no step. The order of ARIMA is chosen on the days before an asset's
    first origin and used for all of them."""
    own = rows.join(at, "asset").where("i < origin").select("asset", "origin", "i", "y")
    dealt = own.withColumn("model", F.explode(F.array(*map(F.lit, names))))
    if "arima" in names:
        dealt = dealt.join(arima_orders(rows, at), "asset", "left")
    else:
        dealt = dealt.withColumn("order", F.lit(None).cast("struct<p:int,q:int,trend:boolean>"))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("i")
        y, model, order = frame["y"].to_numpy(dtype=float), frame["model"].iloc[0], frame["order"].iloc[0]
        keys = {"asset": frame["asset"].iloc[0], "origin": int(frame["origin"].iloc[0]), "model": model}
        try:
            paths, info = models.forecast(model, y, horizon, tuple(order[k] for k in ("p", "q", "trend")) if order is not None else None)
            if not np.isfinite(paths["mean"]).all():
                raise ValueError("its mean isn't finite")
            return pd.DataFrame({**keys, "step": np.arange(1, horizon + 1), **paths, "error": None, "info": [info] * horizon})
        except (ValueError, ArithmeticError, np.linalg.LinAlgError) as failed:
            return pd.DataFrame([{**keys, "step": None, **dict.fromkeys(PATHS), "error": str(failed), "info": None}])

    return dealt.groupBy("asset", "origin", "model").applyInPandas(fit, _SCHEMA)


def with_ensemble(paths: DataFrame) -> DataFrame:
    """The paths and, where more than one model gave a step, their mean in logs as model `ensemble`."""
    both = paths.groupBy("asset", "origin", "step").agg(*(F.avg(p).alias(p) for p in PATHS), F.count("*").alias("models")).where("models > 1")
    return paths.unionByName(both.select("asset", "origin", F.lit("ensemble").alias("model"), "step", *PATHS))


def fold_metrics(rows: DataFrame, paths: DataFrame, horizon: int) -> DataFrame:
    """Of each asset, origin and model: errors in percent, in prices, direction and how often the 95 percent band held."""
    price = rows.select("asset", C("i").alias("at"), F.exp("y").alias("price"))
    base = price.select("asset", C("at").alias("base_at"), C("price").alias("base"))
    told = paths.withColumns({"at": C("origin") + C("step") - 1, "base_at": C("origin") - 1, "guess": F.exp("mean")})
    each = told.join(price, ["asset", "at"]).join(base, ["asset", "base_at"])
    off = F.abs(C("guess") / C("price") - 1) * 100
    last = lambda c: F.max_by(c, "step")
    out = each.groupBy("asset", "origin", "model").agg(
        F.avg(off).alias("mape"),
        last(off).alias("mape_final"),
        F.sqrt(F.avg(F.pow(C("guess") - C("price"), 2))).alias("rmse"),
        F.avg(F.abs(C("guess") - C("price"))).alias("mae"),
        last(C("guess") / C("base") - 1).alias("told"),
        last(C("price") / C("base") - 1).alias("went"),
        F.avg(((F.log("price") >= C("lo95")) & (F.log("price") <= C("hi95"))).cast("double")).alias("coverage95"),
    )
    right = F.when(F.abs("told") > 1e-9, (F.signum("told") == F.signum("went")).cast("double"))
    return out.withColumn("direction", right).drop("told", "went")


def model_metrics(folds: DataFrame) -> DataFrame:
    """Means over the folds, and the skill against the flat forecast on the same origins, in percent."""
    naive = folds.where("model = 'naive'").select("asset", "origin", C("mape").alias("flat"))
    names = ("mape", "mape_final", "rmse", "mae", "direction", "coverage95")
    out = folds.join(naive, ["asset", "origin"], "left").groupBy("asset", "model").agg(*(F.avg(c).alias(c) for c in names), F.avg("flat").alias("flat"), F.count("*").alias("windows"))
    return out.withColumn("skill", 100 * (1 - C("mape") / F.nullif("flat", F.lit(0.0)))).drop("flat")


def ranked(metrics: DataFrame) -> DataFrame:
    """With `place`: by skill, the flat forecast first among equals."""
    by = Window.partitionBy("asset").orderBy(F.round("skill", 6).desc_nulls_last(), (C("model") != "naive").asc(), "model")
    return metrics.withColumn("place", F.row_number().over(by))


def walk_forward(panel: DataFrame, horizon: int = 30, folds: int = 6, names: tuple[str, ...] = ()) -> DataFrame:
    """Fold metrics of the closed forms, the named iterative models and the ensemble."""
    rows = series(panel)
    at = origins(rows, horizon, folds)
    paths = closed_forms(moments(rows, at), horizon)
    if names:
        paths = paths.unionByName(iterative(rows, at, horizon, names).where("error IS NULL").select(*paths.columns))
    return fold_metrics(rows, with_ensemble(paths), horizon)


def forecasts(panel: DataFrame, horizon: int = 30, names: tuple[str, ...] = ITERATIVE) -> DataFrame:
    """asset, model, step, last_price and the price paths after the last day; LEAST_ROWS days more than the horizon are
    needed."""
    rows = series(panel).where(C("n") >= LEAST_ROWS + horizon)
    at = ends(rows)
    known = moments(rows, at)
    paths = closed_forms(known, horizon)
    if names:
        paths = paths.unionByName(iterative(rows, at, horizon, names).where("error IS NULL").select(*paths.columns))
    last = known.select("asset", F.exp("last").alias("last_price"))
    return with_ensemble(paths).join(last, "asset").select("asset", "model", "step", "last_price", *(F.exp(p).alias(p) for p in PATHS))


def report(panel: DataFrame, horizon: int = 30, folds: int = 6, names: tuple[str, ...] = ITERATIVE) -> DataFrame:
    """One row per asset: its best model (of those that have a forecast and LEAST_WINDOWS windows or more the one with the
    highest skill, else the flat one), that model's skill and windows, the price it expects at the horizon, the models
    that beat the flat one (the best first), and those that were validated on fewer windows than there are."""
    metrics = ranked(model_metrics(walk_forward(panel, horizon, folds, names)))
    final = forecasts(panel, horizon, names).where(C("step") == horizon).select("asset", "model", "last_price", C("mean").alias("expected_price"), "lo95", "hi95")
    told = metrics.select("asset", "model", "windows", "skill", "place", F.max("windows").over(Window.partitionBy("asset")).alias("of")).join(final, ["asset", "model"], "left")
    reliable = (C("windows") >= LEAST_WINDOWS) & C("expected_price").isNotNull()
    row = F.struct("model", "skill", "windows", "last_price", "expected_price", "lo95", "hi95")
    beats = F.when(reliable & (C("model") != "naive") & (C("skill") > 0), F.struct("place", "model"))
    grouped = told.groupBy("asset").agg(
        F.coalesce(F.min_by(row, F.when(reliable, C("place"))), F.max(F.when(C("model") == "naive", row))).alias("r"),
        F.array_join(F.transform(F.array_sort(F.collect_list(beats)), lambda x: x["model"]), ",").alias("beat_naive"),
        F.array_join(F.array_sort(F.collect_list(F.when(C("windows") < C("of"), C("model")))), ",").alias("few_windows"),
    )
    return grouped.select("asset", C("r.model").alias("best"), "r.skill", "r.windows", "r.last_price", "r.expected_price", "r.lo95", "r.hi95", "beat_naive", "few_windows")


def failures(panel: DataFrame, horizon: int = 30, names: tuple[str, ...] = ITERATIVE) -> DataFrame:
    """asset, model, error of the models that were skipped in the final forecast."""
    rows = series(panel)
    return iterative(rows, ends(rows), horizon, names).where("error IS NOT NULL").select("asset", "model", "error")


def ljung_box(panel: DataFrame, lags: int = 10) -> DataFrame:
    """Portmanteau statistic of the log returns' first `lags` (an even number) autocorrelations, and its p-value."""
    own = Window.partitionBy("asset")
    x = panel.where("log_returns IS NOT NULL").select("asset", "d", (C("log_returns") - F.avg("log_returns").over(own)).alias("e"))
    shifted = x.select("asset", "e", *(F.lag("e", k).over(ordered()).alias(f"e{k}") for k in range(1, lags + 1)))
    sums = shifted.groupBy("asset").agg(F.count("*").alias("n"), F.sum(C("e") * C("e")).alias("s"), *(F.sum(C("e") * C(f"e{k}")).alias(f"s{k}") for k in range(1, lags + 1)))
    parts = sum((F.pow(C(f"s{k}") / F.nullif("s", F.lit(0.0)), 2) / (C("n") - k) for k in range(1, lags + 1)), F.lit(0.0))
    q = C("n") * (C("n") + 2) * parts
    tail = lambda q: F.exp(-q / 2) * sum((F.pow(q / 2, F.lit(j)) / math.factorial(j) for j in range(lags // 2)), F.lit(0.0))
    return sums.select("asset", "n", q.alias("q")).withColumn("p_value", tail(C("q")))


def unit_root(panel: DataFrame) -> DataFrame:
    """asset, series (price, return), the augmented Dickey-Fuller statistic with a constant, its lags (chosen by AIC)
    and whether it is below the 5 percent point."""
    logs = panel.where("close > 0").select("asset", "d", F.log("close").alias("price"))
    wide = logs.withColumn("return", C("price") - F.lag("price").over(ordered()))
    both = wide.select("asset", "d", F.explode(F.create_map(F.lit("price"), "price", F.lit("return"), "return")).alias("series", "y")).where("y IS NOT NULL")

    def test(frame: pd.DataFrame) -> pd.DataFrame:
        y = frame.sort_values("d")["y"].to_numpy(dtype=float)
        value, lags, point = models.dickey_fuller(y)
        return pd.DataFrame([{"asset": frame["asset"].iloc[0], "series": frame["series"].iloc[0], "statistic": value, "lags": lags, "point_5": point, "stationary": bool(value is not None and value < point)}])

    return both.groupBy("asset", "series").applyInPandas(test, "asset string, series string, statistic double, lags int, point_5 double, stationary boolean")
