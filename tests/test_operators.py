"""Known paths, identities, no look-ahead, sources and streams."""

from __future__ import annotations

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from candela.functions import formatting
from candela.operators import forecast, models, portfolio, risk, scans, signals, simulate, strategies
from candela.operators import normalize
from candela.sources import market
from candela.streaming import bars


def _panel(spark, closes, asset="a"):
    first = dt.date(2024, 1, 1)
    rows = [(asset, first + dt.timedelta(days=k), float(c), float(c) + 5, float(c) - 5, float(c), 10.0) for k, c in enumerate(closes)]
    return normalize.prices(spark.createDataFrame(rows, "asset string, d date, open double, high double, low double, close double, volume double"))


@pytest.fixture(scope="module")
def walk():
    return 100 * np.exp(np.cumsum(np.random.default_rng(123).normal(0, 0.03, 400)))


def test_rsi_is_wilders(walk):
    change = np.diff(walk)
    gain, loss = np.maximum(change, 0), np.maximum(-change, 0)
    g, l, wanted = gain[:14].mean(), loss[:14].mean(), []
    for k in range(13, len(change)):
        if k > 13:
            g, l = (13 * g + gain[k]) / 14, (13 * l + loss[k]) / 14
        wanted.append(100 - 100 / (1 + g / l))
    got = scans.rsi(walk)
    assert np.isnan(got[:14]).all() and np.allclose(got[14:], wanted, atol=1e-9)


def test_macd_is_a_difference_of_averages(walk):
    line, _ = scans.macd(walk)
    assert np.allclose(line[25:], (scans.ema(walk, 12, False) - scans.ema(walk, 26, False))[25:])


def test_bundle_does_not_look_ahead(spark, walk):
    whole, part = (scans.bundle(_panel(spark, w)) for w in (walk, walk[:300]))
    day = dt.date(2024, 1, 1) + dt.timedelta(days=299)
    a, b = (x.where(F.col("d") == day).first().asDict() for x in (whole, part))
    assert {k: v for k, v in a.items() if isinstance(v, float)} == pytest.approx({k: v for k, v in b.items() if isinstance(v, float)})


def test_a_shock_on_the_last_day_moves_no_position(spark, walk):
    shocked = walk.copy()
    shocked[-1] *= 3
    a, b = (sorted((r.strategy, r.d, r.position) for r in strategies.backtest(_panel(spark, w)).select("strategy", "d", "position").collect()) for w in (walk, shocked))
    assert a == b


def test_last_tick_counts_and_invalid_days_go(spark):
    ticks = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 10), 1.0), ("a", dt.datetime(2024, 1, 1, 12), 2.0), ("a", dt.datetime(2024, 1, 3, 9), 5.0)], "asset string, ts timestamp, close double")
    got = normalize.daily_ticks(ticks).orderBy("d").collect()
    assert [(r.d.day, r.close) for r in got] == [(1, 2.0), (3, 5.0)]


def test_optimised_weights(spark, walk):
    rng = np.random.default_rng(4)
    panel = None
    for k, name in enumerate("abc"):
        own = _panel(spark, 100 * np.exp(np.cumsum(rng.normal(0.001, 0.01 * (k + 1), 200))), name)
        panel = own if panel is None else panel.unionByName(own)
    for method in ("min_variance", "risk_parity"):
        weights = {r.asset: r.w for r in portfolio.optimised(panel, method, 0.8, 0.04).collect()}
        assert sum(weights.values()) == pytest.approx(1) and max(weights.values()) <= 0.8 + 1e-9 and weights["a"] > weights["c"]


def test_monte_carlo_without_drift_is_neutral(spark, walk):
    paths = simulate.bootstrap_paths(_panel(spark, walk), 1000, 30)
    day = {r.day: r.p50 for r in simulate.fan(paths).collect()}
    assert day[0] == pytest.approx(1000 * 0.999**4) and day[30] == pytest.approx(1000, rel=0.05)


@pytest.mark.parametrize("model", forecast.ITERATIVE)
def test_models_give_nested_bands(model, walk):
    paths, info = models.forecast(model, np.log(walk), 20, (1, 1, True))
    assert all(len(p) == 20 and np.isfinite(p).all() for p in paths.values()) and all(np.isfinite(v) for v in info.values())
    assert (paths["lo95"] <= paths["lo80"]).all() and (paths["lo80"] <= paths["mean"]).all() and (paths["hi80"] <= paths["hi95"]).all()


def test_theta_is_the_mean_of_the_trend_and_the_smoothed_level():
    """Of a line, whose curvature is nothing: half the slope a step."""
    y = 1 + 0.01 * np.arange(200)
    assert np.allclose(models.theta(y, 10)[0]["mean"], (1 + 0.01 * np.arange(200, 210) + y[-1]) / 2, atol=2e-4)


def test_models_that_cannot_be_fitted_are_skipped(spark, walk):
    short = _panel(spark, walk[:50])
    assert {r.model for r in forecast.failures(short, 30, ("boost", "theta")).collect()} == {"boost"}
    assert forecast.forecasts(short, 30).count() == 0


def test_walk_forward_does_not_see_the_future(spark, walk):
    changed = walk.copy()
    changed[-30:] *= 2
    rows = [forecast.series(_panel(spark, w)) for w in (walk, changed)]
    got = [sorted(tuple(r) for r in forecast.closed_forms(forecast.moments(x, forecast.origins(x, 30, 1)), 30).collect()) for x in rows]
    assert got[0] == got[1] and len(got[0]) == 60


def test_report_and_walk_forward_see_all_models(spark):
    """Against plain loops, on a level with noise, where smoothing is better than the last price."""
    h, folds = 5, 3
    prices = np.exp(3 + 0.05 * np.random.default_rng(6).normal(size=150))
    y = np.log(prices)
    at = [len(y) - h - k * 5 for k in range(folds)]
    order = min((models.arima_aicc(y[: min(at)], *o), *o) for o in models.ORDERS)[1:]
    errors = {}
    for origin in at:
        known = y[:origin]
        paths = {"naive": np.full(h, known[-1]), "drift": known[-1] + np.diff(known).mean() * np.arange(1, h + 1)}
        paths |= {m: models.forecast(m, known, h, order)[0]["mean"] for m in forecast.ITERATIVE}
        paths["ensemble"] = np.mean(list(paths.values()), axis=0)
        for m, mean in paths.items():
            errors[m, origin] = 100 * np.mean(np.abs(np.exp(mean) / prices[origin : origin + h] - 1))
    panel = _panel(spark, prices)
    got = {(r.model, r.origin): r.mape for r in forecast.walk_forward(panel, h, folds, forecast.ITERATIVE).collect()}
    assert got == pytest.approx(errors, rel=1e-6)
    of = {m: np.mean([errors[m, o] for o in at]) for m, _ in errors}
    best = min(of, key=of.get)
    assert best not in ("naive", "drift")
    told = forecast.report(panel, h, folds).first()
    assert told.best == best and told.skill == pytest.approx(100 * (1 - of[best] / of["naive"]), rel=1e-6)


def test_ljung_box_equals_the_arrays(spark, walk):
    got = forecast.ljung_box(_panel(spark, walk)).first()
    assert got.p_value == pytest.approx(models.portmanteau(np.diff(np.log(walk))), abs=1e-9)


def test_unit_root(spark, walk):
    got = {r.series: r.stationary for r in forecast.unit_root(_panel(spark, walk)).collect()}
    assert got == {"price": False, "return": True}


def test_formats(spark):
    rows = spark.createDataFrame([(1234.5,), (-0.001,), (None,), (float("nan"),), (float("inf"),)], "x double").select(formatting.number(F.col("x")).alias("t"), "x").collect()
    assert [r.t for r in rows] == ["1.234,50", "0,00", "—", "—", "—"]
    one = spark.range(1).select(formatting.compact(F.lit(2.5e9), "$").alias("c"), formatting.price(F.lit(5.4321)).alias("p"), formatting.percent(F.lit(1.5), signed=True).alias("s"), formatting.symbol_of(F.lit("shiny-coin")).alias("y"), formatting.title_of(F.lit("shiny-coin")).alias("n")).first()
    assert tuple(one) == ("$ 2,50 bi", "$ 5,432", "+1,50%", "SHINY", "Shiny Coin")


def test_file_sources(spark, tmp_path):
    day = 86_400_000
    (tmp_path / "abc.json").write_text(json.dumps({"prices": [[0, 1.0], [day, 2.0]], "total_volumes": [[day, 7.0]], "market_caps": []}))
    got = market.chart_json(spark, str(tmp_path / "abc.json")).orderBy("ts").collect()
    assert [(r.asset, r.close, r.volume, r.market_cap) for r in got] == [("abc", 1.0, None, None), ("abc", 2.0, 7.0, None)]
    (tmp_path / "mood.json").write_text(json.dumps({"data": [{"value": "20", "timestamp": "86400"}, {"value": "90", "timestamp": "86400"}, {"value": "x", "timestamp": "0"}]}))
    assert [(r.value, r.label) for r in market.sentiment_json(spark, str(tmp_path / "mood.json")).collect()] == [(20, "extreme_fear")]
    (tmp_path / "c.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-01,1,2,0.5,bad,3\n")
    row = market.candles_csv(spark, str(tmp_path / "c.csv")).first()
    assert (row.open, row.close) == (1.0, None)
    market.to_local_csv(spark.createDataFrame([(1, 2.5)], "a int, b double"), str(tmp_path / "out"), 2)
    assert any("1;2,50" in p.read_text() for p in (tmp_path / "out").glob("part-*"))


def test_synthetic_source_is_repeatable(spark):
    a, b = (sorted(tuple(r) for r in market.synthetic(spark, ["x", "y"], 90).collect()) for _ in range(2))
    assert a == b and len(a) == 180 and all(r[4] <= r[5] <= r[3] for r in a)


def test_retries_cache_and_failover(spark, tmp_path):
    waits, left = [], [ConnectionError(), market.SourceError("limited")]

    def fetch():
        if left:
            raise left.pop(0)
        return "rows"

    assert market.retried(fetch, sleep=waits.append) == "rows" and waits == [1.0, 4.0]
    with pytest.raises(market.SourceError):
        market.retried(lambda: (_ for _ in ()).throw(market.SourceError("not_found")), sleep=waits.append)
    now = [1000.0]
    cache, rows = market.Cache(spark, str(tmp_path / "cache"), lambda: now[0]), spark.range(3)

    def broken():
        raise market.SourceError("failed", "down")

    assert market.loaded(cache, "k/1", [("bad", broken), ("good", lambda: rows)]).source == "good"
    assert market.loaded(cache, "k/1", [("bad", broken)]).source == "cache"
    now[0] += 7200
    old = market.loaded(cache, "k/1", [("bad", broken)])
    assert old.stale and old.rows.count() == 3 and old.notices == ["bad: down"]
    now[0] += 8 * 86400
    with pytest.raises(market.SourceError):
        market.loaded(cache, "k/1", [("bad", broken)])
    assert market.order(1000, True) == ["candles", "chart"] and market.order(100, True) == ["chart", "candles"] and market.order(1000, False) == ["chart"]


def test_streamed_bars_are_the_batch_bars(spark, tmp_path):
    ticks = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("event_type").alias("asset"), F.col("ts").cast("timestamp").alias("ts"), "value")
    ticks.write.parquet(str(tmp_path / "ticks"))
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "ticks"))
    started = bars.bars(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "bars"))
    started.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "bars")).collect()}
    wanted = {tuple(r) for r in bars.bars(ticks).collect()}
    assert got and got <= wanted


def test_risk_score_by_hand(spark):
    """60 % of volatility, a fall of 40 %, 4 % at risk and a Sharpe ratio of 0.5 are in the middle of each scale."""
    rows = [("mid", 60.0, -0.4, -0.04, 0.5), ("calm", 0.0, 0.0, 0.01, 2.5), ("wild", 150.0, -0.9, -0.2, -3.0), ("unknown", None, -0.4, -0.04, 0.5), ("quarter", 30.0, -0.2, -0.02, 1.25)]
    got = {r.asset: (r.risk_score, r.risk_level) for r in risk.scores(spark.createDataFrame(rows, "asset string, vol_30 double, max_drawdown double, var_95 double, sharpe double")).collect()}
    assert {k: v for k, (_, v) in got.items()} == {"mid": "moderate", "calm": "low", "wild": "very_high", "unknown": "moderate", "quarter": "low"}
    assert [got[k][0] for k in ("mid", "calm", "wild", "unknown", "quarter")] == pytest.approx([5.0, 0.0, 10.0, 5.0, 2.5])


def test_labels_at_their_bounds(spark):
    values = [None, -0.5, -0.49, -0.1, -0.09, 0.0, 0.09, 0.1, 0.49, 0.5]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x double").withColumn("label", signals.label(F.col("x"))).orderBy("k").collect()
    assert [r.label for r in rows] == ["undefined", "strong_bear", "bear", "bear", "neutral", "neutral", "neutral", "bull", "bull", "strong_bull"]
    assert [sum(g == x for g in signals.RULES.values()) for x in ("oscillator", "trend")] == [5, 7]


def test_levels_at_the_price_are_neither(spark):
    panel = _panel(spark, [90.0, 100.0])
    found = spark.createDataFrame([("a", 100.0, 2, dt.date(2024, 1, 1)), ("a", 95.0, 1, dt.date(2024, 1, 1)), ("a", 104.0, 1, dt.date(2024, 1, 1))], "asset string, level double, touches long, last_touch date")
    assert sorted((r.side, r.level) for r in signals.nearest_levels(found, panel).collect()) == [("resistance", 104.0), ("support", 95.0)]


def test_fibonacci_of_all_days(spark):
    up = [10.0, *[50.0] * 200, 110.0]
    got = {round(r.ratio, 3): r.level for r in signals.fibonacci(_panel(spark, up)).collect()}
    assert got[0.0] == 115.0 and got[1.0] == 5.0 and got[0.5] == 60.0  # highs are five above the closes, lows five below


def test_regular_buying_by_hand(spark):
    flat = simulate.comparison(_panel(spark, [100.0] * 100)).first()
    assert flat.regular_buys == 15 and flat.lump_final == pytest.approx(1000 * 0.999**4) == flat.regular_final and flat.regular_price == pytest.approx(100.0)
    rising = simulate.comparison(_panel(spark, np.linspace(100, 200, 100))).first()
    prices = np.linspace(100, 200, 100)[::7]
    units = (1000 / 15 * 0.999**2 / prices).sum()
    assert rising.regular_final == pytest.approx(units * 200 * 0.999**2) and rising.regular_price == pytest.approx(1000 * 0.999**2 / units) and rising.lump_final > rising.regular_final
    assert simulate.comparison(_panel(spark, [100.0] * 13)).count() == 0


def test_blocks_have_five_days(spark, walk):
    ln = {(r.sim, r.day): r.ln for r in simulate.bootstrap_paths(_panel(spark, walk), 3, 10, drift="historical").collect()}
    steps = np.diff(np.log(walk))
    for sim in range(3):
        path = np.diff([0.0, *(ln[sim, d] for d in range(1, 11))])
        for block in (path[:5], path[5:]):
            assert any(np.allclose(block, np.take(steps, range(k, k + 5), mode="wrap")) for k in range(len(steps)))


def test_the_table_falls_from_its_first_value(spark):
    panel = _panel(spark, [100.0, 90.0, 99.0, 120.0]).unionByName(_panel(spark, [10.0, 11.0, 9.0, 9.0], "b"))
    got = {r.asset: r.max_drawdown for r in portfolio.asset_stats(panel).collect()}
    assert got == pytest.approx({"a": 0.0, "b": 9 / 11 - 1})


def test_invalid_closes_are_dropped_and_counted(spark):
    rows = [("a", dt.date(2024, 1, 1) + dt.timedelta(days=k), c) for k, c in enumerate(("100", "-1", "0", None, "105", "bad"))] + [("b", dt.date(2024, 1, 1), "5")]
    raw = spark.createDataFrame(rows, "asset string, d date, close string")
    got = normalize.quality(raw).collect()
    assert [(r.asset, r.points, r.filled_days, r.dropped_rows, r.longest_gap, r.trimmed_start, r.outliers) for r in got] == [("a", 5, 3, 4, 3, False, 0)]
    assert [r.close for r in normalize.prices(raw).orderBy("d").collect()] == [100.0, 100.0, 100.0, 100.0, 105.0]
    with pytest.raises(ValueError):
        normalize.numeric(raw.drop("close"))


def test_rates_of_the_day_or_before(spark):
    day = lambda k: dt.date(2024, 1, k)
    rates = spark.createDataFrame([(day(3), 2.0), (day(6), 4.0)], "d date, rate double")
    panel = spark.createDataFrame([("a", day(k), 10.0, 1.0) for k in (1, 3, 5, 6, 9)], "asset string, d date, close double, volume double")
    got = normalize.converted(panel, rates).orderBy("d").collect()
    assert [(r.rate, r.close, r.volume) for r in got] == [(2.0, 20.0, 2.0), (2.0, 20.0, 2.0), (2.0, 20.0, 2.0), (4.0, 40.0, 4.0), (4.0, 40.0, 4.0)]


def test_report_takes_the_best_reliable_model(spark, monkeypatch, walk):
    """The first place has two windows only, so the second is taken."""
    metrics = spark.createDataFrame([("a", "ensemble", 2, 9.0), ("a", "drift", 3, 4.0), ("a", "naive", 3, 0.0)], "asset string, model string, windows long, skill double")
    monkeypatch.setattr(forecast, "model_metrics", lambda folds: metrics)
    got = forecast.report(_panel(spark, walk[:200]), 5, 3, ()).first()
    assert (got.best, got.skill, got.beat_naive, got.few_windows) == ("drift", 4.0, "drift", "ensemble")


def test_backtest_record(spark, walk):
    panel = _panel(spark, walk)
    tested = strategies.backtest(panel, ["sma_cross"])
    row = strategies.metrics(tested, strategies.trades(tested, panel)).first()
    net = np.array([r.net for r in tested.orderBy("d").collect()])
    equity = np.r_[1.0, np.cumprod(1 + net)]
    fall = (equity / np.maximum.accumulate(equity) - 1).min()
    annual = equity[-1] ** (365 / len(net)) - 1
    assert (row.total_return, row.annual_return, row.max_drawdown, row.calmar) == pytest.approx((equity[-1] - 1, annual, fall, annual / abs(fall)))
    assert row.sortino == pytest.approx(net.mean() * 365**0.5 / np.sqrt((np.minimum(net, 0) ** 2).mean()))
    start = strategies.with_start(tested, panel, 1.0).orderBy("d").first()
    assert start.equity == 1.0 and start.d == dt.date(2024, 1, 1) + dt.timedelta(days=49)
    assert strategies.backtest(_panel(spark, walk[:80]), ["sma_cross"]).count() == 0


def test_manual_weights(spark, walk):
    panel = _panel(spark, walk[:40]).unionByName(_panel(spark, walk[:40] * 2, "b"))
    of = lambda wanted: {r.asset: r.w for r in portfolio.manual_weights(panel, wanted).collect()}
    assert of({"a": 3, "b": 1}) == {"a": 0.75, "b": 0.25} and of({"a": -3}) == {"a": 0.5, "b": 0.5} == of({})
