"""Saved market data, made-up sources, as-of joins, portfolios by day, distributions, amounts and streaming state."""

from __future__ import annotations

import datetime
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from candela.functions import formatting
from candela.operators import normalize, portfolio, risk, scans, simulate, strategies
from candela.sources import market
from candela.streaming import averages

DAY = datetime.date(2022, 1, 1)
BARS = "asset string, d date, open double, high double, low double, close double, volume double"


def _day(k: int) -> datetime.date:
    return DAY + datetime.timedelta(days=k)


def _raw(spark, asset="x", n=120, gap=(40, 50)):
    """Candles with a long gap, a bad close and no other flaws."""
    rows = [(asset, _day(k), 10.0, 11.0, 9.0, -1.0 if k == 5 else 10.0 + k, 1.0) for k in range(n) if not gap[0] <= k < gap[1]]
    return spark.createDataFrame(rows, BARS)


def test_collected_data_keep_their_first_record(spark, tmp_path):
    now, asked = [1000.0], []
    cache = market.Cache(spark, str(tmp_path), lambda: now[0])

    def read(days):
        asked.append(days)
        return _raw(spark)

    def down(days):
        raise market.SourceError("failed", "down")

    sources = [market.Source("first", down), market.Source("second", read, most_days=365)]
    got = market.collected(cache, "x", sources, 1000)
    assert asked == [365] and got.source == "second" and got.has_ohlc and not got.from_cache and not got.stale
    assert got.notices == ["another source was used. first: down", "second has 365 days at most", "1 assets begin after their last long gap (longest: 10 days)"]
    record = got.quality.first()
    assert (record.dropped_rows, record.longest_gap, record.trimmed_start, record.points) == (1, 10, True, 70)
    assert got.rows.count() == 70 and got.rows.agg(F.min("d")).first()[0] == _day(50)

    again = market.collected(cache, "x", [market.Source("first", down)], 1000)
    assert again.from_cache and not again.stale and again.quality.first() == record and again.notices == got.notices and again.saved_at == 1000.0
    assert sorted(map(tuple, again.rows.collect())) == sorted(map(tuple, got.rows.collect()))
    assert normalize.quality(again.rows).first().dropped_rows == 0  # what a second look at the saved rows would say

    with pytest.raises(market.SourceError):
        market.collected(cache, "y", [market.Source("first", down)], 1000)
    now[0] += 7200
    old = market.collected(cache, "x", [market.Source("first", down)], 1000, at_least=now[0])
    assert old.stale and old.from_cache and old.quality.first() == record and "2.0 hours ago" in old.notices[0] and "down" in old.notices[0]
    new = market.collected(cache, "x", sources, 100)
    assert new.saved_at == now[0] and asked == [365, 100] and not new.stale


def test_unfinished_versions_are_unseen(spark, tmp_path):
    now = [1000.0]
    cache = market.Cache(spark, str(tmp_path), lambda: now[0])
    assert cache.newest("k", 3600) is None
    cache.save("k", spark.range(3), source="a")
    spark.range(9).write.parquet(f"{cache.path('k')}/unfinished/rows")  # a save that stopped before its manifest's line
    now[0] += 1
    assert cache.load("k", 3600).count() == 3 and cache.newest("k", 3600).about == {"source": "a"}
    cache.save("k", spark.range(4), {"more": spark.range(7)})
    assert cache.load("k", 3600).count() == 4 and cache.table(cache.newest("k", 3600), "more").count() == 7
    assert cache.newest("k", 3600, at_least=2000) is None and cache.newest("k", 0.5 - 1) is None
    lines = [json.loads(x.value) for x in spark.read.text(f"{cache.path('k')}/manifest").collect()]
    assert sorted(x["saved_at"] for x in lines) == [1000.0, 1001.0]


def test_made_up_market_is_coupled(spark):
    panel = market.synthetic(spark, ["a", "b", "c"], 900)
    frame = panel.toPandas().sort_values(["asset", "d"])
    wide = frame.pivot(index="d", columns="asset", values="close")
    r = np.log(wide).diff().dropna()
    assert r.corr().to_numpy()[np.triu_indices(3, 1)].min() > 0.4  # one market moves all
    for _, own in frame.groupby("asset"):
        supply = (own["market_cap"] / own["close"]).to_numpy()
        assert np.allclose(supply, supply[0]) and (own["high"] >= own[["open", "close"]].max(axis=1)).all() and (own["low"] <= own[["open", "close"]].min(axis=1)).all()
        turnover, moves = np.log(own["volume"] / own["market_cap"])[1:], np.log(own["close"]).diff().abs()[1:]
        assert np.corrcoef(turnover, moves)[0, 1] > 0.2  # more is traded on days of large moves
        squares = (moves**2).to_numpy()
        assert np.corrcoef(squares[1:], squares[:-1])[0, 1] > 0.02  # volatility clusters


def test_pulled_is_the_loop(spark):
    rng = random.Random(2)
    rows = [(a, _day(k), rng.choice((None, rng.gauss(0, 25)))) for a in "xyz" for k in range(80)]
    made = spark.createDataFrame(rows, "asset string, d date, shock double")
    wanted = {}
    for a in "xyz":
        level = 20.0
        for _, d, x in sorted(r for r in rows if r[0] == a):
            level = min(max(50 + 0.9 * (level - 50) + (x or 0.0), 3.0), 97.0)
            wanted[a, d] = level
    for partitions in (1, 5):
        got = scans.pulled(made.repartition(partitions), "shock", 50.0, 0.9, 3.0, 97.0, start=20.0).collect()
        assert {(r.asset, r.d): r.level for r in got} == pytest.approx(wanted)
    assert any(v in (3.0, 97.0) for v in wanted.values())


def test_made_up_sentiment(spark):
    got = market.synthetic_sentiment(spark, 400).orderBy("d").collect()
    assert got[0].value == 50 and all(3 <= r.value <= 97 for r in got) and len({r.value for r in got}) > 20
    assert [r.value for r in got] == [r.value for r in market.synthetic_sentiment(spark, 400).repartition(7).orderBy("d").collect()]
    x = np.array([r.value for r in got]) - 50.0
    assert 0.75 < np.corrcoef(x[1:], x[:-1])[0, 1] < 0.99


def test_rates_by_currency_and_time(spark):
    rng = random.Random(3)
    at = lambda: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=rng.randint(0, 60 * 24 * 90))
    rates = [(c, at(), rng.random()) for c in ("usd", "eur", None) for _ in range(40)] + [("one", datetime.datetime(2024, 2, 2), 7.0)]
    rates += [("usd", rates[3][1], 5.0), ("eur", rates[50][1], None)]
    asked = [(k, rng.choice(("usd", "eur", "one", "none", None)), at()) for k in range(300)] + [(300, "usd", rates[3][1])]
    left = spark.createDataFrame(asked, "k int, currency string, ts timestamp").repartition(3)
    right = spark.createDataFrame(rates, "currency string, ts timestamp, rate double").repartition(2)
    for bucket in ("day", "month", "year"):
        got = {r.k: r.rate for r in normalize.asof(left, right, "rate", by=("currency",), at="ts", bucket=bucket).collect()}
        for k, currency, ts in asked:
            own = sorted((t, v) for c, t, v in rates if c == currency and v is not None)
            before = [x for x in own if x[0] <= ts]
            assert got[k] == (before[-1][1] if before else own[0][1] if own else None)
    twice = normalize.asof(left.unionByName(left), right, "rate", by=("currency",), at="ts")
    assert twice.count() == 2 * len(asked) and twice.columns == [*left.columns, "rate"]


def _plain_portfolio(prices, weights, boundaries, cost, initial):
    """The loop over days: holdings drift, and are brought back on the first day of a period."""
    assets = sorted(weights)
    held, paid, out, shares = {a: weights[a] * initial * (1 - cost) for a in assets}, initial * cost, [], []
    for k in range(len(prices)):
        if k:
            held = {a: held[a] * prices[k][a] / prices[k - 1][a] for a in assets}
        value = sum(held.values())
        if boundaries[k]:
            spent = cost * sum(abs(weights[a] * value - held[a]) for a in assets)
            paid += spent
            held = {a: weights[a] * (value - spent) for a in assets}
            value = sum(held.values())
        out.append(value)
        shares.append({a: held[a] / value for a in assets})
    return out, shares, paid


@pytest.mark.parametrize("period", ["none", "month", "quarter"])
def test_portfolio_by_day_is_the_loop(spark, period):
    rng = np.random.default_rng(6)
    n, weights = 200, {"x": 0.5, "y": 0.3, "z": 0.2}
    walks = {a: 100 * np.exp(np.cumsum(rng.normal(0, 0.03, n))) for a in weights}
    rows = [(a, _day(k), float(walks[a][k])) for a in weights for k in range(n)]
    panel = spark.createDataFrame(rows, "asset string, d date, close double").repartition(3)
    baskets = spark.createDataFrame([("b", a, w) for a, w in weights.items()] + [("only", "y", 1.0), ("only", "x", 0.0)], "basket string, asset string, w double")
    unit = {"none": lambda d: 0, "month": lambda d: (d.year, d.month), "quarter": lambda d: (d.year, (d.month - 1) // 3)}[period]
    turns = [k > 0 and unit(_day(k)) != unit(_day(k - 1)) for k in range(n)]
    values, shares, paid = _plain_portfolio([{a: walks[a][k] for a in weights} for k in range(n)], weights, turns, 0.002, 1000.0)
    curve = portfolio.rebalanced(panel, baskets, period, 0.002, 1000.0)
    got = {(r.basket, r.d): r.value for r in curve.collect()}
    assert [got["b", _day(k)] for k in range(n)] == pytest.approx(values)
    held = {(r.basket, r.asset, r.d): r.weight for r in portfolio.effective_weights(panel, baskets, period).collect()}
    assert [held["b", a, _day(k)] for k in range(n) for a in weights] == pytest.approx([shares[k][a] for k in range(n) for a in weights])
    assert all(held["only", "y", _day(k)] == 1.0 for k in range(n)) and ("only", "x", DAY) not in held

    told = {r.basket: r for r in portfolio.record(curve, 0.04, 0.002, 1000.0).collect()}["b"]
    v = np.array(values)
    r = v[1:] / v[:-1] - 1
    fall = (v / np.maximum.accumulate(v) - 1).min() * 100
    wanted = ((v[-1] / 1000 - 1) * 100, (np.exp(np.log1p(r).sum() * 365 / len(r)) - 1) * 100, r.std(ddof=1) * 365**0.5 * 100, (r.mean() - 0.04 / 365) * 365**0.5 / r.std(ddof=1), fall, paid)
    assert (told.total_return, told.annual_return, told.volatility, told.sharpe, told.max_drawdown, told.total_costs) == pytest.approx(wanted)
    excess = r - 0.04 / 365
    assert told.sortino == pytest.approx(excess.mean() * 365**0.5 / np.sqrt((np.minimum(excess, 0) ** 2).mean()))


def test_grid_of_short_histories(spark):
    """180 days: the largest slow period under 150 is 100; 70 days: 30; 61 days: 30 as well; 60 days: none."""
    rng = np.random.default_rng(9)
    walks = {name: 100 * np.exp(np.cumsum(rng.normal(0, 0.03, n))) for name, n in (("d180", 180), ("d70", 70), ("d61", 61), ("d60", 60))}
    rows = [(a, _day(k), float(c)) for a, closes in walks.items() for k, c in enumerate(closes)]
    panel = normalize.with_returns(spark.createDataFrame(rows, "asset string, d date, close double"))
    got = {(r.asset, r.fast, r.slow): r for r in strategies.grid(panel).collect()}
    slow_of = {a: {s for x, _, s in got if x == a} for a in walks}
    assert slow_of == {"d180": {30, 50, 75, 100}, "d70": {30}, "d61": {30}, "d60": set()}
    for (asset, fast, slow), cell in got.items():
        close, start = walks[asset], {"d180": 100}.get(asset, 30)
        mean = lambda n: np.array([close[k - n + 1 : k + 1].mean() if k >= n - 1 else np.nan for k in range(len(close))])  # noqa: E731, B023
        wanted = np.r_[0.0, (mean(fast) > mean(slow)).astype(float)[:-1]][start:]
        r = np.r_[0.0, close[1:] / close[:-1] - 1][start:]
        net = wanted * r - np.abs(np.diff(wanted, prepend=0.0)) * 0.002
        assert cell.ln_total == pytest.approx(np.log1p(net).sum(), abs=1e-9)
        assert cell.sharpe == pytest.approx(net.mean() * 365**0.5 / net.std(ddof=1)) if net.std() > 1e-12 else cell.sharpe is None


def test_histograms_count_all(spark):
    rng = np.random.default_rng(4)
    x = np.r_[rng.standard_t(2, 400) * 0.05, [3.0, -0.9]]
    rows = [("x", _day(k), float(v)) for k, v in enumerate(x)] + [("flat", _day(k), 0.01) for k in range(5)]
    got = risk.histogram(spark.createDataFrame(rows, "asset string, d date, returns double"), 70).collect()
    own = sorted((r for r in got if r.asset == "x"), key=lambda r: r.bin)
    counts, edges = np.histogram(x, 70)
    assert {r.bin: r.n for r in own} == {k: n for k, n in enumerate(counts) if n}
    assert sum(r.density for r in own) * (edges[1] - edges[0]) == pytest.approx(1.0)
    z = (own[3].middle - x.mean()) / x.std(ddof=1)
    assert own[3].normal == pytest.approx(math.exp(-z * z / 2) / (x.std(ddof=1) * math.sqrt(2 * math.pi)))
    assert [(r.bin, r.n, r.density) for r in got if r.asset == "flat"] == [(0, 5, None)]

    ends = [float(v) for v in rng.normal(0, 0.3, 2000)]
    paths = spark.createDataFrame([("x", k, d, v * d / 2) for k, v in enumerate(ends) for d in (1, 2)], "asset string, sim long, day int, ln double")
    bins = simulate.outcome_histogram(paths, 1000.0, keeps=1.0).collect()
    values = 1000 * np.exp(ends)
    a, b = np.percentile(values, [0.5, 99.5])
    n = {side: sum(r.n for r in bins if r.side == side) for side in ("below", "loss", "gain", "above")}
    assert n == {"below": (values < a).sum(), "loss": ((values >= a) & (values < 1000)).sum(), "gain": ((values >= 1000) & (values <= b)).sum(), "above": (values > b).sum()}
    assert max(r["to"] for r in bins if r.side == "loss") == pytest.approx(1000.0) == min(r["from"] for r in bins if r.side == "gain")
    counts, _ = np.histogram(values[(values >= a) & (values < 1000)], 40, (a, 1000.0))
    assert {r.bin: r.n for r in bins if r.side == "loss"} == {k: c for k, c in enumerate(counts) if c}


def test_negative_amounts(spark):
    x = F.lit(-1.5e9)
    told = spark.range(1).select(
        formatting.compact(x, "$").alias("a"), formatting.compact(x).alias("b"), formatting.money(F.lit(-1234.5), "R$").alias("c"), formatting.money(F.lit(0.004)).alias("d"), formatting.compact(F.lit(-12.3)).alias("e"),
        formatting.percent(F.lit(1.5)).alias("f"), formatting.percent(F.lit(1.5), signed=True).alias("g"), formatting.percent(F.lit(-0.001), signed=True).alias("h"), formatting.money(F.lit(None).cast("double")).alias("i"),
        formatting.ratio(F.lit(-1.234)).alias("j"), formatting.axis_format(F.lit(0.5)).alias("k"), formatting.price(F.lit(-12.0)).alias("l"),
    ).first()
    assert tuple(told) == ("-$ 1,50 bi", "-1,50 bi", "-R$ 1.234,50", "$ 0,00", "-12,30", "1,50%", "+1,50%", "0,00%", "—", "-1,23", ",.4f", "$ -12,00")


def test_ranks_by_class_are_plain_ranks(spark):
    rng = random.Random(1)
    rows = [(f"a{k:03d}", rng.choice((None, 0.0, -1.0, 2.0, 1024.0, 10 ** rng.uniform(-3, 12), -(10 ** rng.uniform(-3, 12))))) for k in range(300)]
    got = {r.asset: r["rank"] for r in risk.ranked(spark.createDataFrame(rows, "asset string, market_cap double").repartition(4)).collect()}
    wanted = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0.0), r[0]))
    assert got == {a: k for k, (a, _) in enumerate(wanted, 1)}


def test_snapshot_extremes_and_sentiment(spark):
    rows = [("x", _day(k), float(h), float(lo), float(c), 2.0, c * 7.0) for k, (h, lo, c) in enumerate([(5, 1, 3), (9, 2, 4), (9, 1, 8)])]
    panel = spark.createDataFrame(rows, "asset string, d date, high double, low double, close double, volume double, market_cap double")
    shot = risk.snapshot(panel).first()
    assert (shot.high, shot.low, shot.volume, shot.market_cap, shot.supply, shot["rank"]) == (9.0, 1.0, 2.0, 56.0, 7.0, 1)
    told = risk.period_extremes(panel).first()
    assert (told.highest, told.highest_day, told.lowest, told.lowest_day, told.last_day) == (9.0, _day(1), 1.0, DAY, _day(2))
    assert told.from_highest_pct == pytest.approx((8 / 9 - 1) * 100)

    moods = [(_day(k - 20), 40 + k) for k in range(20) if k not in (13, 18, 19)]  # 17 rows, the last five days before the end
    index = spark.createDataFrame(moods, "d date, value int")
    ends = spark.createDataFrame([("now", _day(0)), ("then", _day(-13)), ("early", _day(-40)), ("ninth", _day(-12))], "asset string, d date")
    got = {r.asset: (r.value, r.value_day, r.earlier) for r in risk.sentiment_then(ends, index).collect()}
    assert got == {"now": (57, _day(-3), 49), "then": (47, _day(-13), None), "early": (None, None, None), "ninth": (48, _day(-12), 41)}


def test_snapshots_fail_without_rows(spark, tmp_path):
    (tmp_path / "good.json").write_text('[{"id": "x", "current_price": 2.5, "market_cap_rank": 1, "price_change_percentage_24h_in_currency": -1.0}, {"current_price": 3.0}]')
    (tmp_path / "bad.json").write_text("not json")

    def limited():
        raise market.SourceError("limited")

    good, bad, gone, failed = (market.snapshot_or_nothing(spark, read) for read in (*(lambda name=name: market.snapshot_json(spark, str(tmp_path / name)) for name in ("good.json", "bad.json", "gone.json")), limited))
    assert [(r.asset, r.price, r["rank"], r.change_24h, r.volume) for r in good.collect()] == [("x", 2.5, 1, -1.0, None)]
    assert bad.count() == gone.count() == failed.count() == 0 and good.columns == bad.columns == gone.columns == failed.columns


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


@pytest.mark.parametrize("parts", [1, 4])
def test_streamed_averages_are_the_batch_ones(spark, tmp_path, rocks, parts):
    """Whatever the batches, and the order within and across them (within the time that late rows have)."""
    rng = random.Random(parts)
    closes = {a: [100.0] for a in ("x", "y")}
    for c in closes.values():
        for _ in range(59):
            c.append(c[-1] * math.exp(rng.gauss(0, 0.05)))
    closes["flat"] = [5.0] * 30
    base = datetime.datetime(2024, 1, 1)
    rows = [(a, base + datetime.timedelta(hours=k), c) for a, cs in closes.items() for k, c in enumerate(cs)]
    rows.sort(key=lambda r: (r[1] - base).total_seconds() + rng.uniform(0, 3 * 3600))  # up to three hours late
    rows.append(("end", base + datetime.timedelta(days=30), 1.0))  # moves the watermark past all others
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], "asset string, ts timestamp, close double").coalesce(1).write.mode("append").parquet(str(tmp_path / "closes"))
    stream = spark.readStream.schema("asset string, ts timestamp, close double").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "closes"))
    out = averages.averages(stream, 12, 14, "4 hours")
    started = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    started.awaitTermination(240)
    got = {(r.asset, r.ts): (r.ema, r.rsi) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.asset != "end"}
    assert len(got) == 150
    for a, cs in closes.items():
        ema, rsi = scans.ema(np.array(cs), 12), scans.rsi(np.array(cs), 14)
        for k in range(len(cs)):
            told = got[a, base + datetime.timedelta(hours=k)]
            for have, want in zip(told, (ema[k], rsi[k])):
                assert have is None if math.isnan(want) else have == pytest.approx(want)
