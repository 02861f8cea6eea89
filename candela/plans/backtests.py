"""Queries of strategies and backtests."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from candela.operators import strategies as st
from candela.plans import fixtures as fx
from candela.plans.market import r, rounded
from candela.plans.technical import MACD, RSI, full

QUERIES, ORACLES = {}, {}
_LAG = "OVER (PARTITION BY asset ORDER BY d)"
_CUM = "OVER (PARTITION BY asset ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_BACK = "OVER (PARTITION BY asset ORDER BY d ROWS BETWEEN {} PRECEDING AND 1 PRECEDING)"


def _held(entry: str, leave: str) -> str:
    return f"coalesce(last_value(CASE WHEN {entry} THEN 1.0 WHEN {leave} THEN 0.0 END IGNORE NULLS) {_CUM}, 0.0)"


def _above(a: str, b: str) -> str:
    return f"CASE WHEN {a} > {b} THEN 1.0 ELSE 0.0 END"


_MAX20 = f"CASE WHEN count(close) {_BACK.format(20)} >= 20 THEN max(close) {_BACK.format(20)} END"
_MIN10 = f"CASE WHEN count(close) {_BACK.format(10)} >= 10 THEN min(close) {_BACK.format(10)} END"
BASE = f"""{MACD}, {RSI}, ind AS (SELECT p.asset, p.d, p.close, p.returns, macd, macd_signal, rsi, {full('avg(close)', 20)} AS m20, {full('avg(close)', 50)} AS m50, {full('avg(close)', 100)} AS m100, {full('stddev_pop(close)', 20)} AS s20,
 {_MAX20} AS x20, {_MIN10} AS n10, row_number() {_LAG} - 1 AS i FROM (SELECT p.*, macd, macd_signal, rsi FROM prices p JOIN macd USING (asset, d) JOIN rsi USING (asset, d)) p),
tgt AS (SELECT *, {_above('m20', 'm50')} AS t_sma_cross, {_above('close', 'm100')} AS t_trend_filter, {_above('macd', 'macd_signal')} AS t_macd, {_held('rsi < 30', 'rsi > 70')} AS t_rsi,
 {_held('close < m20 - 2 * s20', 'close >= m20')} AS t_bollinger, {_held('close > x20', 'close < n10')} AS t_donchian FROM ind)"""


def _tested(rules: list[str]) -> str:
    first = max(1, *(st.WARM_UP[s] for s in rules))
    parts = [f"SELECT asset, '{s}' AS strategy, d, i, close, returns, {'1.0' if s == 'buy_hold' else f'coalesce(lag(t_{s}) {_LAG}, 0.0)'}::DOUBLE AS position FROM tgt" for s in rules]
    by = "OVER (PARTITION BY asset, strategy ORDER BY d)"
    return f"""{BASE}, lots AS (SELECT asset FROM tgt GROUP BY 1 HAVING count(*) - 30 > {first}), pos AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE i >= {first} AND asset IN (SELECT asset FROM lots)), trn AS (SELECT *, position - coalesce(lag(position) {by}, 0.0) AS step FROM pos),
nets AS (SELECT *, position * returns - abs(step) * 0.002::DOUBLE AS net FROM trn),
tested AS (SELECT *, sum(CASE WHEN net > -1 THEN ln(1 + net) END) OVER (PARTITION BY asset, strategy ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ln_equity FROM nets)"""


def _curve(spark, sf_dir, rules):
    return rounded(st.backtest(fx.flag_prices(spark, sf_dir), rules).select("asset", "strategy", "d", "position", "net", "ln_equity"))


_ALL = list(st.WARM_UP)
for _rule in _ALL:
    QUERIES[f"strat_{_rule}"] = partial(_curve, rules=[_rule])
    ORACLES[f"strat_{_rule}"] = f"WITH RECURSIVE {fx.FLAG_PRICES}, {_tested([_rule])} SELECT asset, strategy, d, {r('position')}, {r('net')}, {r('ln_equity')} FROM tested"
QUERIES["backtest_equity"] = partial(_curve, rules=_ALL)
ORACLES["backtest_equity"] = f"WITH RECURSIVE {fx.FLAG_PRICES}, {_tested(_ALL)} SELECT asset, strategy, d, {r('position')}, {r('net')}, {r('ln_equity')} FROM tested"
def _trades_sql(rules: list[str]) -> str:
    return f"""{_tested(rules)}, prev AS (SELECT asset, d, lag(close) {_LAG} AS price, lag(d) {_LAG} AS day FROM prices),
kth AS (SELECT t.asset, strategy, step, day, price, row_number() OVER (PARTITION BY t.asset, strategy, sign(step) ORDER BY t.d) AS k FROM tested t JOIN prev ON prev.asset = t.asset AND prev.d = t.d WHERE step <> 0),
fin AS (SELECT asset, max(d) AS last_day, last(close ORDER BY d) AS last_price FROM prices GROUP BY 1),
trs AS (SELECT a.asset, a.strategy, a.k, a.day AS entry_day, a.price AS entry_price, b.day IS NULL AS is_open, coalesce(b.day, last_day) AS exit_day, coalesce(b.price, last_price) AS exit_price FROM kth a
 LEFT JOIN (SELECT * FROM kth WHERE step < 0) b ON a.asset = b.asset AND a.strategy = b.strategy AND a.k = b.k JOIN fin ON fin.asset = a.asset WHERE a.step > 0),
trades AS (SELECT *, exit_price / entry_price * (0.998::DOUBLE * 0.998::DOUBLE) - 1 AS result, date_diff('day', entry_day, exit_day) AS days FROM trs)"""


def _with_trades(spark, sf_dir, prices=fx.flag_prices, rules=None):
    panel = prices(spark, sf_dir)
    tested = st.backtest(panel, rules)
    return tested, st.trades(tested, panel)


QUERIES["backtest_with_start"] = lambda spark, sf_dir: rounded(st.with_start(st.backtest(fx.flag_prices(spark, sf_dir), ["sma_cross"]), fx.flag_prices(spark, sf_dir)).select("asset", "strategy", "d", F.log("equity").alias("ln_equity")))
ORACLES["backtest_with_start"] = f"""WITH RECURSIVE {fx.FLAG_PRICES}, {_tested(["sma_cross"])},
fst AS (SELECT asset, strategy, min(d) AS d FROM tested GROUP BY 1, 2),
o AS (
  SELECT asset, strategy, d, ln_equity FROM tested
  UNION ALL SELECT f.asset, strategy, max(p.d), 0 FROM fst f JOIN prices p ON p.asset = f.asset AND p.d < f.d GROUP BY 1, 2
)
SELECT asset, strategy, d, {r('ln_equity')} FROM o"""
TRADES = _trades_sql(_ALL)
QUERIES["trades"] = lambda spark, sf_dir: rounded(_with_trades(spark, sf_dir)[1].select("asset", "strategy", "k", "entry_day", "exit_day", "is_open", "result", "days"))
ORACLES["trades"] = f"WITH RECURSIVE {fx.FLAG_PRICES}, {TRADES} SELECT asset, strategy, k, entry_day, exit_day, is_open, {r('result')}, days FROM trades"
# what needs only closes
_CROSSES = ["buy_hold", "sma_cross", "trend_filter", "donchian"]


def _metrics_sql(trades: str) -> str:
    return f"""{trades}, falls AS (SELECT *, exp(ln_equity - greatest(max(ln_equity) OVER (PARTITION BY asset, strategy ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)) - 1 AS fall FROM tested),
crv AS (SELECT asset, strategy, last(ln_equity ORDER BY d) AS ln_total, stddev_samp(net) * sqrt(365) AS volatility, CASE WHEN stddev_samp(net) > 1e-12 THEN avg(net) * sqrt(365) / stddev_samp(net) END AS sharpe, min(fall) AS max_drawdown, avg(position) * 100 AS invested_pct,
 CASE WHEN min(net) <= -1 THEN -1.0 ELSE exp(sum(CASE WHEN net > -1 THEN ln(1 + net) END) * 365 / count(net)) - 1 END AS annual_return,
 CASE WHEN sqrt(avg(pow(least(net, 0), 2))) > 1e-12 THEN avg(net) * sqrt(365) / sqrt(avg(pow(least(net, 0), 2))) END AS sortino FROM falls GROUP BY 1, 2),
tra AS (SELECT asset, strategy, count(*) AS trades, avg(CASE WHEN NOT is_open THEN (result > 0)::INT END) * 100 AS win_rate, avg(CASE WHEN NOT is_open AND result > 0 THEN result END) AS avg_win, avg(CASE WHEN NOT is_open AND result <= 0 THEN result END) AS avg_loss FROM trades GROUP BY 1, 2),
metrics AS (SELECT crv.*, exp(ln_total) - 1 AS total_return, CASE WHEN max_drawdown < 0 THEN annual_return / abs(max_drawdown) END AS calmar, coalesce(trades, 0) AS trades, win_rate, avg_win, avg_loss FROM crv LEFT JOIN tra ON tra.asset = crv.asset AND tra.strategy = crv.strategy)"""
METRICS = _metrics_sql(TRADES)
_METRIC_COLUMNS = ["ln_total", "total_return", "annual_return", "volatility", "sharpe", "sortino", "calmar", "max_drawdown", "invested_pct", "win_rate", "avg_win", "avg_loss"]
QUERIES["backtest_metrics"] = lambda spark, sf_dir: rounded(st.metrics(*_with_trades(spark, sf_dir)))
ORACLES["backtest_metrics"] = f"WITH RECURSIVE {fx.FLAG_PRICES}, {METRICS} SELECT asset, strategy, trades, {', '.join(map(r, _METRIC_COLUMNS))} FROM metrics"
QUERIES["beats_buy_hold"] = lambda spark, sf_dir: rounded(st.better_than_holding(st.metrics(*_with_trades(spark, sf_dir, fx.slow_prices, _CROSSES))))
ORACLES["beats_buy_hold"] = f"WITH RECURSIVE {fx.SLOW_PRICES}, {_metrics_sql(_trades_sql(_CROSSES))}, o AS (SELECT m.asset, m.strategy, m.sharpe, b.sharpe AS bench FROM metrics m JOIN metrics b ON b.asset = m.asset AND b.strategy = 'buy_hold' WHERE m.strategy <> 'buy_hold' AND m.sharpe > b.sharpe) SELECT asset, strategy, {r('sharpe')}, {r('bench')} FROM o"
_FAST, _SLOW = (5, 10, 15, 20, 30, 40), (30, 50, 75, 100, 150, 200)
_GRID_PARTS = " UNION ALL ".join(f"SELECT asset, d, i, start, returns, {a} AS fast, {b} AS slow, CASE WHEN m{a} > m{b} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS target FROM gm" for a in _FAST for b in _SLOW if a < b)
GRID = f"""gm AS (SELECT asset, d, returns, row_number() {_LAG} - 1 AS i, list_max(list_filter({list(_SLOW)}, lambda s: s < count(*) OVER (PARTITION BY asset) - 30)) AS start, {', '.join(f"{full('avg(close)', n)} AS m{n}" for n in sorted({*_FAST, *_SLOW}))} FROM prices), gl AS ({_GRID_PARTS}),
gp AS (SELECT * FROM (SELECT *, coalesce(lag(target) OVER (PARTITION BY asset, fast, slow ORDER BY d), 0) AS position FROM gl WHERE slow <= start) WHERE i >= start),
gn AS (SELECT *, position * returns - abs(position - coalesce(lag(position) OVER (PARTITION BY asset, fast, slow ORDER BY d), 0)) * 0.002::DOUBLE AS net FROM gp),
cells AS (SELECT asset, fast, slow, CASE WHEN stddev_samp(net) > 1e-12 THEN avg(net) * sqrt(365) / stddev_samp(net) END AS sharpe, sum(CASE WHEN net > -1 THEN ln(1 + net) END) AS ln_total FROM gn GROUP BY 1, 2, 3)"""
QUERIES["grid_sharpe"] = lambda spark, sf_dir: rounded(st.grid(fx.flag_prices(spark, sf_dir)))
ORACLES["grid_sharpe"] = f"WITH {fx.FLAG_PRICES}, {GRID} SELECT asset, fast, slow, {r('sharpe')}, {r('ln_total')} FROM cells"
QUERIES["grid_best"] = lambda spark, sf_dir: rounded(st.best_cell(st.grid(fx.flag_prices(spark, sf_dir))))
ORACLES["grid_best"] = f"WITH {fx.FLAG_PRICES}, {GRID} SELECT asset, fast, slow, {r('sharpe')} FROM cells WHERE sharpe IS NOT NULL QUALIFY row_number() OVER (PARTITION BY asset ORDER BY sharpe DESC, fast, slow) = 1"
# brands have short histories after their last long gap
QUERIES["grid_brands"] = lambda spark, sf_dir: rounded(st.grid(fx.brand_cents(spark, sf_dir)))
ORACLES["grid_brands"] = f"WITH {fx.BRAND_CENTS}, {GRID} SELECT asset, fast, slow, {r('sharpe')}, {r('ln_total')} FROM cells"
