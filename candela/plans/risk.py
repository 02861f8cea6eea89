"""Queries of risk measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.operators import risk
from candela.plans import fixtures as fx
from candela.plans.market import r, rounded

QUERIES, ORACLES = {}, {}


def add(name: str, build, sql: str, digits: int = 6, **special: int) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(build(fx.flag_prices(spark, sf_dir)), digits, **special)
    ORACLES[name] = f"WITH {fx.FLAG_PRICES}, {sql}"


def told(columns: dict[str, int], source: str, *keys: str) -> str:
    return f"SELECT {', '.join([*keys, *(r(c, n) for c, n in columns.items())])} FROM {source}"


RATIOS = """rat AS (SELECT asset, CASE WHEN min(returns) <= -1 THEN -1.0 ELSE exp(sum(CASE WHEN returns > -1 THEN ln(1 + returns) END) * 365 / count(returns)) - 1 END AS cagr, stddev_samp(returns) * sqrt(365) AS volatility,
 CASE WHEN stddev_samp(returns) > 1e-12 THEN (avg(returns) - 0.04 / 365) * sqrt(365) / stddev_samp(returns) END AS sharpe,
 CASE WHEN sqrt(avg(CASE WHEN returns IS NOT NULL THEN pow(least(returns - 0.04 / 365, 0), 2) END)) > 1e-12 THEN avg(returns - 0.04 / 365) * sqrt(365) / sqrt(avg(CASE WHEN returns IS NOT NULL THEN pow(least(returns - 0.04 / 365, 0), 2) END)) END AS sortino FROM prices GROUP BY 1)"""
add("sharpe_sortino", lambda p: risk.ratios(p, 0.04).select("asset", "volatility", "sharpe", "sortino", F.log1p("cagr").alias("log_growth")), RATIOS + ", o AS (SELECT *, ln(1 + cagr) AS log_growth FROM rat) " + told({"volatility": 6, "sharpe": 6, "sortino": 6, "log_growth": 6}, "o", "asset"))
_VOLS = ", ".join(f"CASE WHEN count(CASE WHEN k <= {w} THEN 1 END) = {w} THEN stddev_samp(CASE WHEN k <= {w} THEN returns END) * sqrt(365) * 100 END AS vol_{w}" for w in (7, 30, 90, 365))
VOLS = f"ranked AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY d DESC) AS k FROM prices WHERE returns IS NOT NULL), vols AS (SELECT asset, {_VOLS} FROM ranked GROUP BY 1)"
add("vol_windows", risk.window_volatilities, VOLS + " " + told({f"vol_{w}": 5 for w in (7, 30, 90, 365)}, "vols", "asset"), 5)
_ROLL = "OVER (PARTITION BY asset ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"
add("rolling_vol", lambda p: p.select("asset", "d", risk.rolling_volatility().alias("rolling_vol")), f"o AS (SELECT asset, d, CASE WHEN count(returns) {_ROLL} >= 30 THEN stddev_samp(returns) {_ROLL} * sqrt(365) * 100 END AS rolling_vol FROM prices) " + told({"rolling_vol": 5}, "o", "asset", "d"), 5)
_SK = "(avg(returns * returns * returns) - 3 * avg(returns) * avg(returns * returns) + 2 * pow(avg(returns), 3)) / pow(var_pop(returns), 1.5)"
_Z = {95: "-1.6448536269514729::DOUBLE", 99: "-2.3263478740408408::DOUBLE"}
_CF = ", ".join(f"mu + {z} * sd AS normal_var_{q}, mu + ({z} + ({z} * {z} - 1) * s / 6 + (pow({z}, 3) - 3 * {z}) * k / 24 - (2 * pow({z}, 3) - 5 * {z}) * s * s / 36) * sd AS cf_var_{q}" for q, z in _Z.items())
VAR = f"""vs AS (SELECT asset, quantile_cont(returns, 0.05) AS var_95, quantile_cont(returns, 0.01) AS var_99, avg(returns) AS mu, stddev_samp(returns) AS sd, {_SK} AS s, kurtosis_pop(returns) AS k FROM prices WHERE returns IS NOT NULL GROUP BY 1),
cv AS (SELECT p.asset, avg(CASE WHEN returns <= var_95 THEN returns END) AS cvar_95, avg(CASE WHEN returns <= var_99 THEN returns END) AS cvar_99 FROM prices p JOIN vs ON vs.asset = p.asset WHERE returns IS NOT NULL GROUP BY 1),
var AS (SELECT vs.asset, var_95, var_99, cvar_95, cvar_99, {_CF} FROM vs JOIN cv ON cv.asset = vs.asset)"""
_VAR_COLUMNS = ["var_95", "var_99", "cvar_95", "cvar_99", "normal_var_95", "normal_var_99", "cf_var_95", "cf_var_99"]
add("var_cvar", risk.value_at_risk, VAR + " " + told(dict.fromkeys(_VAR_COLUMNS, 6), "var", "asset"))
TAILS = f"""ts AS (SELECT asset, count(*) AS n, avg(returns) AS mu, stddev_samp(returns) AS sd, {_SK} AS skew, kurtosis_pop(returns) AS kurtosis, max(returns) AS best, first(d ORDER BY returns DESC, d) AS best_day, min(returns) AS worst,
 first(d ORDER BY returns, d) AS worst_day, avg((returns > 0)::INT) * 100 AS positive_pct FROM prices WHERE returns IS NOT NULL GROUP BY 1),
ex AS (SELECT p.asset, count(CASE WHEN abs(returns - mu) > 3 * sd THEN 1 END) AS extreme_days FROM prices p JOIN ts ON ts.asset = p.asset GROUP BY 1),
tails AS (SELECT ts.*, exp(-n / 6.0 * (skew * skew + kurtosis * kurtosis / 4) / 2) AS jb_p, n * 0.0026997960632601866::DOUBLE AS expected_extremes, extreme_days FROM ts JOIN ex ON ex.asset = ts.asset)"""
_TAIL_COLUMNS = {"skew": 6, "kurtosis": 6, "best": 6, "worst": 6, "positive_pct": 6, "jb_p": 6, "expected_extremes": 6}
add("tail_risk", risk.tails, TAILS + " " + told(_TAIL_COLUMNS, "tails", "asset", "n", "best_day", "worst_day", "extreme_days", "jb_p > 0.05 AS is_normal"))
_CUM = "OVER (PARTITION BY asset ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
CURVE = f"curve AS (SELECT asset, d, close, max(close) {_CUM} AS peak, close / max(close) {_CUM} - 1 AS drawdown FROM prices)"
add("drawdown_curve", lambda p: risk.drawdowns(p).select("asset", "d", "drawdown"), CURVE + " " + told({"drawdown": 6}, "curve", "asset", "d"))
DRAW = CURVE + """, tro AS (SELECT asset, min(drawdown) AS max_drawdown, first(d ORDER BY drawdown, d) AS trough_day, first(peak ORDER BY drawdown, d) AS top, max(d) AS last_day, last(drawdown ORDER BY d) AS current FROM curve GROUP BY 1),
dd AS (SELECT c.asset, max_drawdown, trough_day, current, max(CASE WHEN d <= trough_day AND close = top THEN d END) AS peak_day, min(CASE WHEN d > trough_day AND close >= top THEN d END) AS recovery_day, last_day
 FROM curve c JOIN tro t ON t.asset = c.asset GROUP BY ALL), draw AS (SELECT asset, max_drawdown, trough_day, current, peak_day, recovery_day, CAST(date_diff('day', peak_day, coalesce(recovery_day, last_day)) AS INT) AS duration FROM dd)"""
add("drawdown_summary", risk.drawdown_summary, DRAW + " " + told({"max_drawdown": 6, "current": 6}, "draw", "asset", "trough_day", "peak_day", "recovery_day", "duration"))
_BENCH = "ben AS (SELECT d, returns AS bench FROM prices WHERE asset = 'A'), pair AS (SELECT p.asset, p.d, returns, bench FROM prices p JOIN ben ON ben.d = p.d WHERE returns IS NOT NULL AND bench IS NOT NULL)"


def _bench(p):
    return p.where("asset = 'A'").select("d", F.col("returns").alias("bench"))


add("beta_corr", lambda p: risk.against(p, _bench(p)), _BENCH + ", o AS (SELECT asset, CASE WHEN count(*) >= 30 THEN covar_samp(returns, bench) / nullif(var_samp(bench), 0) END AS beta, CASE WHEN count(*) >= 30 THEN corr(returns, bench) END AS correlation, CASE WHEN count(*) >= 30 THEN pow(corr(returns, bench), 2) END AS r_squared FROM pair GROUP BY 1) " + told({"beta": 6, "correlation": 6, "r_squared": 6}, "o", "asset"))
_W90 = "OVER (PARTITION BY asset ORDER BY d ROWS BETWEEN 89 PRECEDING AND CURRENT ROW)"
add("rolling_corr_90", lambda p: risk.rolling_correlation(p.where("asset <> 'A'"), _bench(p)).select("asset", "d", "rolling_corr"), _BENCH + f", o AS (SELECT asset, d, CASE WHEN count(*) {_W90} >= 90 THEN corr(returns, bench) {_W90} END AS rolling_corr FROM pair WHERE asset <> 'A') " + told({"rolling_corr": 6}, "o", "asset", "d"))


def _sc(x: str, low: float, high: float) -> str:
    return f"CASE WHEN ({x}) IS NULL THEN 5.0 ELSE greatest(0.0, least(10.0, ({x} - {low}) / ({high} - {low}) * 10)) END"


SCORES = f"""{RATIOS},
{VAR},
{DRAW},
{VOLS},
sco AS (
  SELECT rat.asset,
    {_sc('vol_30', 0.0, 120.0)} AS volatility_score,
    {_sc('abs(max_drawdown) * 100', 0.0, 80.0)} AS drawdown_score,
    {_sc('CASE WHEN var_95 < 0 THEN -var_95 * 100 WHEN var_95 >= 0 THEN 0 END', 0.0, 8.0)} AS var_score,
    {_sc('sharpe', 2.0, -1.0)} AS sharpe_score
  FROM rat JOIN var ON var.asset = rat.asset JOIN draw ON draw.asset = rat.asset JOIN vols ON vols.asset = rat.asset
),
scored AS (
  SELECT *, 0.3::DOUBLE * volatility_score + 0.25 * drawdown_score + 0.25 * var_score + 0.2::DOUBLE * sharpe_score AS risk_score
  FROM sco
),
leveled AS (
  SELECT *, CASE WHEN risk_score <= 2.5 THEN 'low' WHEN risk_score <= 5 THEN 'moderate' WHEN risk_score <= 7.5 THEN 'high' ELSE 'very_high' END AS risk_level
  FROM scored
)"""
_SCORE_COLUMNS = ["volatility_score", "drawdown_score", "var_score", "sharpe_score", "risk_score"]
add("risk_score", lambda p: risk.report(p, 0.04).select("asset", *_SCORE_COLUMNS, "risk_level"), SCORES + " " + told(dict.fromkeys(_SCORE_COLUMNS, 6), "leveled", "asset", "risk_level"))
EWMA = """ew AS (SELECT asset, sqrt(sum(CASE WHEN k = n THEN 1.0 ELSE 0.06::DOUBLE END * pow(0.94::DOUBLE, k - 1) * returns * returns) * 365) * 100 AS ewma_vol
 FROM (SELECT asset, returns, row_number() OVER (PARTITION BY asset ORDER BY d DESC) AS k, count(*) OVER (PARTITION BY asset) AS n FROM prices WHERE returns IS NOT NULL) GROUP BY 1)"""
_REPORT = {"ewma_vol": 5, "volatility": 6, "log_calmar": 6, "sharpe": 6, "sortino": 6, "max_drawdown": 6, "current": 6, "var_95": 6, "cvar_99": 6, "cf_var_95": 6, "skew": 6, "kurtosis": 6, "vol_30": 5, "risk_score": 6}
add("risk_report", lambda p: risk.report(p, 0.04).withColumn("log_calmar", F.log("calmar")).select("asset", "trough_day", "best_day", "extreme_days", "risk_level", *_REPORT), f"{SCORES}, {TAILS}, {EWMA} " + told(_REPORT, "(SELECT *, ln(cagr / abs(max_drawdown)) AS log_calmar FROM leveled JOIN ew USING (asset) JOIN rat USING (asset) JOIN draw USING (asset) JOIN var USING (asset) JOIN tails USING (asset) JOIN vols USING (asset))", "asset", "trough_day", "best_day", "extreme_days", "risk_level"), vol_30=5, ewma_vol=5)
add("return_histogram", risk.histogram, """he AS (SELECT asset, min(returns) AS a, max(returns) AS b, avg(returns) AS mu, stddev_samp(returns) AS sd, count(*) AS total FROM prices WHERE returns IS NOT NULL GROUP BY 1),
hb AS (SELECT p.asset, CAST(least(floor((returns - a) / (b - a) * 70), 69) AS INT) AS bin, any_value(a) AS a, any_value((b - a) / 70) AS width, any_value(mu) AS mu, any_value(sd) AS sd, any_value(total) AS total, count(*) AS n
 FROM prices p JOIN he ON he.asset = p.asset WHERE returns IS NOT NULL GROUP BY 1, 2),
o AS (SELECT asset, bin, n, a + (bin + 0.5::DOUBLE) * width AS middle, n / (total * width) AS density, exp(-0.5::DOUBLE * pow((a + (bin + 0.5::DOUBLE) * width - mu) / sd, 2)) / (sd * sqrt(2 * pi())) AS normal FROM hb)
""" + told({"middle": 6, "density": 6, "normal": 6}, "o", "asset", "bin", "n"))
QUERIES["position_size"] = lambda spark, sf_dir: rounded(fx.table(spark, sf_dir, "customer").select("c_custkey", risk.position_size(F.col("c_acctbal"), F.lit(0.02), F.pmod("c_custkey", F.lit(7)).cast("double") / 100).alias("size")))
ORACLES["position_size"] = "WITH o AS (SELECT c_custkey, CASE WHEN c_acctbal <= 0 OR c_custkey % 7 = 0 THEN 0.0 ELSE least(c_acctbal, c_acctbal * 0.02::DOUBLE / ((c_custkey % 7)::DOUBLE / 100)) END AS size FROM customer) " + told({"size": 6}, "o", "c_custkey")
_CH = ", ".join(f"(close / lag(close, {n}) OVER (PARTITION BY asset ORDER BY d) - 1) * 100 AS change_{n}" for n in (1, 7, 30, 365))
add("snapshot", lambda p: risk.snapshot(p).drop("high", "low", "volume"), f"ch AS (SELECT asset, d, close, high, {_CH} FROM prices), o AS (SELECT asset, last(close ORDER BY d) AS price, {', '.join(f'last(change_{n} ORDER BY d) AS change_{n}' for n in (1, 7, 30, 365))}, max(high) AS ath, first(d ORDER BY high DESC, d) AS ath_day, (last(close ORDER BY d) / max(high) - 1) * 100 AS ath_distance FROM ch GROUP BY 1) " + told({"price": 4, **{f"change_{n}": 4 for n in (1, 7, 30, 365)}, "ath": 4, "ath_distance": 4}, "o", "asset", "ath_day"), 4)
# units in circulation: all that was sold so far
_SUPPLY = "close * sum(volume) OVER (PARTITION BY asset ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
add(
    "snapshot_ranked",
    lambda p: risk.snapshot(p.withColumn("market_cap", F.expr(_SUPPLY))).select("asset", "rank", "high", "low", "volume", "market_cap", "supply"),
    f"""mc AS (SELECT *, {_SUPPLY} AS market_cap FROM prices),
la AS (SELECT asset, last(close ORDER BY d) AS price, last(high ORDER BY d) AS high, last(low ORDER BY d) AS low, last(volume ORDER BY d) AS volume, last(market_cap ORDER BY d) AS market_cap FROM mc GROUP BY 1),
o AS (SELECT *, market_cap / price AS supply, row_number() OVER (ORDER BY market_cap DESC, asset) AS rank FROM la) """ + told({"high": 4, "low": 4, "volume": 4, "market_cap": 2, "supply": 2}, "o", "asset", "rank"),
    4, market_cap=2, supply=2,
)
add(
    "period_extremes",
    risk.period_extremes,
    "o AS (SELECT asset, max(high) AS highest, first(d ORDER BY high DESC, d) AS highest_day, min(low) AS lowest, first(d ORDER BY low, d) AS lowest_day, last(close ORDER BY d) AS price, max(d) AS last_day, (last(close ORDER BY d) / max(high) - 1) * 100 AS from_highest_pct FROM prices GROUP BY 1) "
    + told({"highest": 4, "lowest": 4, "price": 4, "from_highest_pct": 4}, "o", "asset", "highest_day", "lowest_day", "last_day"),
    4,
)


def _mood(spark, sf_dir):
    """An index of 0 to 100 on the days with urgent orders: their share of the day's orders. Days without one are missing."""
    orders = fx.table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d"))
    urgent = F.count_if(F.col("o_orderpriority") == "1-URGENT")
    return orders.agg(F.when(urgent > 0, F.round(urgent * 100.0 / F.count("*"))).cast("int").alias("value")).where("value IS NOT NULL")


QUERIES["sentiment_then"] = lambda spark, sf_dir: risk.sentiment_then(fx.brand_prices(spark, sf_dir), _mood(spark, sf_dir))
ORACLES["sentiment_then"] = f"""WITH {fx.BRAND_PRICES},
mood AS (SELECT CAST(o_orderdate AS DATE) AS d, CAST(round(count(*) FILTER (o_orderpriority = '1-URGENT') * 100.0 / count(*)) AS INT) AS value FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderpriority = '1-URGENT') > 0),
told AS (SELECT d AS value_day, value, CASE WHEN row_number() OVER (ORDER BY d) > 8 THEN lag(value, 7) OVER (ORDER BY d) END AS earlier FROM mood),
ends AS (SELECT asset, max(d) AS last_day FROM prices GROUP BY 1)
SELECT asset, last_day, value, value_day, earlier FROM ends ASOF LEFT JOIN told ON last_day >= value_day"""
