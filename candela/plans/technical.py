"""Queries of indicators, votes, levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.operators import indicators, scans, signals
from candela.plans import fixtures as fx
from candela.plans.market import r, rounded

QUERIES, ORACLES = {}, {}
KEYS = ("asset", "d")


def _panel_query(name: str, columns: dict[str, int], build, ctes: str) -> None:
    """A query of panel columns, each with its digits; ctes end in one named `out`."""
    QUERIES[name] = lambda spark, sf_dir: rounded(build(fx.flag_prices(spark, sf_dir)).select(*KEYS, *columns), **columns)
    ORACLES[name] = f"WITH RECURSIVE {fx.FLAG_PRICES}, {ctes} SELECT asset, d, {', '.join(r(c, n) for c, n in columns.items())} FROM out"


def win(n: int, ahead: int = 0) -> str:
    return f"OVER (PARTITION BY asset ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND {f'{ahead} FOLLOWING' if ahead else 'CURRENT ROW'})"


ORDERED = "OVER (PARTITION BY asset ORDER BY d)"
CUM = "OVER (PARTITION BY asset ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def full(x: str, n: int, of: str = "close") -> str:
    return f"CASE WHEN count({of}) {win(n)} >= {n} THEN {x} {win(n)} END"


_panel_query("sma", {"sma_20": 4, "sma_50": 4, "sma_200": 4}, indicators.declarative, "out AS (SELECT asset, d, " + ", ".join(f"{full('avg(close)', n)} AS sma_{n}" for n in (20, 50, 200)) + " FROM prices)")
BOLLINGER = f"""bb AS (SELECT asset, d, close, {full('avg(close)', 20)} AS bb_mid, {full('stddev_pop(close)', 20)} AS sigma FROM prices),
bands AS (SELECT asset, d, close, bb_mid, bb_mid + 2 * sigma AS bb_up, bb_mid - 2 * sigma AS bb_low FROM bb),
bollinger AS (SELECT *, (close - bb_low) / nullif(bb_up - bb_low, 0) AS bb_pct, (bb_up - bb_low) / nullif(bb_mid, 0) * 100 AS bb_width FROM bands)"""
_panel_query("bollinger", {"bb_mid": 4, "bb_up": 4, "bb_low": 4, "bb_pct": 6, "bb_width": 6}, indicators.declarative, BOLLINGER + ", out AS (SELECT * FROM bollinger)")
STOCH = f"""ext AS (SELECT asset, d, close, {full('max(high)', 14, 'high')} AS hi, {full('min(low)', 14, 'low')} AS lo FROM prices),
sk AS (SELECT asset, d, CASE WHEN hi IS NOT NULL THEN coalesce((close - lo) / nullif(hi - lo, 0) * 100, 50.0) END AS stoch_k, CASE WHEN hi IS NOT NULL THEN coalesce((hi - close) / nullif(hi - lo, 0) * -100, -50.0) END AS williams_r FROM ext),
stoch AS (SELECT *, {full('avg(stoch_k)', 3, 'stoch_k')} AS stoch_d FROM sk)"""
_panel_query("stochastic", {"stoch_k": 5, "stoch_d": 5}, indicators.with_stochastic, STOCH + ", out AS (SELECT * FROM stoch)")
_panel_query("williams_r", {"williams_r": 5}, indicators.with_stochastic, STOCH + ", out AS (SELECT * FROM stoch)")
LAGGED = f"lagged AS (SELECT *, lag(close) {ORDERED} AS pc, lag(high) {ORDERED} AS ph, lag(low) {ORDERED} AS pl FROM prices)"
TR = LAGGED + ", tr AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS true_range FROM lagged)"
_panel_query("true_range", {"true_range": 4}, indicators.declarative, TR + ", out AS (SELECT * FROM tr)")
OBV = LAGGED + f", obv0 AS (SELECT asset, d, close, volume, sum(coalesce(sign(close - pc), 0) * coalesce(volume, 0)) {CUM} AS obv, {full('avg(volume)', 20, 'volume')} AS volume_sma FROM lagged), obv AS (SELECT *, volume / nullif(volume_sma, 0) AS volume_ratio, {full('avg(obv)', 20, 'obv')} AS obv_sma FROM obv0)"
_panel_query("obv", {"obv": 4, "obv_sma": 4}, indicators.declarative, OBV + ", out AS (SELECT * FROM obv)")
_panel_query("volume_ratio", {"volume_sma": 4, "volume_ratio": 6}, indicators.declarative, OBV + ", out AS (SELECT * FROM obv)")
AROON = f"""ar AS (SELECT asset, d, count(close) {win(26)} AS n, list_position(list(high) {win(26)}, max(high) {win(26)}) - 1 AS u, list_position(list(low) {win(26)}, min(low) {win(26)}) - 1 AS w FROM prices),
aroon AS (SELECT asset, d, CASE WHEN n >= 26 THEN u * 100.0::DOUBLE / 25 END AS aroon_up, CASE WHEN n >= 26 THEN w * 100.0::DOUBLE / 25 END AS aroon_down, CASE WHEN n >= 26 THEN u * 100.0::DOUBLE / 25 - w * 100.0::DOUBLE / 25 END AS aroon_osc FROM ar)"""
_panel_query("aroon", {"aroon_up": 4, "aroon_down": 4, "aroon_osc": 4}, indicators.declarative, AROON + ", out AS (SELECT * FROM aroon)")
ROC = f"roc AS (SELECT asset, d, (close / nullif(lag(close, 10) {ORDERED}, 0) - 1) * 100 AS roc_10, (close / nullif(lag(close, 20) {ORDERED}, 0) - 1) * 100 AS roc_20 FROM prices)"
_panel_query("roc", {"roc_10": 4, "roc_20": 4}, indicators.declarative, ROC + ", out AS (SELECT * FROM roc)")


def decay_sql(name: str, source: str, value: str, alpha: str, seed: int = 1) -> str:
    """CTEs of a recursive average of a column without inner gaps: from the mean of the first `seed` values at the last
    of them; columns asset, d, k (the number of values so far), m."""
    return f"""{name}_v AS (SELECT asset, d, {value} AS x, row_number() OVER (PARTITION BY asset ORDER BY d) AS k FROM {source} WHERE {value} IS NOT NULL),
{name} AS (SELECT * FROM (SELECT asset, max(d) AS d, CAST({seed} AS BIGINT) AS k, avg(x) AS m FROM {name}_v WHERE k <= {seed} GROUP BY asset HAVING count(*) = {seed})
 UNION ALL SELECT v.asset, v.d, v.k, (1 - {alpha}) * e.m + {alpha} * v.x FROM {name} e JOIN {name}_v v ON v.asset = e.asset AND v.k = e.k + 1)"""


def span(n: int) -> str:
    return f"(2.0::DOUBLE / {n + 1})"


EMA = ", ".join(decay_sql(f"e{n}", "prices", "close", span(n)) for n in (12, 26, 50))
_panel_query("ema", {"ema_12": 4, "ema_26": 4, "ema_50": 4}, scans.recursive, EMA + ", out AS (SELECT p.asset, p.d, " + ", ".join(f"CASE WHEN e{n}.k >= {n} THEN e{n}.m END AS ema_{n}" for n in (12, 26, 50)) + " FROM prices p " + " ".join(f"JOIN e{n} ON e{n}.asset = p.asset AND e{n}.d = p.d" for n in (12, 26, 50)) + ")")
MACD = f"""{", ".join(decay_sql(f"m{n}", "prices", "close", span(n)) for n in (12, 26))},
ml AS (SELECT a.asset, a.d, CASE WHEN a.k >= 26 THEN a.m - b.m END AS macd FROM m12 a JOIN m26 b ON a.asset = b.asset AND a.d = b.d), {decay_sql("ms", "ml", "macd", span(9))},
macd AS (SELECT l.asset, l.d, l.macd, s.m AS macd_signal, l.macd - s.m AS macd_hist FROM ml l LEFT JOIN ms s ON s.asset = l.asset AND s.d = l.d)"""
_panel_query("macd", {"macd": 4, "macd_signal": 4, "macd_hist": 4}, scans.recursive, MACD + ", out AS (SELECT * FROM macd)")
RSI = f"""chg AS (SELECT asset, d, close - lag(close) {ORDERED} AS c FROM prices), gl AS (SELECT asset, d, CASE WHEN c IS NOT NULL THEN greatest(c, 0) END AS g, CASE WHEN c IS NOT NULL THEN greatest(-c, 0) END AS l FROM chg),
{decay_sql("rg", "gl", "g", "(1.0::DOUBLE / 14)", 14)}, {decay_sql("rl", "gl", "l", "(1.0::DOUBLE / 14)", 14)},
rsi AS (SELECT p.asset, p.d, CASE WHEN rl.m = 0 THEN CASE WHEN rg.m = 0 THEN 50.0 ELSE 100.0 END ELSE 100 - 100 / (1 + rg.m / rl.m) END AS rsi FROM prices p LEFT JOIN rg ON rg.asset = p.asset AND rg.d = p.d LEFT JOIN rl ON rl.asset = p.asset AND rl.d = p.d)"""
_panel_query("rsi", {"rsi": 5}, scans.recursive, RSI + ", out AS (SELECT * FROM rsi)")
ATR = TR + ", " + decay_sql("avtr", "tr", "true_range", "(1.0::DOUBLE / 14)", 14) + ", atr AS (SELECT p.asset, p.d, p.close, avtr.m AS atr FROM prices p LEFT JOIN avtr ON avtr.asset = p.asset AND avtr.d = p.d)"
_panel_query("atr", {"atr": 4}, scans.recursive, ATR + ", out AS (SELECT * FROM atr)")
ADX = f"""{ATR}, mv AS (SELECT asset, d, high - ph AS up, pl - low AS dn FROM lagged), dm AS (SELECT asset, d, CASE WHEN up IS NOT NULL THEN CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END END AS p, CASE WHEN up IS NOT NULL THEN CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END END AS q FROM mv),
{decay_sql("dp", "dm", "p", "(1.0::DOUBLE / 14)", 14)}, {decay_sql("dq", "dm", "q", "(1.0::DOUBLE / 14)", 14)},
di AS (SELECT a.asset, a.d, 100 * dp.m / nullif(a.atr, 0) AS di_plus, 100 * dq.m / nullif(a.atr, 0) AS di_minus FROM atr a LEFT JOIN dp ON dp.asset = a.asset AND dp.d = a.d LEFT JOIN dq ON dq.asset = a.asset AND dq.d = a.d),
dx AS (SELECT *, 100 * abs(di_plus - di_minus) / nullif(di_plus + di_minus, 0) AS dx FROM di), {decay_sql("ax", "dx", "dx", "(1.0::DOUBLE / 14)", 14)},
adx AS (SELECT dx.asset, dx.d, di_plus, di_minus, ax.m AS adx FROM dx LEFT JOIN ax ON ax.asset = dx.asset AND ax.d = dx.d)"""
_panel_query("adx", {"adx": 5, "di_plus": 5, "di_minus": 5}, scans.recursive, ADX + ", out AS (SELECT * FROM adx)")
EWMA = "r2 AS (SELECT asset, d, returns * returns AS r2 FROM prices), " + decay_sql("ew", "r2", "r2", "(1 - 0.94::DOUBLE)") + ", ewma AS (SELECT p.asset, p.d, sqrt(ew.m * 365) * 100 AS ewma_vol FROM prices p LEFT JOIN ew ON ew.asset = p.asset AND ew.d = p.d)"
_panel_query("ewma_vol", {"ewma_vol": 4}, scans.recursive, EWMA + ", out AS (SELECT * FROM ewma)")

BUNDLE = ", ".join([BOLLINGER, STOCH, ADX, OBV.replace(LAGGED + ", ", ""), AROON, ROC, EMA, MACD, RSI, EWMA, "smas AS (SELECT asset, d, " + ", ".join(f"{full('avg(close)', n)} AS sma_{n}" for n in (20, 50, 200)) + " FROM prices)"])
WIDE = f"""{BUNDLE}, wide AS (SELECT p.asset, p.d, p.close, p.high, p.low, smas.* EXCLUDE (asset, d), bb_mid, bb_pct, stoch_k, adx, di_plus, di_minus, obv, obv_sma, volume_sma, aroon_osc, roc_10, roc_20, rsi, macd, macd_signal, ewma_vol, atr, atr / p.close * 100 AS atr_pct
 FROM prices p {" ".join(f"JOIN {t} USING (asset, d)" for t in ("smas", "bollinger", "stoch", "adx", "obv", "aroon", "roc", "rsi", "macd", "ewma", "atr"))})"""
_WIDE_COLUMNS = {"sma_20": 4, "sma_50": 4, "sma_200": 4, "bb_mid": 4, "bb_pct": 6, "stoch_k": 5, "adx": 5, "obv": 4, "volume_sma": 4, "aroon_osc": 4, "roc_20": 4, "rsi": 5, "macd": 4, "ewma_vol": 4, "atr": 4, "atr_pct": 5}
_panel_query("indicator_bundle", _WIDE_COLUMNS, scans.bundle, WIDE + ", out AS (SELECT * FROM wide)")


def _vote_sql(up: str, down: str, valid: str) -> str:
    return f"CASE WHEN {valid} THEN CASE WHEN {down} THEN -1 WHEN {up} THEN 1 ELSE 0 END END"


def _over_sql(a: str, b: str, known: str) -> str:
    return _vote_sql(f"{a} > {b}", f"{a} < {b}", f"{known} IS NOT NULL")


_RULES_SQL = {
    "rsi": _vote_sql("rsi < 30", "rsi > 70", "rsi IS NOT NULL"),
    "stochastic": _vote_sql("stoch_k < 20", "stoch_k > 80", "stoch_k IS NOT NULL"),
    "bollinger": _vote_sql("bb_pct < 0", "bb_pct > 1", "bb_pct IS NOT NULL"),
    "macd": _over_sql("macd", "macd_signal", "macd"),
    "roc": _vote_sql("roc_20 > 0", "roc_20 < 0", "roc_20 IS NOT NULL"),
    "sma_20": _over_sql("close", "sma_20", "sma_20"),
    "sma_50": _over_sql("close", "sma_50", "sma_50"),
    "sma_200": _over_sql("close", "sma_200", "sma_200"),
    "golden_cross": _over_sql("sma_50", "sma_200", "sma_200"),
    "adx": _vote_sql("adx >= 20 AND di_plus > di_minus", "adx >= 20 AND di_plus < di_minus", "adx IS NOT NULL"),
    "aroon": _vote_sql("aroon_osc > 50", "aroon_osc < -50", "aroon_osc IS NOT NULL"),
    "obv": _over_sql("obv", "obv_sma", "obv_sma"),
}
_GROUPS_SQL = {"oscillator": ("rsi", "stochastic", "bollinger", "macd", "roc"), "trend": ("sma_20", "sma_50", "sma_200", "golden_cross", "adx", "aroon", "obv")}
VOTES = f"{WIDE}, voted AS (SELECT *, {', '.join(f'{x} AS vote_{k}' for k, x in _RULES_SQL.items())} FROM wide)"
_NAMES = [f"vote_{k}" for k in signals.RULES]


def voted(panel: DataFrame) -> DataFrame:
    return signals.votes(scans.bundle(panel))


QUERIES["signal_votes"] = lambda spark, sf_dir: voted(fx.flag_prices(spark, sf_dir)).select(*KEYS, *_NAMES)
ORACLES["signal_votes"] = f"WITH RECURSIVE {fx.FLAG_PRICES}, {VOTES} SELECT asset, d, {', '.join(_NAMES)} FROM voted"
_COUNT = " + ".join(f"({n} IS NOT NULL)::INT" for n in _NAMES)
QUERIES["technical_score"] = lambda spark, sf_dir: rounded(signals.score(voted(fx.flag_prices(spark, sf_dir))).select(*KEYS, "votes", "score"))
ORACLES["technical_score"] = f"WITH RECURSIVE {fx.FLAG_PRICES}, {VOTES}, counted AS (SELECT asset, d, {_COUNT} AS votes, {' + '.join(f'coalesce({n}, 0)' for n in _NAMES)} AS total FROM voted) , told AS (SELECT asset, d, votes, CASE WHEN votes >= 5 THEN total::DOUBLE / votes END AS score FROM counted) SELECT asset, d, votes, {r('score')} FROM told"
QUERIES["technical_summary"] = lambda spark, sf_dir: rounded(signals.summary(voted(fx.flag_prices(spark, sf_dir))))
_LABEL = "CASE WHEN mean IS NULL THEN 'undefined' WHEN mean <= -0.5 THEN 'strong_bear' WHEN mean <= -0.1 THEN 'bear' WHEN mean < 0.1 THEN 'neutral' WHEN mean < 0.5 THEN 'bull' ELSE 'strong_bull' END"
ORACLES["technical_summary"] = f"""WITH RECURSIVE {fx.FLAG_PRICES}, {VOTES}, fin AS (SELECT * FROM voted QUALIFY d = max(d) OVER (PARTITION BY asset)),
lng AS ({" UNION ALL ".join(f"SELECT asset, d, '{g}' AS grp, vote_{k} AS vote FROM fin" for g, ks in _GROUPS_SQL.items() for k in ks)}), grown AS (SELECT * FROM lng UNION ALL SELECT asset, d, 'all', vote FROM lng),
agg AS (SELECT asset, d, grp, count(vote) AS votes, count(CASE WHEN vote > 0 THEN 1 END) AS ups, count(CASE WHEN vote < 0 THEN 1 END) AS downs, avg(vote) AS mean FROM grown GROUP BY 1, 2, 3)
SELECT asset, d, grp, votes, ups, downs, {r("mean")}, {_LABEL} AS label FROM agg"""

QUERIES["vote_readings"] = lambda spark, sf_dir: rounded(signals.readings(voted(fx.flag_prices(spark, sf_dir))).select(*KEYS, "rule", "grp", "value", "vote", "reading"), 4)
# rule: (value, words for up, for down, for neither)
_READINGS = {
    "rsi": ("rsi", "oversold, below 30", "overbought, above 70", "between 30 and 70"),
    "stochastic": ("stoch_k", "oversold, below 20", "overbought, above 80", "between 20 and 80"),
    "bollinger": ("bb_pct", "below the lower band", "above the upper band", "within the bands"),
    "macd": ("macd - macd_signal", "above its signal", "below its signal", "at its signal"),
    "roc": ("roc_20", "higher than 20 days ago", "lower than 20 days ago", "as 20 days ago"),
    "sma_20": ("(close / sma_20 - 1) * 100", "above the average of 20 days", "below the average of 20 days", "at the average of 20 days"),
    "sma_50": ("(close / sma_50 - 1) * 100", "above the average of 50 days", "below the average of 50 days", "at the average of 50 days"),
    "sma_200": ("(close / sma_200 - 1) * 100", "above the average of 200 days", "below the average of 200 days", "at the average of 200 days"),
    "golden_cross": ("NULL", "the 50-day average is above the 200-day one", "the 50-day average is below the 200-day one", "both averages are equal"),
    "adx": ("adx", "a strong rise", "a strong fall", "no clear trend, below 20"),
    "aroon": ("aroon_osc", "recent highs prevail", "recent lows prevail", "no clear direction"),
    "obv": ("NULL", "volume confirms buyers", "volume confirms sellers", "volume confirms neither"),
}
_GROUP_OF = {k: g for g, ks in _GROUPS_SQL.items() for k in ks}
_EACH_READING = " UNION ALL ".join(f"SELECT asset, d, '{k}' AS rule, '{_GROUP_OF[k]}' AS grp, CAST({v} AS DOUBLE) AS value, vote_{k} AS vote, CASE WHEN vote_{k} > 0 THEN '{a}' WHEN vote_{k} < 0 THEN '{b}' ELSE '{c}' END AS reading FROM fin" for k, (v, a, b, c) in _READINGS.items())
ORACLES["vote_readings"] = f"""WITH RECURSIVE {fx.FLAG_PRICES}, {VOTES},
fin AS (SELECT * FROM voted QUALIFY d = max(d) OVER (PARTITION BY asset)),
said AS ({_EACH_READING})
SELECT asset, d, rule, grp, {r('value', 4)}, vote, reading FROM said WHERE vote IS NOT NULL"""

_AROUND = "OVER (PARTITION BY asset ORDER BY d ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)"
PIVOTS = f"""piv AS (SELECT asset, d, high, low, count(close) {_AROUND} AS n, max(high) {_AROUND} AS mh, min(low) {_AROUND} AS ml FROM prices),
pivots AS (SELECT asset, d, high AS value, 'high' AS kind FROM piv WHERE n = 15 AND high = mh UNION ALL SELECT asset, d, low, 'low' FROM piv WHERE n = 15 AND low = ml)"""
QUERIES["pivots"] = lambda spark, sf_dir: rounded(signals.pivots(fx.flag_prices(spark, sf_dir)), 4)
ORACLES["pivots"] = f"WITH {fx.FLAG_PRICES}, {PIVOTS} SELECT asset, d, {r('value', 4)}, kind FROM pivots"
FIB = """ends AS (SELECT asset, max(high) AS top, min(low) AS bottom, first(d ORDER BY high DESC, d) AS top_day, first(d ORDER BY low, d) AS bottom_day FROM prices GROUP BY 1),
fib AS (SELECT asset, bottom_day < top_day AS uptrend, top, bottom, ratio, CASE WHEN bottom_day < top_day THEN top - (top - bottom) * ratio ELSE bottom + (top - bottom) * ratio END AS level FROM ends, (SELECT unnest([0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0]::DOUBLE[]) AS ratio))"""
QUERIES["fibonacci"] = lambda spark, sf_dir: rounded(signals.fibonacci(fx.flag_prices(spark, sf_dir)), 4)
ORACLES["fibonacci"] = f"WITH {fx.FLAG_PRICES}, {FIB} SELECT asset, uptrend, {r('top', 4)}, {r('bottom', 4)}, {r('ratio', 4)}, {r('level', 4)} FROM fib"


def support_resistance(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = fx.flag_prices(spark, sf_dir)
    found = signals.levels(signals.pivots(panel), signals.tolerance(scans.recursive(panel)))
    return rounded(signals.nearest_levels(found, panel), 4).select("asset", "side", "rank", "level", "touches", "last_touch", "distance_pct")


QUERIES["support_resistance"] = support_resistance
ORACLES["support_resistance"] = f"""WITH RECURSIVE {fx.FLAG_PRICES}, {ATR}, {PIVOTS},
tol AS (SELECT asset, coalesce(greatest(0.01, least(0.06, quantile_cont(atr / close, 0.5))), 0.02) AS tolerance FROM atr GROUP BY 1),
pv AS (SELECT asset, value, d, row_number() OVER (PARTITION BY asset ORDER BY value, d, kind) AS k FROM pivots),
cl AS (SELECT pv.asset, k, 1 AS c, value AS s, 1 AS n, d AS last_touch, tolerance FROM pv JOIN tol ON tol.asset = pv.asset WHERE k = 1
 UNION ALL SELECT p.asset, p.k, CASE WHEN p.value <= c.s / c.n * (1 + tolerance) THEN c.c ELSE c.c + 1 END, CASE WHEN p.value <= c.s / c.n * (1 + tolerance) THEN c.s + p.value ELSE p.value END,
 CASE WHEN p.value <= c.s / c.n * (1 + tolerance) THEN c.n + 1 ELSE 1 END, CASE WHEN p.value <= c.s / c.n * (1 + tolerance) THEN greatest(c.last_touch, p.d) ELSE p.d END, tolerance FROM cl c JOIN pv p ON p.asset = c.asset AND p.k = c.k + 1),
lv AS (SELECT asset, c, last(s / n ORDER BY k) AS level, CAST(max(n) AS BIGINT) AS touches, last(last_touch ORDER BY k) AS last_touch FROM cl GROUP BY 1, 2),
px AS (SELECT asset, last(close ORDER BY d) AS price FROM prices GROUP BY 1),
sd AS (SELECT lv.asset, CASE WHEN level < price THEN 'support' ELSE 'resistance' END AS side, level, touches, last_touch, (level / price - 1) * 100 AS distance_pct FROM lv JOIN px ON px.asset = lv.asset WHERE level <> price),
rk AS (SELECT *, row_number() OVER (PARTITION BY asset, side ORDER BY abs(distance_pct), level) AS rank FROM sd)
SELECT asset, side, CAST(rank AS INT) AS rank, {r('level', 4)}, touches, last_touch, {r('distance_pct', 4)} FROM rk WHERE rank <= 3"""
