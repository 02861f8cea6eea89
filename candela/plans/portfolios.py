"""Queries of portfolios and simulations."""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import functions as F

from candela.operators import portfolio as pf
from candela.operators import simulate as sim
from candela.plans import fixtures as fx
from candela.plans.market import r, rounded

QUERIES, ORACLES = {}, {}


def add(name: str, build, sql: str | None = None, digits: int = 6, **special: int) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(build(fx.flag_prices(spark, sf_dir)), digits, **special)
    if sql:
        ORACLES[name] = f"WITH {fx.FLAG_PRICES}, {sql}"


def told(columns: dict[str, int], source: str, *keys: str) -> str:
    return f"SELECT {', '.join([*keys, *(r(c, n) for c, n in columns.items())])} FROM {source}"


_BY = "OVER (PARTITION BY asset ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
JOINT = """shr AS (SELECT asset, d, close FROM prices WHERE d IN (SELECT d FROM prices GROUP BY d HAVING count(close) = (SELECT count(DISTINCT asset) FROM prices))),
jr AS (SELECT asset, d, r FROM (SELECT asset, d, close / lag(close) OVER (PARTITION BY asset ORDER BY d) - 1 AS r FROM shr) WHERE r IS NOT NULL)"""
add("asset_stats", partial(pf.asset_stats, rate=0.04), f"""{JOINT}, lg AS (SELECT *, sum(ln(1 + r)) {_BY} AS l FROM jr), fl AS (SELECT *, exp(l - max(l) {_BY}) - 1 AS fall FROM lg),
o AS (SELECT asset, sum(ln(1 + r)) * 365 / count(*) AS log_cagr, stddev_samp(r) * sqrt(365) AS volatility, (avg(r) - 0.04 / 365) * sqrt(365) / stddev_samp(r) AS sharpe, min(fall) AS max_drawdown, sum(ln(1 + r)) AS ln_total FROM fl GROUP BY 1) """ + told({"log_cagr": 6, "volatility": 6, "sharpe": 6, "max_drawdown": 6, "ln_total": 6}, "o", "asset"))
CORR = JOINT + ", cor AS (SELECT a.asset AS i, b.asset AS j, corr(a.r, b.r) AS corr FROM jr a JOIN jr b ON a.d = b.d GROUP BY 1, 2)"
add("corr_matrix", pf.correlations, CORR + " " + told({"corr": 6}, "cor", "i", "j"))
add("mean_correlation", lambda p: pf.mean_correlation(pf.correlations(p)), CORR + ", o AS (SELECT avg(corr) AS mean_corr FROM cor WHERE i <> j) " + told({"mean_corr": 6}, "o"))
COV = f"""{JOINT}, cm AS (SELECT asset, avg(r) AS m, count(*) AS n FROM jr GROUP BY 1), ce AS (SELECT jr.asset, d, r - m AS r FROM jr JOIN cm ON cm.asset = jr.asset),
sm AS (SELECT a.asset AS i, b.asset AS j, sum(a.r * b.r) / count(*) AS s, sum(a.r * a.r * b.r * b.r) AS q, count(*) AS n FROM ce a JOIN ce b ON a.d = b.d GROUP BY 1, 2),
kk AS (SELECT sqrt(count(*)) AS k, sum(CASE WHEN i = j THEN s END) / sqrt(count(*)) AS mu, sum(q) / any_value(n) AS qq, sum(s * s) AS ss FROM sm),
de AS (SELECT sum(pow(s - CASE WHEN i = j THEN mu ELSE 0 END, 2)) / any_value(k) AS delta, (any_value(qq) - any_value(ss)) / (any_value(k) * any_value(n)) AS beta, any_value(k) AS k, any_value(mu) AS mu FROM sm, kk),
cov AS (SELECT i, j, 365 * CASE WHEN n > k + 2 THEN (1 - coalesce(greatest(0, least(beta, delta)) / nullif(delta, 0), 0)) * s + coalesce(greatest(0, least(beta, delta)) / nullif(delta, 0), 0) * CASE WHEN i = j THEN mu ELSE 0 END ELSE s * n / (n - 1) END AS cov FROM sm, de)"""
add("cov_ledoit_wolf", pf.covariances, COV + " " + told({"cov": 6}, "cov", "i", "j"))
POINT = COV + """, mu AS (SELECT asset, avg(ln(1 + r)) * 365 AS mu FROM jr GROUP BY 1), wt AS (SELECT 'equal' AS basket, asset, 1.0::DOUBLE / (SELECT count(*) FROM mu) AS w FROM mu)"""
add("optimize_equal", pf.equal_weights, POINT + " " + told({"w": 6}, "wt", "basket", "asset"))
add("portfolio_point", lambda p: pf.point(pf.equal_weights(p), pf.covariances(p), pf.log_growth(p), 0.04).select("basket", "volatility", "sharpe", "expected_return"), POINT + """, o AS (SELECT a.basket, sqrt(sum(a.w * b.w * cov)) AS volatility, exp(any_value(g)) - 1 AS expected_return, (exp(any_value(g)) - 1 - 0.04) / sqrt(sum(a.w * b.w * cov)) AS sharpe
 FROM wt a JOIN cov ON cov.i = a.asset JOIN wt b ON b.asset = cov.j, (SELECT sum(w * mu) AS g FROM wt JOIN mu ON mu.asset = wt.asset) GROUP BY 1) """ + told({"volatility": 6, "sharpe": 6, "expected_return": 6}, "o", "basket"))
add("risk_contrib", lambda p: pf.contributions(pf.equal_weights(p), pf.covariances(p)), POINT + """, own AS (SELECT a.basket, a.asset, sum(a.w * b.w * cov) AS part FROM wt a JOIN cov ON cov.i = a.asset JOIN wt b ON b.asset = cov.j GROUP BY 1, 2),
o AS (SELECT basket, asset, part / sum(part) OVER (PARTITION BY basket) * 100 AS share_pct FROM own) """ + told({"share_pct": 6}, "o", "basket", "asset"))
for _period in ("none", "month", "quarter"):
    _unit = "year" if _period == "none" else _period
    _flag = "0" if _period == "none" else f"CASE WHEN date_trunc('{_unit}', d) <> date_trunc('{_unit}', lag(d) OVER (ORDER BY d)) THEN 1 ELSE 0 END"
    _curve = f"""{POINT}, dy AS (SELECT d, coalesce({_flag}, 0) AS flag FROM (SELECT DISTINCT d FROM shr)), sg AS (SELECT d, flag, sum(flag) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM dy),
hd AS (SELECT basket, shr.asset, shr.d, flag, s, w, close, first_value(close) OVER (PARTITION BY shr.asset, s ORDER BY shr.d) AS p0 FROM shr JOIN wt ON wt.asset = shr.asset JOIN sg ON sg.d = shr.d),
ho AS (SELECT *, w * close / p0 AS x, w * close / lag(p0) OVER (PARTITION BY asset ORDER BY d) AS old FROM hd), gs AS (SELECT d, sum(old) AS g FROM ho GROUP BY 1),
gr AS (SELECT basket, ho.d, flag, sum(x) AS growth, any_value(g) AS g, sum(abs(w - old / g)) AS traded FROM ho JOIN gs ON gs.d = ho.d GROUP BY 1, 2, 3),
va AS (SELECT basket, d, flag, CASE WHEN flag = 1 THEN traded END AS traded, ln(0.998::DOUBLE) + coalesce(sum(CASE WHEN flag = 1 THEN ln(g * (1 - 0.002::DOUBLE * traded)) END) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) + ln(growth) AS ln_value FROM gr)"""
    add(f"portfolio_bt_{_period}", lambda p, period=_period: pf.rebalanced(p, pf.equal_weights(p), period).select("basket", "d", "flag", "traded", F.log("value").alias("ln_value")), _curve + " " + told({"traded": 6, "ln_value": 6}, "va", "basket", "d", "CAST(flag AS INT) AS flag"))
add("turnover_cost", lambda p: pf.turnover_cost(pf.rebalanced(p, pf.equal_weights(p), "quarter")), _curve + ", o AS (SELECT basket, 0.002::DOUBLE + coalesce(sum(CASE WHEN flag = 1 THEN exp(ln_value) / (1 - 0.002::DOUBLE * traded) * 0.002::DOUBLE * traded END), 0) AS cost FROM va GROUP BY 1) " + told({"cost": 5}, "o", "basket"), 5)
# the curve of the quarters, whose segments drift the longest
add("portfolio_weights_by_day", lambda p: pf.effective_weights(p, pf.equal_weights(p), "quarter"), _curve + ", o AS (SELECT basket, asset, d, x / sum(x) OVER (PARTITION BY basket, d) AS weight FROM ho) " + told({"weight": 6}, "o", "basket", "asset", "d"))
_RECORD = {"log_total": 6, "log_annual": 6, "volatility": 4, "sharpe": 6, "sortino": 6, "max_drawdown": 6, "log_costs": 5}
add(
    "portfolio_record",
    lambda p: pf.record(pf.rebalanced(p, pf.equal_weights(p), "quarter"), 0.04).select("basket", F.log1p(F.col("total_return") / 100).alias("log_total"), F.log1p(F.col("annual_return") / 100).alias("log_annual"), "volatility", "sharpe", "sortino", "max_drawdown", F.log("total_costs").alias("log_costs")),
    _curve
    + """, lr AS (SELECT *, exp(ln_value - lag(ln_value) OVER w) - 1 AS r, exp(ln_value - max(ln_value) OVER (PARTITION BY basket ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - 1 AS fall FROM va WINDOW w AS (PARTITION BY basket ORDER BY d)),
o AS (SELECT basket, last(ln_value ORDER BY d) AS log_total, (last(ln_value ORDER BY d) - first(ln_value ORDER BY d)) * 365 / count(r) AS log_annual, stddev_samp(r) * sqrt(365) * 100 AS volatility,
 (avg(r) - 0.04 / 365) * sqrt(365) / stddev_samp(r) AS sharpe, avg(r - 0.04 / 365) * sqrt(365) / sqrt(avg(CASE WHEN r IS NOT NULL THEN pow(least(r - 0.04 / 365, 0), 2) END)) AS sortino, min(fall) * 100 AS max_drawdown,
 ln(0.002::DOUBLE + sum(CASE WHEN flag = 1 THEN exp(ln_value) / (1 - 0.002::DOUBLE * traded) * 0.002::DOUBLE * traded END)) AS log_costs FROM lr GROUP BY 1) """
    + told(_RECORD, "o", "basket"),
    **{k: n for k, n in _RECORD.items() if n != 6},
)
for _method in ("min_variance", "max_sharpe", "risk_parity"):
    add(f"optimize_{_method}", lambda p, method=_method: pf.optimised(p, method, 0.6, 0.04))
_UNIFORM = "(('0x' || substr(md5('7{}:' || basket || ':' || asset || ':' || t), 1, 12))::BIGINT::DOUBLE + 1) / 281474976710657.0::DOUBLE"
_E = repr(1 + 0.7 / math.e)
add(
    "random_portfolios",
    lambda p: pf.point(pf.random_baskets(p, 3000), pf.covariances(p), pf.log_growth(p), 0.04).select("basket", "volatility", "expected_return", "sharpe"),
    f"""{POINT},
tr AS (SELECT asset, basket, t, {_UNIFORM.format('a')} * {_E}::DOUBLE AS p, {_UNIFORM.format('b')} AS v FROM mu, range(3000) b(basket), range(64) s(t)),
tx AS (SELECT *, CASE WHEN p <= 1 THEN pow(p, 1 / 0.7::DOUBLE) ELSE -ln(({_E}::DOUBLE - p) / 0.7::DOUBLE) END AS x FROM tr),
ga AS (SELECT basket, asset, min_by(x, t) AS g FROM tx WHERE v <= CASE WHEN p <= 1 THEN exp(-x) ELSE pow(x, 0.7::DOUBLE - 1) END GROUP BY 1, 2),
bw AS (SELECT basket, asset, g / sum(g) OVER (PARTITION BY basket) AS w FROM ga),
gr AS (SELECT basket, exp(sum(w * mu)) - 1 AS expected_return FROM bw JOIN mu ON mu.asset = bw.asset GROUP BY 1),
vo AS (SELECT a.basket, sqrt(sum(a.w * b.w * cov)) AS volatility FROM bw a JOIN cov ON cov.i = a.asset JOIN bw b ON b.asset = cov.j AND b.basket = a.basket GROUP BY 1),
o AS (SELECT CAST(vo.basket AS VARCHAR) AS basket, volatility, expected_return, (expected_return - 0.04) / volatility AS sharpe FROM vo JOIN gr ON gr.basket = vo.basket)
"""
    + told({"volatility": 5, "expected_return": 5, "sharpe": 5}, "o", "basket"),
    5,
)
add(
    "optimize_manual",
    lambda p: pf.manual_weights(p, {"A": 3, "N": 1, "R": -2}),
    "o AS (SELECT 'manual' AS basket, asset, CASE asset WHEN 'A' THEN 0.75 WHEN 'N' THEN 0.25 ELSE 0.0 END::DOUBLE AS w FROM (SELECT DISTINCT asset FROM prices)) " + told({"w": 6}, "o", "basket", "asset"),
)

_HASH = "('0x' || substr(md5('7:' || sim || ':' || ((day - 1) // b)), 1, 8))::BIGINT"
BOOT = f"""lr AS (SELECT asset, row_number() OVER (PARTITION BY asset ORDER BY d) - 1 AS pos, log_returns - avg(log_returns) OVER (PARTITION BY asset) AS x, count(*) OVER (PARTITION BY asset) AS n FROM prices WHERE log_returns IS NOT NULL),
sz AS (SELECT asset, max(n) AS n, greatest(1, least(5, max(n) // 4)) AS b FROM lr GROUP BY 1), gd AS (SELECT asset, n, b, sim, day FROM sz, range(5000) t(sim), range(1, 61) u(day)),
pt AS (SELECT asset, sim, day, ({_HASH} % n + (day - 1) % b) % n AS pos FROM gd),
paths AS (SELECT pt.asset, sim, day, sum(x) OVER (PARTITION BY pt.asset, sim ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ln FROM pt JOIN lr ON lr.asset = pt.asset AND lr.pos = pt.pos)"""
_PS = {5: 0.05, 25: 0.25, 50: 0.5, 75: 0.75, 95: 0.95}
_KEPT = "(0.999::DOUBLE * 0.999::DOUBLE)"
_V = f"1000 * ({_KEPT} * {_KEPT}) * exp(ln)"
add(
    "monte_carlo_bootstrap",
    lambda p: sim.fan(sim.bootstrap_paths(p)).select("asset", "day", *(F.log(f"p{q}").alias(f"p{q}") for q in _PS)),
    f"""{BOOT},
ev AS (
  SELECT asset, day, {_V} AS v FROM paths
  UNION ALL SELECT asset, 0, {_V.replace('exp(ln)', '1')} FROM paths WHERE day = 1
),
o AS (SELECT asset, CAST(day AS INT) AS day, {', '.join(f'ln(quantile_cont(v, {p})) AS p{q}' for q, p in _PS.items())} FROM ev GROUP BY 1, 2)
"""
    + told({f"p{q}": 6 for q in _PS}, "o", "asset", "day"),
)
_OUTCOME = {"mean": 5, "median": 4, "p5": 4, "p95": 4, "p_loss": 5, "p_double": 5, "var_95": 4, "cvar_95": 4}
add(
    "monte_carlo_outcome",
    lambda p: sim.outcome(sim.bootstrap_paths(p)).select("asset", F.log("mean").alias("mean"), "median", "p5", F.log("p95").alias("p95"), "p_loss", "p_double", "var_95", "cvar_95"),
    f"""{BOOT},
la AS (SELECT asset, {_V} AS v FROM paths WHERE day = 60),
st AS (
  SELECT asset, avg(v) AS mean, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.05) AS p5, quantile_cont(v, 0.95) AS p95,
    avg((v < 1000)::INT) AS p_loss, avg((v >= 2000)::INT) AS p_double
  FROM la GROUP BY 1
),
tl AS (SELECT la.asset, avg(v) AS tail FROM la JOIN st ON st.asset = la.asset WHERE v <= p5 GROUP BY 1),
o AS (
  SELECT st.asset, ln(mean) AS mean, median, p5, ln(p95) AS p95, p_loss, p_double, greatest(0, 1000 - p5) AS var_95, greatest(0, 1000 - tail) AS cvar_95
  FROM st JOIN tl ON tl.asset = st.asset
)
"""
    + told(_OUTCOME, "o", "asset"),
    5,
    **{c: n for c, n in _OUTCOME.items() if n != 5},
)
_SIDES = {"from": 4, "to": 4, "density": 6, "normal": 6}
add(
    "outcome_histogram",
    lambda p: sim.outcome_histogram(sim.bootstrap_paths(p)).select("asset", "side", "bin", "n", F.log("from").alias("from"), F.log("to").alias("to"), (F.col("density") * F.col("to")).alias("density"), (F.col("normal") * F.col("to")).alias("normal")),
    f"""{BOOT},
la AS (SELECT asset, {_V} AS v FROM paths WHERE day = 60),
tl AS (SELECT asset, quantile_cont(v, 0.005) AS a, quantile_cont(v, 0.995) AS b, min(v) AS least, max(v) AS most, avg(v) AS mu, stddev_samp(v) AS sd, count(*) AS total FROM la GROUP BY 1),
sd AS (SELECT la.asset, v, mu, sd, total, CASE WHEN v < a THEN 'below' WHEN v > b THEN 'above' WHEN v < 1000 THEN 'loss' ELSE 'gain' END AS side, a, b, least, most FROM la JOIN tl ON tl.asset = la.asset),
st AS (SELECT *, CASE side WHEN 'below' THEN least WHEN 'above' THEN b WHEN 'gain' THEN greatest(a, 1000) ELSE a END AS start, CASE side WHEN 'below' THEN a WHEN 'above' THEN most WHEN 'loss' THEN least(b, 1000) ELSE b END AS stop, CASE WHEN side IN ('below', 'above') THEN 1 ELSE 40 END AS parts FROM sd),
bn AS (SELECT *, (stop - start) / parts AS width, CAST(coalesce(least(floor((v - start) / nullif((stop - start) / parts, 0)), parts - 1), 0) AS INT) AS bin FROM st),
gr AS (SELECT asset, side, bin, count(*) AS n, any_value(start + bin * width) AS low, any_value(width) AS width, any_value(mu) AS mu, any_value(sd) AS sd, any_value(total) AS total FROM bn GROUP BY 1, 2, 3),
o AS (SELECT asset, side, bin, n, ln(low) AS "from", ln(low + width) AS "to", n / (total * width) * (low + width) AS density, exp(-0.5::DOUBLE * pow((low + width / 2 - mu) / sd, 2)) / (sd * sqrt(2 * pi())) * (low + width) AS normal FROM gr)
"""
    + told(_SIDES, "o", "asset", "side", "bin", "n").replace("from +", '"from" +').replace("to +", '"to" +').replace("AS from", 'AS "from"').replace("AS to", 'AS "to"'),
    **{k: n for k, n in _SIDES.items() if n != 6},
)
add(
    "monte_carlo_samples",
    lambda p: sim.samples(sim.bootstrap_paths(p)).select("asset", "sim", "day", F.log("value").alias("ln_value")),
    f"""{BOOT},
o AS (
  SELECT asset, sim, CAST(day AS INT) AS day, ln(1000 * ({_KEPT} * {_KEPT})) + ln AS ln_value FROM paths WHERE sim < 30
  UNION ALL SELECT asset, sim, 0, ln(1000 * ({_KEPT} * {_KEPT})) FROM paths WHERE sim < 30 AND day = 1
)
"""
    + told({"ln_value": 6}, "o", "asset", "sim", "day"),
)
add(
    "monte_carlo_assumptions",
    lambda p: sim.assumptions(p, "historical"),
    """o AS (
  SELECT asset, avg(log_returns) * 365 * 100 AS annual_drift, stddev_samp(log_returns) * sqrt(365) * 100 AS annual_volatility
  FROM prices WHERE log_returns IS NOT NULL GROUP BY 1 HAVING count(*) >= 30
)
"""
    + told({"annual_drift": 4, "annual_volatility": 4}, "o", "asset"),
    4,
)
_DRAW = "(('0x' || substr(md5('{}:' || sim || ':' || day || ':' || asset), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE"
add(
    "monte_carlo_gbm",
    lambda p: sim.fan(sim.gbm_paths(p)).select("asset", "day", *(F.log(f"p{q}").alias(f"p{q}") for q in _PS)),
    f"""sd AS (SELECT asset, stddev_samp(log_returns) AS sd FROM prices WHERE log_returns IS NOT NULL GROUP BY 1 HAVING count(*) >= 30),
gd AS (SELECT asset, sd, sim, day FROM sd, range(5000) t(sim), range(1, 61) u(day)),
zs AS (SELECT asset, sim, day, sd * sqrt(-2 * ln({_DRAW.format(8)})) * cos(2 * pi() * {_DRAW.format(9)}) AS x FROM gd),
paths AS (SELECT asset, sim, day, sum(x) OVER (PARTITION BY asset, sim ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ln FROM zs),
ev AS (
  SELECT asset, day, {_V} AS v FROM paths
  UNION ALL SELECT asset, 0, {_V.replace('exp(ln)', '1')} FROM paths WHERE day = 1
),
o AS (SELECT asset, CAST(day AS INT) AS day, {', '.join(f'ln(quantile_cont(v, {p})) AS p{q}' for q, p in _PS.items())} FROM ev GROUP BY 1, 2)
"""
    + told({f"p{q}": 6 for q in _PS}, "o", "asset", "day"),
)
DCA = f"""nu AS (
  SELECT asset, d, close, row_number() OVER (PARTITION BY asset ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY asset) AS n FROM prices
),
by0 AS (SELECT *, 1000.0::DOUBLE / count(*) OVER (PARTITION BY asset) AS amount FROM nu WHERE n >= 14 AND i % 7 = 0),
buys AS (SELECT asset, d, close, amount, amount * {_KEPT} / close AS units FROM by0)"""
add("dca_purchases", lambda p: sim.purchases(p).select("asset", "d", "amount", "units"), DCA + " " + told({"amount": 6, "units": 6}, "buys", "asset", "d"))
_LUMP = f""",
va AS (
  SELECT p.asset, p.d, p.close, first_value(p.close) OVER w AS first_price, 1000 * {_KEPT} * p.close / first_value(p.close) OVER w AS lump,
    coalesce(sum(units) OVER w, 0) AS units, coalesce(sum(amount) OVER w, 0) AS invested, count(amount) OVER w AS buys
  FROM prices p LEFT JOIN buys b ON b.asset = p.asset AND b.d = p.d
  WINDOW w AS (PARTITION BY p.asset ORDER BY p.d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
vb AS (SELECT *, units * close + 1000 - invested AS regular FROM va)"""
add(
    "dca_curve",
    lambda p: sim.lump_and_regular(p).select("asset", "d", F.log("lump").alias("ln_lump"), F.log("regular").alias("ln_regular"), "invested"),
    f"{DCA}{_LUMP}, o AS (SELECT asset, d, ln(lump) AS ln_lump, ln(regular) AS ln_regular, invested FROM vb) " + told({"ln_lump": 6, "ln_regular": 6, "invested": 4}, "o", "asset", "d"),
    6,
    invested=4,
)
_COMPARED = {"lump_final": 5, "regular_final": 5, "lump_return": 5, "regular_return": 5, "lump_price": 4, "regular_price": 4, "lump_drawdown": 6, "regular_drawdown": 6}
add(
    "dca_vs_lump",
    sim.comparison,
    f"""{DCA}{_LUMP},
fv AS (SELECT *, lump / max(lump) {_BY} - 1 AS lf, regular / max(regular) {_BY} - 1 AS rf FROM vb),
en AS (
  SELECT asset, last(lump ORDER BY d) * {_KEPT} AS lump_final, last(regular - units * close * (1 - {_KEPT}) ORDER BY d) AS regular_final, last(first_price ORDER BY d) AS lump_price,
    1000 * {_KEPT} / last(units ORDER BY d) AS regular_price, last(buys ORDER BY d) AS regular_buys, min(lf) AS lump_drawdown, min(rf) AS regular_drawdown
  FROM fv GROUP BY 1
),
o AS (SELECT *, (lump_final / 1000 - 1) * 100 AS lump_return, (regular_final / 1000 - 1) * 100 AS regular_return FROM en)
"""
    + told(_COMPARED, "o", "asset", "regular_buys"),
    6,
    **{c: n for c, n in _COMPARED.items() if n != 6},
)
