"""Queries of forecasts and their validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.operators import forecast as fc
from candela.operators import simulate as sim
from candela.plans import fixtures as fx
from candela.plans.market import r, rounded

QUERIES, ORACLES = {}, {}
HORIZON, FOLDS = 30, 6
_PATHS = ("mean", "lo95", "lo80", "hi80", "hi95")


def add(name: str, build, sql: str | None = None, digits: int = 6) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(build(fx.flag_prices(spark, sf_dir)), digits)
    if sql:
        ORACLES[name] = f"WITH {fx.FLAG_PRICES}, {sql}"


def _final(panel, model: str):
    rows = fc.series(panel)
    return fc.closed_forms(fc.moments(rows, fc.ends(rows)), HORIZON).where(F.col("model") == model).drop("origin")


SERIES = """ser AS (SELECT asset, CAST(row_number() OVER (PARTITION BY asset ORDER BY d) - 1 AS INT) AS i, ln(close) AS y, CAST(count(*) OVER (PARTITION BY asset) AS INT) AS n FROM prices WHERE close > 0),
chg AS (SELECT *, y - lag(y) OVER (PARTITION BY asset ORDER BY i) AS x FROM ser)"""


def _known(at: str) -> str:
    return f"""{SERIES}, ats AS ({at}), kn AS (SELECT chg.asset, origin, max_by(y, i) AS last, count(x) AS t, avg(x) AS mu, stddev_samp(x) AS sd FROM chg JOIN ats ON ats.asset = chg.asset WHERE i < origin GROUP BY 1, 2),
stp AS (SELECT * FROM kn, (SELECT CAST(unnest(range(1, {HORIZON + 1})) AS INT) AS step)),
cf AS (SELECT asset, origin, 'naive' AS model, step, last AS mean, sd * sqrt(step) AS se FROM stp UNION ALL SELECT asset, origin, 'drift', step, last + mu * step, sd * sqrt(step * (1 + step / t)) FROM stp),
pth AS (SELECT asset, origin, model, step, mean, mean - 1.9599639845400536::DOUBLE * se AS lo95, mean - 1.2815515655446008::DOUBLE * se AS lo80, mean + 1.2815515655446008::DOUBLE * se AS hi80, mean + 1.9599639845400536::DOUBLE * se AS hi95 FROM cf)"""


_LAST = _known("SELECT asset, max(n) AS origin FROM ser GROUP BY 1")
for _model in ("naive", "drift"):
    add(f"fc_{_model}", lambda p, model=_model: _final(p, model), f"{_LAST} SELECT asset, model, step, {', '.join(map(r, _PATHS))} FROM pth WHERE model = '{_model}'")
_FOLDS = f"SELECT asset, n - {HORIZON} - k * {max(HORIZON // 2, 5)} AS origin FROM (SELECT asset, max(n) AS n FROM ser GROUP BY 1), (SELECT CAST(unnest(range({FOLDS})) AS INT) AS k) WHERE n - {HORIZON} - k * {max(HORIZON // 2, 5)} >= {fc.min_train(HORIZON)}"
_NAMES = ("mape", "mape_final", "rmse", "mae", "direction", "coverage95")
WALK = f"""{_known(_FOLDS)}, allp AS (SELECT * FROM pth UNION ALL SELECT asset, origin, 'ensemble', step, {', '.join(f'avg({p})' for p in _PATHS)} FROM pth GROUP BY 1, 2, 4 HAVING count(*) > 1),
ech AS (SELECT a.*, exp(s.y) AS price, exp(b.y) AS base, exp(mean) AS guess FROM allp a JOIN ser s ON s.asset = a.asset AND s.i = origin + step - 1 JOIN ser b ON b.asset = a.asset AND b.i = origin - 1),
fo AS (SELECT asset, origin, model, avg(abs(guess / price - 1) * 100) AS mape, max_by(abs(guess / price - 1) * 100, step) AS mape_final, sqrt(avg(pow(guess - price, 2))) AS rmse, avg(abs(guess - price)) AS mae,
 max_by(guess / base - 1, step) AS told, max_by(price / base - 1, step) AS went, avg((ln(price) BETWEEN lo95 AND hi95)::INT) AS coverage95 FROM ech GROUP BY 1, 2, 3),
fm AS (SELECT *, CASE WHEN abs(told) > 1e-9 THEN (sign(told) = sign(went))::INT::DOUBLE END AS direction FROM fo)"""
add("walk_forward_folds", lambda p: fc.walk_forward(p, HORIZON, FOLDS), f"{WALK} SELECT asset, origin, model, {', '.join(r(c, 5) for c in _NAMES)} FROM fm", 5)
add(
    "walk_forward_metrics",
    lambda p: fc.ranked(fc.model_metrics(fc.walk_forward(p, HORIZON, FOLDS))).drop("place"),
    f"""{WALK}, o AS (SELECT f.asset, f.model, {', '.join(f'avg(f.{c}) AS {c}' for c in _NAMES)}, count(*) AS windows, 100 * (1 - avg(f.mape) / avg(b.mape)) AS skill FROM fm f JOIN fm b ON b.asset = f.asset AND b.origin = f.origin AND b.model = 'naive' GROUP BY 1, 2)
 SELECT asset, model, windows, {', '.join(r(c, 5) for c in (*_NAMES, 'skill'))} FROM o""",
    5,
)
_SCENES = "({}) AS sc(scenario, price)".format("VALUES " + ", ".join(f"('{s}', {s})" for s in sim.SCENARIOS))
_KEPT = "(0.999::DOUBLE * 0.999::DOUBLE)"
add(
    "forecast_scenarios",
    lambda p: sim.scenarios(fc.forecasts(p, HORIZON, ())).select("asset", "model", "scenario", F.log("price").alias("ln_price"), F.log("value").alias("ln_value")),
    f"""{_LAST}, ens AS (SELECT asset, model, step, mean, lo95, lo80, hi80, hi95 FROM pth UNION ALL SELECT asset, 'ensemble', step, avg(mean), avg(lo95), avg(lo80), avg(hi80), avg(hi95) FROM pth GROUP BY 1, 3),
fin AS (SELECT e.asset, model, last, mean, lo95, lo80, hi80, hi95 FROM ens e JOIN kn ON kn.asset = e.asset WHERE step = {HORIZON}),
sc AS ({' UNION ALL '.join(f"SELECT asset, model, '{s}' AS scenario, {s} AS lp, last FROM fin" for s in sim.SCENARIOS)}), o AS (SELECT asset, model, scenario, lp AS ln_price, ln(1000.0 * ({_KEPT} * {_KEPT})) + lp - last AS ln_value FROM sc)
 SELECT asset, model, scenario, {r('ln_price')}, {r('ln_value')} FROM o""",
)
# of the closed forms alone, which SQL can say
_Z95 = "1.9599639845400536::DOUBLE"
add(
    "forecast_report_closed",
    lambda p: fc.report(p, HORIZON, FOLDS, ()).select("asset", "best", "skill", "windows", F.log("last_price").alias("ln_last"), F.log("expected_price").alias("ln_expected"), F.log("lo95").alias("ln_lo95"), F.log("hi95").alias("ln_hi95"), "beat_naive", "few_windows"),
    f"""{WALK},
mm AS (
  SELECT f.asset, f.model, count(*) AS windows, 100 * (1 - avg(f.mape) / avg(b.mape)) AS skill
  FROM fm f JOIN fm b ON b.asset = f.asset AND b.origin = f.origin AND b.model = 'naive' GROUP BY 1, 2
),
pl AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY round(skill, 6) DESC NULLS LAST, model <> 'naive', model) AS place, max(windows) OVER (PARTITION BY asset) AS total FROM mm),
kl AS (
  SELECT chg.asset, max_by(y, i) AS last, count(x) AS t, avg(x) AS mu, stddev_samp(x) AS sd FROM chg WHERE n >= {fc.LEAST_ROWS + HORIZON} GROUP BY 1
),
one AS (
  SELECT asset, 'naive' AS model, last, last AS mid, {_Z95} * sd * sqrt({HORIZON}) AS wide FROM kl
  UNION ALL SELECT asset, 'drift', last, last + mu * {HORIZON}, {_Z95} * sd * sqrt({HORIZON} * (1 + {HORIZON} / t)) FROM kl
),
fl AS (
  SELECT asset, model, last, mid, mid - wide AS lo, mid + wide AS hi FROM one
  UNION ALL SELECT asset, 'ensemble', any_value(last), avg(mid), avg(mid - wide), avg(mid + wide) FROM one GROUP BY 1
),
ok AS (SELECT pl.*, last, mid, lo, hi, windows >= {fc.LEAST_WINDOWS} AND mid IS NOT NULL AS reliable FROM pl LEFT JOIN fl ON fl.asset = pl.asset AND fl.model = pl.model),
bt AS (
  SELECT asset, coalesce(min_by(model, place) FILTER (reliable), 'naive') AS best,
    coalesce(string_agg(model, ',' ORDER BY place) FILTER (reliable AND model <> 'naive' AND skill > 0), '') AS beat_naive,
    coalesce(string_agg(model, ',' ORDER BY model) FILTER (windows < total), '') AS few_windows
  FROM ok GROUP BY 1
),
o AS (
  SELECT bt.asset, best, skill, windows, last AS ln_last, mid AS ln_expected, lo AS ln_lo95, hi AS ln_hi95, beat_naive, few_windows
  FROM bt JOIN ok ON ok.asset = bt.asset AND ok.model = best
)
SELECT asset, best, windows, beat_naive, few_windows, {', '.join(r(c, 5) for c in ('skill', 'ln_last', 'ln_expected', 'ln_lo95', 'ln_hi95'))} FROM o""",
    5,
)
add("forecast_report", lambda p: fc.report(p, HORIZON, FOLDS, fc.ITERATIVE))
add("walk_forward_all", lambda p: fc.walk_forward(p, HORIZON, FOLDS, fc.ITERATIVE))
for _model in fc.ITERATIVE:
    add(f"fc_{_model}", lambda p, model=_model: fc.forecasts(p, HORIZON, (model,)).where(F.col("model") == model).select("asset", "model", "step", *_PATHS))
_LJUNG_TERMS = " + ".join(f"pow(s{k} / s, 2) / (n - {k})" for k in range(1, 11))
_LAGS = ", ".join(f"sum(e * e{k}) AS s{k}" for k in range(1, 11))
add(
    "ljung_box",
    fc.ljung_box,
    f"""ce AS (SELECT asset, d, log_returns - avg(log_returns) OVER (PARTITION BY asset) AS e FROM prices WHERE log_returns IS NOT NULL),
le AS (SELECT *, {', '.join(f'lag(e, {k}) OVER (PARTITION BY asset ORDER BY d) AS e{k}' for k in range(1, 11))} FROM ce),
sm AS (SELECT asset, count(*) AS n, sum(e * e) AS s, {_LAGS} FROM le GROUP BY 1), qs AS (SELECT asset, n, n * (n + 2) * ({_LJUNG_TERMS}) AS q FROM sm),
o AS (SELECT *, exp(-q / 2) * (1 + q / 2 + pow(q / 2, 2) / 2 + pow(q / 2, 3) / 6 + pow(q / 2, 4) / 24) AS p_value FROM qs) SELECT asset, n, {r('q', 5)}, {r('p_value', 5)} FROM o""",
    5,
)
add("unit_root", fc.unit_root)
