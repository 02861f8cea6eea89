"""Queries of ingestion, normalisation, joins and alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.operators import normalize
from candela.plans import fixtures as fx

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """All double columns rounded, some to other numbers of digits. What is added moves values off the ties that engines
    round differently; adding zero makes negative zeros positive."""
    return df.select(*((F.round(F.col(c) + F.lit(off_tie(special.get(c, digits))), special.get(c, digits)) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def off_tie(digits: int) -> float:
    return 0.137 * 10.0**-digits


def r(x: str, digits: int = 6) -> str:
    return f"round({x} + {off_tie(digits)!r}::DOUBLE, {digits}) + 0.0 AS {x.rsplit('.', 1)[-1]}"


_BARS = """SELECT event_type AS asset, date_trunc('{0}', ts) AS bucket, first(value ORDER BY ts) AS open, max(value) AS high, min(value) AS low,
 last(value ORDER BY ts) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2"""


@query("ohlcv_daily", f"SELECT asset, CAST(bucket AS DATE) AS bucket, open, high, low, close, volume FROM ({_BARS.format('day')})")
def ohlcv_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.bucketed(fx.event_ticks(spark, sf_dir), "day").withColumn("bucket", F.to_date("bucket"))


@query("ohlcv_hourly", _BARS.format("hour"))
def ohlcv_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.bucketed(fx.event_ticks(spark, sf_dir), "hour").withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("last_tick_of_day", "SELECT event_type AS asset, CAST(ts AS DATE) - CASE WHEN ts - date_trunc('day', ts) < INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS d, last(value ORDER BY ts) AS close FROM events GROUP BY 1, 2")
def last_tick_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = fx.event_ticks(spark, sf_dir).withColumnRenamed("value", "close").withColumn("ts", F.col("ts").cast("timestamp"))
    return normalize.daily_ticks(ticks, midnight_minutes=30)


@query("gapfill_daily", f"WITH {fx.normalised_sql(fx.PRIORITY_BARS)} SELECT asset, d, was_filled, {', '.join(r(c, 4) for c in ('open', 'high', 'low', 'close', 'volume'))} FROM prices")
def gapfill_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(normalize.prices(fx.priority_bars(spark, sf_dir)).select("asset", "d", "was_filled", "open", "high", "low", "close", "volume"), 4)


@query("calendar_missing_days", f"WITH raw AS ({fx.PRIORITY_BARS}), days AS (SELECT asset, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM raw GROUP BY asset) SELECT asset, d FROM days ANTI JOIN raw USING (asset, d)")
def calendar_missing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.missing_days(fx.priority_bars(spark, sf_dir))


@query("trim_long_gap", f"WITH {fx.normalised_sql(fx.BRAND_BARS)} SELECT asset, d, gap, trimmed, {r('close', 4)} FROM kept")
def trim_long_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(normalize.trimmed(normalize.observed(fx.brand_bars(spark, sf_dir))).select("asset", "d", "gap", "trimmed", "close"), 4)


_OUTLIERS = """lr AS (SELECT asset, d, log_returns FROM prices WHERE log_returns IS NOT NULL),
med AS (SELECT asset, quantile_cont(log_returns, 0.5) AS m, count(*) AS n FROM lr GROUP BY 1 HAVING count(*) > 30),
mad AS (SELECT lr.asset, quantile_cont(abs(log_returns - m), 0.5) AS mad FROM lr JOIN med ON lr.asset = med.asset GROUP BY 1),
flagged AS (SELECT lr.asset, d, log_returns, CASE WHEN mad = 0 THEN 0.25 ELSE greatest(0.25, 8 * 1.4826 * mad) END AS threshold FROM lr JOIN mad ON lr.asset = mad.asset
 WHERE abs(log_returns) > CASE WHEN mad = 0 THEN 0.25 ELSE greatest(0.25, 8 * 1.4826 * mad) END)"""


@query("outlier_flags", f"WITH {fx.normalised_sql(fx.BRAND_BARS)}, {_OUTLIERS} SELECT asset, d, {r('log_returns')}, {r('threshold')} FROM flagged")
def outlier_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(normalize.outliers(normalize.prices(fx.brand_bars(spark, sf_dir))))


@query(
    "data_quality",
    f"""WITH {fx.normalised_sql(fx.FLAWED_BARS)}, {_OUTLIERS}
SELECT p.asset, count(*) AS points, min(p.d) AS start, max(p.d) AS "end", count(CASE WHEN was_filled THEN 1 END) AS filled_days,
 (SELECT count(*) FROM raw WHERE raw.asset = p.asset AND (raw.close IS NULL OR raw.close <= 0)) AS dropped_rows,
 (SELECT max(gap) FROM seen s WHERE s.asset = p.asset) AS longest_gap, (SELECT first(trimmed) FROM trims t WHERE t.asset = p.asset) AS trimmed_start,
 (SELECT count(*) FROM flagged f WHERE f.asset = p.asset) AS outliers FROM prices p GROUP BY p.asset""",
)
def data_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.quality(fx.flawed_bars(spark, sf_dir))


@query("returns", f"WITH {fx.FLAG_PRICES} SELECT asset, d, {r('returns')}, {r('log_returns')} FROM prices")
def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fx.flag_prices(spark, sf_dir).select("asset", "d", "returns", "log_returns"))


@query(
    "fx_asof",
    f"""WITH bars AS ({fx.PRIORITY_BARS}), rates AS (SELECT d, close / 100000 AS rate FROM ({fx.STATUS_BARS}) WHERE asset = 'P'),
back AS (SELECT b.asset, b.d, b.close, r.rate FROM bars b ASOF LEFT JOIN rates r ON b.d >= r.d),
joined AS (SELECT asset, d, close, coalesce(rate, (SELECT first(rate ORDER BY d) FROM rates)) AS rate FROM back),
told AS (SELECT asset, d, rate, close * rate AS close FROM joined)
SELECT asset, d, {r('rate')}, {r('close', 4)} FROM told""",
)
def fx_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = fx.status_bars(spark, sf_dir).where("asset = 'P'").select("d", (F.col("close") / 100000).alias("rate"))
    return rounded(normalize.converted(fx.priority_bars(spark, sf_dir).select("asset", "d", "close"), rates), close=4)


@query(
    "fx_asof_intraday",
    f"""WITH rates AS (SELECT asset, bucket + INTERVAL 1 HOUR AS ts, close AS rate FROM ({_BARS.format('hour')})),
back AS (SELECT e.event_type AS asset, e.ts, e.value, r.rate FROM events e ASOF LEFT JOIN rates r ON e.event_type = r.asset AND e.ts >= r.ts)
SELECT asset, ts, {r('value', 4)}, {r('rate', 4)} FROM (SELECT b.asset, ts, value, coalesce(b.rate, f.rate) AS rate FROM back b JOIN (SELECT asset, first(rate ORDER BY ts) AS rate FROM rates GROUP BY 1) f ON f.asset = b.asset)""",
)
def fx_asof_intraday(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tick with its asset's close of the last hour that was over then."""
    ticks = fx.event_ticks(spark, sf_dir)
    rates = normalize.bucketed(ticks, "hour").select("asset", (F.col("bucket") + F.expr("INTERVAL 1 HOUR")).alias("ts"), F.col("close").alias("rate"))
    told = normalize.asof(ticks.select("asset", "ts", "value"), rates, "rate", by=("asset",), at="ts", bucket="day")
    return rounded(told.withColumn("ts", F.col("ts").cast("timestamp_ntz")), 4)


@query("align_inner", f"WITH raw AS ({fx.PRIORITY_BARS}) SELECT asset, d, close FROM raw WHERE d IN (SELECT d FROM raw GROUP BY d HAVING count(*) = (SELECT count(DISTINCT asset) FROM raw))")
def align_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.aligned(fx.priority_bars(spark, sf_dir).select("asset", "d", "close"))


@query("normalized_base100", f"WITH {fx.FLAG_PRICES}, b AS (SELECT asset, d, close / first_value(close) OVER (PARTITION BY asset ORDER BY d) * 100 AS rebased FROM prices) SELECT asset, d, {r('rebased', 4)} FROM b")
def normalized_base100(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(normalize.rebased(fx.flag_prices(spark, sf_dir)).select("asset", "d", "rebased"), 4)
