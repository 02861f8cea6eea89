"""Panels of daily bars from the test tables, and the same as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.operators import normalize
from candela.windows import full, ordered, rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(lines: DataFrame, asset: str) -> DataFrame:
    p = F.col("l_extendedprice") / F.col("l_quantity")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")  # whole numbers add up alike in any order
    first = F.min_by(p, F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return lines.groupBy(F.col(asset).alias("asset"), F.to_date("l_shipdate").alias("d")).agg(
        first.alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), (F.sum(cents) / 100.0 / F.sum("l_quantity")).alias("close"), F.sum("l_quantity").alias("volume")
    )


def flag_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(table(spark, sf_dir, "lineitem"), "l_returnflag")


def brand_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return _lines(table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")), "p_brand")


def _orders(spark: SparkSession, sf_dir: str, asset: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col(asset).alias("asset"), F.to_date("o_orderdate").alias("d")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.max_by("o_totalprice", "o_orderkey").alias("close"), F.count("*").cast("double").alias("volume")
    )


def priority_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, "o_orderpriority")


def status_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, "o_orderstatus")


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("asset"), "ts", "value")


def flag_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.prices(flag_bars(spark, sf_dir))


def brand_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.prices(brand_bars(spark, sf_dir))


def brand_cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brands' closes in whole cents, whose averages are the same however they are added up: filled days have equal
    closes, and so averages of different lengths that are equal."""
    return normalize.with_returns(brand_prices(spark, sf_dir).withColumn("close", F.round(F.col("close") * 100)))


def slow_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flags' closes averaged over 20 days and made to fall by half a percent a day, so that rules can do better than
    holding."""
    fallen = F.exp(F.row_number().over(ordered()) * -0.005)
    slow = flag_prices(spark, sf_dir).withColumn("close", full(F.col("close"), F.avg("close").over(rows(20)) * fallen, 20)).where("close IS NOT NULL")
    return normalize.with_returns(slow.select("asset", "d", "close"))


def flawed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with closes that must go: negative on the 13th, none on the 17th, nothing on the 23rd of each month."""
    day = F.dayofmonth("d")
    close = F.when(day == 13, -F.col("close")).when(day == 17, F.lit(None).cast("double")).when(day == 23, 0.0).otherwise(F.col("close"))
    return brand_bars(spark, sf_dir).withColumn("close", close)


def _lines_sql(asset: str, source: str) -> str:
    p = "l_extendedprice / l_quantity"
    return f"""SELECT {asset} AS asset, CAST(l_shipdate AS DATE) AS d,
 first({p} ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS open, max({p}) AS high, min({p}) AS low,
 CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100.0::DOUBLE / sum(l_quantity) AS close, sum(l_quantity) AS volume FROM {source} GROUP BY 1, 2"""


FLAG_BARS = _lines_sql("l_returnflag", "lineitem")
BRAND_BARS = _lines_sql("p_brand", "lineitem JOIN part ON l_partkey = p_partkey")


def _orders_sql(asset: str) -> str:
    return f"""SELECT {asset} AS asset, CAST(o_orderdate AS DATE) AS d, first(o_totalprice ORDER BY o_orderkey) AS open, max(o_totalprice) AS high,
 min(o_totalprice) AS low, last(o_totalprice ORDER BY o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY 1, 2"""


PRIORITY_BARS, STATUS_BARS = _orders_sql("o_orderpriority"), _orders_sql("o_orderstatus")


def normalised_sql(bars: str) -> str:
    """CTEs raw, seen (with gaps), kept (trimmed) and prices of some daily bars."""
    return f"""raw AS ({bars}),
seen AS (SELECT *, coalesce(date_diff('day', lag(d) OVER (PARTITION BY asset ORDER BY d), d) - 1, 0) AS gap FROM raw WHERE close > 0),
cuts AS (SELECT s.asset, max(CASE WHEN gap > 5 THEN d END) AS cut FROM seen s GROUP BY 1),
trims AS (SELECT c.asset, c.cut, coalesce(count(CASE WHEN s.d >= c.cut THEN 1 END) >= 60, false) AND c.cut IS NOT NULL AS trimmed FROM cuts c JOIN seen s ON s.asset = c.asset GROUP BY 1, 2),
kept AS (SELECT s.*, t.trimmed FROM seen s JOIN trims t ON s.asset = t.asset WHERE NOT t.trimmed OR s.d >= t.cut),
days AS (SELECT asset, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM kept GROUP BY asset),
dense AS (SELECT y.asset, y.d, k.d IS NULL AS was_filled, k.open, k.high, k.low, k.volume,
 last_value(k.close IGNORE NULLS) OVER (PARTITION BY y.asset ORDER BY y.d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close
 FROM days y LEFT JOIN kept k ON y.asset = k.asset AND y.d = k.d),
solid AS (SELECT asset, d, was_filled, close, coalesce(volume, 0) AS volume, CASE WHEN was_filled THEN close ELSE open END AS open,
 CASE WHEN was_filled THEN close ELSE greatest(open, high, low, close) END AS high, CASE WHEN was_filled THEN close ELSE least(open, high, low, close) END AS low FROM dense),
prices AS (SELECT *, close / lag(close) OVER (PARTITION BY asset ORDER BY d) - 1 AS returns,
 ln(close) - ln(lag(close) OVER (PARTITION BY asset ORDER BY d)) AS log_returns FROM solid)"""


FLAG_PRICES, BRAND_PRICES = normalised_sql(FLAG_BARS), normalised_sql(BRAND_BARS)
# named like the panel that it replaces
SLOW_PRICES = f"""{FLAG_PRICES.replace("prices AS (SELECT", "daily AS (SELECT")},
averaged AS (
  SELECT asset, d, avg(close) OVER (PARTITION BY asset ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) * exp(row_number() OVER (PARTITION BY asset ORDER BY d) * -0.005::DOUBLE) AS close,
    row_number() OVER (PARTITION BY asset ORDER BY d) AS k
  FROM daily
),
prices AS (
  SELECT asset, d, close, close / lag(close) OVER (PARTITION BY asset ORDER BY d) - 1 AS returns, ln(close) - ln(lag(close) OVER (PARTITION BY asset ORDER BY d)) AS log_returns
  FROM averaged WHERE k >= 20
)"""
BRAND_CENTS = f"""{BRAND_PRICES.replace("prices AS (SELECT", "daily AS (SELECT")},
cents AS (SELECT * REPLACE (round(close * 100) AS close) FROM daily),
prices AS (SELECT * REPLACE (close / lag(close) OVER (PARTITION BY asset ORDER BY d) - 1 AS returns, ln(close) - ln(lag(close) OVER (PARTITION BY asset ORDER BY d)) AS log_returns) FROM cents)"""
FLAWED_BARS = f"""SELECT * REPLACE (CASE day(d) WHEN 13 THEN -close WHEN 17 THEN NULL WHEN 23 THEN 0.0 ELSE close END AS close)
 FROM ({BRAND_BARS})"""
