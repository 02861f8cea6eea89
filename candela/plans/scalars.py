"""Queries of scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.functions import formatting
from candela.plans import fixtures as fx
from candela.sources import market

QUERIES, ORACLES = {}, {}
_TOLD = "translate(format('{:,.2f}', o_totalprice), ',.', '.,')"
_SMALL = "(o_totalprice / pow(10, o_orderkey % 12))"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "orders")


QUERIES["format_ptbr"] = lambda spark, sf_dir: _orders(spark, sf_dir).select("o_orderkey", formatting.number(F.col("o_totalprice")).alias("told"))


def _amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, p = F.col("l_extendedprice") * (F.col("l_discount") * 25 - 1) * F.pow(F.lit(1000), F.col("l_linenumber") % 4), F.col("l_discount") * 25 - 1
    told = {"money": formatting.money(x), "plain": formatting.compact(x), "compact": formatting.compact(x, "R$"), "pct": formatting.percent(p)}
    return fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *(c.alias(name) for name, c in told.items()))


QUERIES["amounts_ptbr"] = _amounts
_BODY = "CASE " + " ".join(f"WHEN abs(x) >= {size} THEN translate(format('{{:,.2f}}', abs(x) / {size}), ',.', '.,') || ' {unit}'" for size, unit in (("1e12", "tri"), ("1e9", "bi"), ("1e6", "mi"), ("1e3", "mil"))) + " ELSE translate(format('{:,.2f}', abs(x)), ',.', '.,') END"
ORACLES["amounts_ptbr"] = f"""WITH n AS (SELECT *, l_extendedprice * (l_discount * 25 - 1) * pow(1000, l_linenumber % 4) AS x, l_discount * 25 - 1 AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN x < 0 THEN '-' ELSE '' END || '$ ' || translate(format('{{:,.2f}}', abs(x)), ',.', '.,') AS money, CASE WHEN x < 0 THEN '-' ELSE '' END || {_BODY} AS plain,
 CASE WHEN x < 0 THEN '-' ELSE '' END || 'R$ ' || {_BODY} AS compact, regexp_replace(translate(format('{{:,.2f}}', p), ',.', '.,'), '^-([0,]+)$', '\\1') || '%' AS pct FROM n"""
ORACLES["format_ptbr"] = f"SELECT o_orderkey, {_TOLD} AS told FROM orders"
QUERIES["price_decimals"] = lambda spark, sf_dir: _orders(spark, sf_dir).select("o_orderkey", formatting.price_digits(F.col("o_totalprice") / F.pow(F.lit(10), F.col("o_orderkey") % 12)).alias("digits"))
ORACLES["price_decimals"] = f"SELECT o_orderkey, CAST(CASE WHEN x >= 10 THEN 2 WHEN x >= 1 THEN 3 WHEN x >= 0.01 THEN 4 WHEN x >= 1e-4 THEN 6 ELSE least(12, 3 - floor(log10(x))) END AS INT) AS digits FROM (SELECT o_orderkey, {_SMALL} AS x FROM orders)"
QUERIES["md5_seed"] = lambda spark, sf_dir: fx.table(spark, sf_dir, "part").select("p_partkey", market.seed_of(F.col("p_name")).alias("seed"))
ORACLES["md5_seed"] = "SELECT p_partkey, ('0x' || substr(md5(p_name), 1, 8))::BIGINT AS seed FROM part"
QUERIES["json_props"] = lambda spark, sf_dir: fx.table(spark, sf_dir, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))
ORACLES["json_props"] = "SELECT event_type, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS INT) AS k, count(*) AS n FROM events GROUP BY 1, 2"
QUERIES["fear_greed_label"] = lambda spark, sf_dir: fx.table(spark, sf_dir, "events").select(market.sentiment_label(F.col("event_id") % 101).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
ORACLES["fear_greed_label"] = "SELECT CASE WHEN v <= 24 THEN 'extreme_fear' WHEN v <= 44 THEN 'fear' WHEN v <= 55 THEN 'neutral' WHEN v <= 75 THEN 'greed' ELSE 'extreme_greed' END AS label, count(*) AS n FROM (SELECT event_id % 101 AS v FROM events) GROUP BY 1"
