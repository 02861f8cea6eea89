"""Ticks, candles, sentiment and snapshots from landed files, a synthetic source, a cache, and failover between sources.

Files are read by Spark's readers; fetching over a network is left to a caller's function, which `retried` wraps.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candela import config, tables
from candela.operators import normalize, scans, simulate

C = F.col
_POINTS = "array<array<double>>"


class SourceError(Exception):
    """A source has no data; `kind` is not_found, not_allowed, limited or failed."""

    def __init__(self, kind: str, text: str = "") -> None:
        super().__init__(text or kind)
        self.kind = kind


def _keyed(points: Column) -> Column:
    """Pairs [time, value] as a map from time; of repeated times the last counts."""
    return F.aggregate(points, F.create_map().cast("map<bigint,double>"), lambda acc, p: F.map_concat(F.map_filter(acc, lambda k, _: k != p[0].cast("bigint")), F.create_map(p[0].cast("bigint"), p[1])))


def chart_json(spark: SparkSession, path: str, asset: str | None = None) -> DataFrame:
    """Ticks (asset, ts, close, volume, market_cap) of chart files: arrays of [milliseconds, value] for prices, volumes and
    capitalisations, the latter two matched to the prices' times. The asset is the file's name if it isn't given."""
    rows = spark.read.schema(f"prices {_POINTS}, total_volumes {_POINTS}, market_caps {_POINTS}").json(path, multiLine=True)
    named = rows.withColumn("asset", F.lit(asset) if asset else F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    maps = named.select("asset", F.explode("prices").alias("p"), _keyed(F.coalesce("total_volumes", F.array())).alias("v"), _keyed(F.coalesce("market_caps", F.array())).alias("m"))
    at = C("p")[0].cast("bigint")
    return maps.select("asset", F.timestamp_millis(at).alias("ts"), C("p")[1].alias("close"), F.try_element_at("v", at).alias("volume"), F.try_element_at("m", at).alias("market_cap"))


def candles_csv(spark: SparkSession, path: str) -> DataFrame:
    """asset, ts, open, high, low, close, volume of files with a header; what isn't a number is null."""
    rows = spark.read.option("header", True).csv(path)
    names = {c.lower(): c for c in rows.columns}
    number = lambda c: F.expr(f"try_cast(`{names[c]}` AS double)") if c in names else F.lit(None).cast("double")
    asset = C(names["asset"]) if "asset" in names else F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1)
    day = names.get("ts") or names.get("date") or names["timestamp"]
    return rows.select(asset.alias("asset"), F.expr(f"try_cast(`{day}` AS timestamp)").alias("ts"), *(number(c).alias(c) for c in ("open", "high", "low", "close", "volume")))


#: Fixed upper bounds of the sentiment classes.
SENTIMENT = ((24, "extreme_fear"), (44, "fear"), (55, "neutral"), (75, "greed"), (100, "extreme_greed"))


def sentiment_label(value: Column) -> Column:
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for most, name in SENTIMENT[:-1]:
        out = out.when(value <= most, name)
    return out.otherwise(SENTIMENT[-1][1])


def sentiment_json(spark: SparkSession, path: str) -> DataFrame:
    """d, value, label by day: rows that don't parse are skipped, of one day's rows the first in the file counts."""
    rows = spark.read.schema("data array<struct<value: string, timestamp: string>>").json(path, multiLine=True)
    each = rows.select(F.posexplode("data").alias("k", "x")).select("k", F.expr("try_cast(x.value AS int)").alias("value"), F.to_date(F.timestamp_seconds(F.expr("try_cast(x.timestamp AS bigint)"))).alias("d")).where("value IS NOT NULL AND d IS NOT NULL")
    return each.groupBy("d").agg(F.min_by("value", "k").alias("value")).withColumn("label", sentiment_label(C("value")))


def snapshot_json(spark: SparkSession, path: str) -> DataFrame:
    """One row per asset of a market overview: price, rank, capitalisation, volume and changes in percent."""
    changes = {f"price_change_percentage_{k}_in_currency": f"change_{k}" for k in ("24h", "7d", "30d", "1y")}
    schema = "id string, current_price double, market_cap_rank int, market_cap double, total_volume double, " + ", ".join(f"{c} double" for c in changes)
    rows = spark.read.schema(schema).json(path, multiLine=True)
    return rows.select(C("id").alias("asset"), C("current_price").alias("price"), C("market_cap_rank").alias("rank"), "market_cap", C("total_volume").alias("volume"), *(C(a).alias(b) for a, b in changes.items()))


def snapshot_or_nothing(spark: SparkSession, read: Callable[[], DataFrame]) -> DataFrame:
    """The rows of a snapshot that can be read and name an asset; no rows, of the same columns, if it can't: an overview is
    shown without it rather than not at all."""
    none = spark.createDataFrame([], "asset string, price double, rank int, market_cap double, volume double, change_24h double, change_7d double, change_30d double, change_1y double")
    try:
        return read().where("asset IS NOT NULL")
    except (SourceError, ConnectionError, AnalysisException):
        return none


def seed_of(text: Column) -> Column:
    """A whole number under 2**32 from a text."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


#: Parameters of made-up markets: volatility a day of the market and of an asset's own part, and what an asset takes of
#: the market's; the average share of all units that is traded in a day, and how much more by a day's return.
MARKET_SD, OWN_SD, BETA, TRADED, EXCITED = 0.028, 0.02, 1.2, 0.03, 8.0


def synthetic(spark: SparkSession, assets: list[str], days: int, start: str = "2022-01-01", seed: int = 42) -> DataFrame:
    """Made-up daily candles: one market factor that all assets share and noise of their own, both with clustering
    volatility (GARCH with heavy tails) and drifts that change every 60 days. An asset has a fixed supply of units, which
    gives its capitalisation at any price; a share of them is traded, more on days of large moves. The same for the same
    seed, on any cluster."""

    def returns(rng: np.random.Generator, scale: float) -> np.ndarray:
        shocks, drift = rng.standard_t(4, days) / np.sqrt(2), np.repeat(rng.normal(0.0004, 0.0025, days // 60 + 1), 60)[:days]
        variance, out = scale**2, np.empty(days)
        for k in range(days):
            out[k] = np.sqrt(variance) * shocks[k]
            variance = 0.06 * scale**2 + 0.09 * out[k] ** 2 + 0.85 * variance
        return drift + out

    def make(frame: pd.DataFrame) -> pd.DataFrame:
        market = returns(np.random.default_rng(seed), MARKET_SD)
        rng = np.random.default_rng([seed, int(frame["seed"].iloc[0])])
        base, supply = 10 ** rng.uniform(-1, 4, 1)[0], np.rint(10 ** rng.uniform(7, 10, 1)[0])
        r = BETA * market + returns(rng, OWN_SD)
        close = base * np.exp(np.cumsum(r) - r.sum())  # ends at the base
        opened = np.r_[close[0], close[:-1] * np.exp(rng.normal(0, 0.002, days - 1))]
        spread = np.abs(r) + np.abs(rng.normal(0, 0.012, days))
        up, down = rng.uniform(0.2, 0.7, (2, days)) * spread
        volume = close * supply * TRADED * np.exp(rng.normal(0, 0.35, days)) * (1 + EXCITED * np.abs(r))
        return pd.DataFrame({"asset": frame["asset"].iloc[0], "d": pd.date_range(start, periods=days).date, "open": opened, "high": np.maximum(opened, close) * np.exp(up), "low": np.minimum(opened, close) * np.exp(-down), "close": close, "volume": volume, "market_cap": close * supply})

    named = spark.createDataFrame([(a,) for a in assets], "asset string").withColumn("seed", seed_of(C("asset")))
    return named.groupBy("asset").applyInPandas(make, "asset string, d date, open double, high double, low double, close double, volume double, market_cap double")


def synthetic_sentiment(spark: SparkSession, days: int, start: str = "2022-01-01", seed: int = 7) -> DataFrame:
    """d, value and label of a made-up index around 50: each day keeps 0.92 of the distance of the day before and adds a
    normal shock of 6; what is told is a whole number from 3 to 97. Shocks are hashes of seed and day, so partitions and
    retries change nothing."""
    u = lambda tag: (simulate.hashed(seed, F.lit(tag), C("k")) + 0.5) / 2**32
    shock = F.when(C("k") > 0, F.sqrt(-2 * F.log(u("a"))) * F.cos(2 * np.pi * u("b")) * 6).otherwise(0.0)
    rows = spark.range(days).withColumnRenamed("id", "k").select(F.lit("index").alias("asset"), F.date_add(F.lit(start).cast("date"), C("k").cast("int")).alias("d"), shock.alias("shock"))
    walked = scans.pulled(rows, "shock", mean=50.0, keeps=0.92)
    value = F.round(F.greatest(F.lit(3.0), F.least(F.lit(97.0), C("level")))).cast("int")
    return walked.select("d", value.alias("value")).withColumn("label", sentiment_label(C("value")))


def retried(fetch: Callable[[], object], tries: int = 3, most_wait: float = 10.0, sleep: Callable[[float], None] = time.sleep):
    """The result of fetch. It raises ConnectionError (waited for 2**k seconds) or SourceError; a limited or failed
    source is waited for twice as long, or as long as its `retry_after` says."""
    for k in range(tries):
        try:
            return fetch()
        except (ConnectionError, SourceError) as failed:
            if k == tries - 1 or isinstance(failed, SourceError) and failed.kind not in ("limited", "failed"):
                raise
            wait = 2.0**k if isinstance(failed, ConnectionError) else float(getattr(failed, "retry_after", None) or 2.0 ** (k + 1))
            sleep(min(wait, most_wait))


def order(days: int, has_ticker: bool, wanted: str = "auto", most_days: int = 365) -> list[str]:
    """The sources to try in turn. Long histories come from the candle source first, where the asset has a ticker."""
    if wanted != "auto":
        return [wanted]
    both = ["chart", "candles"] if has_ticker else ["chart"]
    return both[::-1] if days > most_days and has_ticker else both


@dataclass
class Loaded:
    rows: DataFrame
    source: str
    stale: bool = False
    notices: list[str] = field(default_factory=list)


@dataclass
class Version:
    """A saved version of a key's tables, as its manifest tells."""

    path: str
    saved_at: float
    about: dict


class Cache:
    """Tables by key, every save a new version in a folder of its own. A manifest names the versions; a version's line is
    written last, by Spark's committed write, so a version is seen when all its tables are complete, and finding the
    newest one reads no data."""

    FRESH, STALE = 3600, 7 * 86400
    _MANIFEST = "version string, saved_at double, about string"

    def __init__(self, spark: SparkSession, folder: str, clock: Callable[[], float] = time.time) -> None:
        self.spark, self.folder, self.clock = spark, folder.rstrip("/"), clock

    def path(self, key: str) -> str:
        return f"{self.folder}/{re.sub('[^A-Za-z0-9]', '_', key)[:60]}-{hashlib.sha1(key.encode()).hexdigest()[:10]}"

    def save(self, key: str, rows: DataFrame, tables: dict[str, DataFrame] | None = None, **about: object) -> Version:
        """Write rows and further tables as a new version; about: what else its manifest tells."""
        version, saved_at = uuid.uuid4().hex, float(self.clock())
        made = Version(f"{self.path(key)}/{version}", saved_at, about)
        for name, table in {"rows": rows, **(tables or {})}.items():
            table.write.parquet(f"{made.path}/{name}")
        line = self.spark.createDataFrame([(version, saved_at, json.dumps(about))], self._MANIFEST)
        line.coalesce(1).write.mode("append").json(f"{self.path(key)}/manifest")
        return made

    def newest(self, key: str, most_age: float, at_least: float = 0) -> Version | None:
        """The newest version, if it is young enough and not from before `at_least`; an unreadable manifest counts as none."""
        try:
            found = self.spark.read.schema(self._MANIFEST).json(f"{self.path(key)}/manifest").agg(F.max(F.struct("saved_at", "version", "about"))).first()[0]
        except AnalysisException:
            return None
        if found is None or found["saved_at"] is None or self.clock() - found["saved_at"] > most_age or found["saved_at"] < at_least:
            return None
        return Version(f"{self.path(key)}/{found['version']}", found["saved_at"], json.loads(found["about"] or "{}"))

    def table(self, version: Version, name: str = "rows") -> DataFrame:
        return self.spark.read.parquet(f"{version.path}/{name}")

    def load(self, key: str, most_age: float, at_least: float = 0) -> DataFrame | None:
        """The rows of newest()."""
        version = self.newest(key, most_age, at_least)
        try:
            return self.table(version) if version else None
        except AnalysisException:
            return None


def loaded(cache: Cache, key: str, sources: Iterable[tuple[str, Callable[[], DataFrame]]], at_least: float = 0) -> Loaded:
    """From the cache while it is fresh, else from the first source that has data, else from an old cache, marked so."""
    if (rows := cache.load(key, Cache.FRESH, at_least)) is not None:
        return Loaded(rows, "cache")
    notices = []
    for name, read in sources:
        try:
            rows = read()
            if rows.isEmpty():
                raise SourceError("not_found", "no rows")
            cache.save(key, rows)
            return Loaded(rows, name, notices=notices)
        except (SourceError, ConnectionError, AnalysisException) as failed:
            notices.append(f"{name}: {failed}")
    if (rows := cache.load(key, Cache.STALE)) is not None:
        return Loaded(rows, "cache", True, notices)
    raise SourceError("failed", "; ".join(notices) or "no source")


@dataclass
class Source:
    """A source of raw rows (asset, d, close and what else there is) of the last so many days, and the most it has."""

    name: str
    read: Callable[[int], DataFrame]
    most_days: int | None = None


@dataclass
class MarketData:
    """Normalised rows and the quality record of the raw ones they came from, with where and when that was."""

    rows: DataFrame
    quality: DataFrame
    source: str
    saved_at: float
    has_ohlc: bool
    from_cache: bool = False
    stale: bool = False
    notices: list[str] = field(default_factory=list)


def _told_gaps(quality: DataFrame) -> list[str]:
    """What the quality record says of long gaps, counted over all assets."""
    long_gap = C("longest_gap") > config.MAX_FILL_DAYS
    cut, filled, longest = quality.agg(F.count_if(C("trimmed_start")), F.count_if(long_gap & ~C("trimmed_start")), F.max("longest_gap")).first()
    told = [f"{cut} assets begin after their last long gap"] if cut else []
    told += [f"{filled} assets have a long gap that was filled with the last price"] if filled else []
    return [f"{x} (longest: {longest} days)" for x in told]


def collected(cache: Cache, key: str, sources: Iterable[Source], days: int, at_least: float = 0) -> MarketData:
    """Daily market data of a key: the fresh saved version (not from before `at_least`), else the first source that has
    rows, normalised and saved with the quality record of its raw rows, else an old saved version, marked as stale.

    Saved rows are normalised again when they are read, which changes nothing but says nothing of what was filled or
    dropped the first time; so the record is always the saved one."""

    def built(version: Version, from_cache: bool, stale: bool = False, notices: list[str] | None = None) -> MarketData:
        about = version.about
        rows = normalize.prices(cache.table(version))
        return MarketData(rows, cache.table(version, "quality"), about["source"], version.saved_at, about["has_ohlc"], from_cache, stale, about["notices"] if notices is None else notices)

    if version := cache.newest(key, Cache.FRESH, at_least):
        return built(version, True)
    failures = []
    for source in sources:
        notices = []
        if source.most_days is not None and days > source.most_days:
            notices.append(f"{source.name} has {source.most_days} days at most")
        try:
            raw = tables.kept(source.read(min(days, source.most_days or days)), "raw-market")
            if raw.isEmpty():
                raise SourceError("not_found", "no rows")
        except (SourceError, ConnectionError, AnalysisException) as failed:
            failures.append(f"{source.name}: {failed}")
            continue
        quality = tables.kept(normalize.quality(raw), "raw-quality")
        rows = normalize.prices(raw)
        notices = [*(["another source was used. " + " | ".join(failures)] if failures else []), *notices, *_told_gaps(quality)]
        kept = rows.select("asset", "d", "close", *(c for c in normalize.OPTIONAL if c in raw.columns))
        has_ohlc = {"open", "high", "low"} <= set(raw.columns)
        return built(cache.save(key, kept, {"quality": quality}, source=source.name, has_ohlc=has_ohlc, notices=notices), False)
    if version := cache.newest(key, Cache.STALE):
        hours = (cache.clock() - version.saved_at) / 3600
        return built(version, True, True, [f"all sources failed; saved {hours:.1f} hours ago. " + " | ".join(failures)])
    raise SourceError("failed", " | ".join(failures) or "no source")


def to_local_csv(rows: DataFrame, path: str, digits: int = 6) -> None:
    """CSV with semicolons and decimal commas (no byte-order mark: each task writes a file of its own)."""
    local = [F.regexp_replace(F.format_string(f"%.{digits}f", c), r"\.", ",").alias(c) if t == "double" else C(c) for c, t in rows.dtypes]
    rows.select(*local).write.option("header", True).option("sep", ";").csv(path)
