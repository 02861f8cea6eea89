"""Ticks or candles to one gap-free row per asset and calendar day, with a quality record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela import config
from candela.windows import forward_filled, from_here, ordered, ratio, so_far, whole

OPTIONAL = ("open", "high", "low", "volume", "market_cap")


def daily_ticks(ticks: DataFrame, midnight_minutes: int = 0) -> DataFrame:
    """The last tick of each asset and UTC day; a tick within some minutes after midnight closes the day before."""
    early = (F.unix_timestamp("ts") - F.unix_timestamp(F.date_trunc("day", "ts"))) < midnight_minutes * 60
    day = F.to_date("ts") if not midnight_minutes else F.when(early, F.date_sub(F.to_date("ts"), 1)).otherwise(F.to_date("ts"))
    values = [c for c in ticks.columns if c not in ("asset", "ts")]
    last = ticks.withColumn("d", day).groupBy("asset", "d").agg(F.max_by(F.struct(*values), F.col("ts")).alias("v"))
    return last.select("asset", "d", *(F.col(f"v.{c}").alias(c) for c in values))


def bucketed(ticks: DataFrame, bucket: str) -> DataFrame:
    """Open, high, low, close and volume (the number of ticks) of each asset and hour or day. ticks: asset, ts, value,
    with (asset, ts) unique."""
    at = F.date_trunc(bucket, F.col("ts"))
    return ticks.groupBy("asset", at.alias("bucket")).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").cast("double").alias("volume")
    )


def numeric(raw: DataFrame) -> DataFrame:
    """Values coerced to double, unreadable ones null; NaN counts as missing."""
    values = [c for c in ("close", *OPTIONAL) if c in raw.columns]
    if "close" not in values:
        raise ValueError("a close column is needed")
    cast = lambda c: F.expr(f"nanvl(try_cast(`{c}` AS DOUBLE), NULL)")
    return raw.select("asset", "d", *(cast(c).alias(c) for c in values))


def observed(raw: DataFrame) -> DataFrame:
    """Rows with a positive close, of assets with two of them or more, with the missing days before each (`gap`)."""
    kept = numeric(raw).where("close > 0")
    return kept.withColumn("n", F.count("*").over(whole())).where("n >= 2").drop("n").withColumn("gap", F.coalesce(F.datediff("d", F.lag("d").over(ordered())) - 1, F.lit(0)))


def trimmed(rows: DataFrame, longest: int = config.MAX_FILL_DAYS, least: int = config.MIN_ROWS_AFTER_TRIM) -> DataFrame:
    """Rows from the last gap longer than `longest` on, where at least `least` remain; else all."""
    cut = rows.withColumn("cut", F.max(F.when(F.col("gap") > longest, F.col("d"))).over(whole()))
    after = cut.withColumn("after", F.count_if(F.col("d") >= F.col("cut")).over(whole()))
    return after.withColumn("trimmed", F.coalesce(F.col("after") >= least, F.lit(False))).where(~F.col("trimmed") | (F.col("d") >= F.col("cut"))).drop("cut", "after")


def calendar(rows: DataFrame) -> DataFrame:
    """Every day of each asset from its first to its last."""
    return rows.groupBy("asset").agg(F.min("d").alias("a"), F.max("d").alias("b")).select("asset", F.explode(F.sequence("a", "b")).alias("d"))


def missing_days(rows: DataFrame) -> DataFrame:
    return calendar(rows).join(rows.select("asset", "d"), ["asset", "d"], "left_anti")


def filled(rows: DataFrame) -> DataFrame:
    """The calendar's days with closes and market caps carried forward, the other prices at the close and no volume. Each
    row is repeated until the day before the next one: no calendar is joined, and the rows stay in their partition."""
    have = [c for c in ("close", *OPTIONAL) if c in rows.columns]
    if "market_cap" in have:
        rows = rows.withColumn("market_cap", forward_filled(F.col("market_cap")))
    last = F.greatest("d", F.coalesce(F.date_sub(F.lead("d").over(ordered()), 1), F.col("d")))
    days = rows.withColumn("__last", last).select("asset", F.explode(F.sequence("d", "__last")).alias("__day"), "d", *have)
    new = F.col("__day") != F.col("d")
    some = {c: F.when(new, F.col("close")).otherwise(F.col(c)) for c in ("open", "high", "low") if c in have}
    some |= {"volume": F.when(new, 0.0).otherwise(F.coalesce("volume", F.lit(0.0)))} if "volume" in have else {}
    dense = days.withColumns({**some, "was_filled": new}).drop("d").withColumnRenamed("__day", "d")
    prices = [F.col(c) for c in ("open", "high", "low", "close") if c in have]
    if "high" in have and "low" in have:
        dense = dense.withColumns({"high": F.greatest(*prices), "low": F.least(*prices)})
    return dense


def with_returns(rows: DataFrame) -> DataFrame:
    before = F.lag("close").over(ordered())
    return rows.withColumns({"returns": F.col("close") / before - 1, "log_returns": F.log("close") - F.log(before)})


def prices(raw: DataFrame) -> DataFrame:
    """The normalised panel: contiguous days, consistent prices, simple and log returns. raw: asset, d, close and any of
    open, high, low, volume and market_cap, one row per asset and day."""
    return with_returns(filled(trimmed(observed(raw))))


def outliers(panel: DataFrame, least: int = 30) -> DataFrame:
    """Days whose log return exceeds eight robust deviations (a quarter at least); assets with over `least` returns."""
    r = panel.where("log_returns IS NOT NULL").select("asset", "d", "log_returns")
    medians = r.groupBy("asset").agg(F.percentile("log_returns", F.lit(0.5)).alias("m"), F.count("*").alias("n")).where(F.col("n") > least)
    near = r.join(medians, "asset")
    spread = near.groupBy("asset").agg(F.percentile(F.abs(F.col("log_returns") - F.col("m")), F.lit(0.5)).alias("mad"))
    bound = F.when(F.col("mad") == 0, F.lit(0.25)).otherwise(F.greatest(F.lit(0.25), 8 * 1.4826 * F.col("mad")))
    return near.join(spread, "asset").withColumn("threshold", bound).where(F.abs("log_returns") > F.col("threshold")).select("asset", "d", "log_returns", "threshold")


def quality(raw: DataFrame) -> DataFrame:
    """Each asset's quality record: points, range, filled days, dropped rows, longest gap, whether it was trimmed. One
    pass over the raw rows tells all but the outliers: the kept range has a point a day, and what it lacks is filled."""
    good = F.coalesce(F.col("close") > 0, F.lit(False))
    own = Window.partitionBy("asset", "good")
    rows = numeric(raw).withColumn("good", good).withColumn("gap", F.when(F.col("good"), F.coalesce(F.datediff("d", F.lag("d").over(own.orderBy("d"))) - 1, F.lit(0))))
    cut = rows.withColumn("cut", F.max(F.when(F.col("gap") > config.MAX_FILL_DAYS, F.col("d"))).over(own))
    marked = cut.withColumn("trimmed", F.col("good") & (F.count_if(F.col("d") >= F.col("cut")).over(own) >= config.MIN_ROWS_AFTER_TRIM))
    kept = F.col("good") & (~F.col("trimmed") | (F.col("d") >= F.col("cut")))
    told = marked.groupBy("asset").agg(
        F.min(F.when(kept, F.col("d"))).alias("start"), F.max(F.when(kept, F.col("d"))).alias("end"), F.count_if(kept).alias("seen"), F.count_if("good").alias("n"),
        F.count_if(~F.col("good")).alias("dropped_rows"), F.max("gap").alias("longest_gap"), F.bool_or("trimmed").alias("trimmed_start"),
    )
    points = told.where("n >= 2").withColumn("points", F.datediff("end", "start").cast("long") + 1).withColumn("filled_days", F.col("points") - F.col("seen")).drop("n", "seen")
    flagged = outliers(prices(raw)).groupBy("asset").agg(F.count("*").alias("outliers"))
    return points.join(flagged, "asset", "left").withColumn("outliers", F.coalesce("outliers", F.lit(0)))


def asof(left: DataFrame, rates: DataFrame, value: str, by: tuple[str, ...] = (), at: str = "d", bucket: str = "year") -> DataFrame:
    """left with the rate's value of the same or the last earlier time (`at`, a date or timestamp in both), before the
    first rate the first; of the rates (by, at and value) of one time the greatest counts. by: columns of both that tell
    which rates a row takes, currencies for instance; a key without rates has null.

    Both sides go in one order by key and bucket of time, where the last rate is taken; what a bucket starts with is
    carried over from the buckets before it. So no task holds more than a key's bucket, and no calendar is made.
    """
    keys = [f"__by{k}" for k in range(len(by))]
    key = lambda: [F.col(b).alias(k) for b, k in zip(by, keys)]
    when = F.col(at).cast("timestamp")
    marks = lambda side: [*key(), when.alias("__at"), F.date_trunc(bucket, when).alias("__bucket"), F.lit(side).alias("__side")]
    kind = rates.schema[value].dataType
    told = rates.where(F.col(value).isNotNull()).select(*marks(0), F.col(value).alias("__rate"))
    asked = left.select(*marks(1), F.lit(None).cast(kind).alias("__rate"), F.struct(*left.columns).alias("__row"))
    both = told.withColumn("__row", F.lit(None).cast(asked.schema["__row"].dataType)).unionByName(asked)
    order = Window.partitionBy(*keys, "__bucket").orderBy("__at", "__side", "__rate").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__last", F.last("__rate", ignorenulls=True).over(order)).where("__side = 1")
    # of each bucket of a key what it is left with; then what it starts with
    ends = both.groupBy(*keys, "__bucket").agg(F.max(F.when(F.col("__side") == 0, F.struct("__at", "__rate"))).alias("last"), F.min(F.when(F.col("__side") == 0, F.struct("__at", F.struct("__rate").alias("first")))).alias("__first"))
    own = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__bucket")
    carried = F.last("last.__rate", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    earliest = F.first("__first.first.__rate", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    starts = ends.select(*(F.col(k).alias(f"{k}s") for k in keys), F.col("__bucket").alias("__start"), F.coalesce(carried, earliest).alias("__carried"))
    same = F.col("__bucket").eqNullSafe(F.col("__start"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}s"))
    return found.join(starts, same, "left").select("__row.*", F.coalesce("__last", "__carried").alias(value))


def converted(panel: DataFrame, rates: DataFrame, value: str = "rate", by: tuple[str, ...] = (), at: str = "d") -> DataFrame:
    """Prices and volume in another currency."""
    return asof(panel, rates, value, by, at).withColumns({c: F.col(c) * F.col(value) for c in ("open", "high", "low", "close", "volume") if c in panel.columns})


def rebased(panel: DataFrame, base: float = 100.0) -> DataFrame:
    return panel.withColumn("rebased", ratio(F.col("close"), F.first("close").over(so_far())) * base)


def aligned(panel: DataFrame, assets: int | None = None) -> DataFrame:
    """Days on which all assets (or so many) have a close, in long form: no join is needed."""
    wanted = F.lit(assets) if assets else F.lit(panel.select("asset").distinct().count())
    together = panel.groupBy("d").agg(F.count("close").alias("n")).where(F.col("n") == wanted).select("d")
    return panel.join(together, "d", "left_semi")


def first_where(condition: Column, value: Column) -> Column:
    """The first value from here on where a condition holds."""
    return F.first(F.when(condition, value), ignorenulls=True).over(from_here())
