"""Rule votes, their daily score and latest summary, support and resistance, Fibonacci levels."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.windows import ordered, whole

C = F.col
# The rules and their groups, and the bounds of the labels.
RULES = {
    "rsi": "oscillator", "stochastic": "oscillator", "bollinger": "oscillator", "macd": "oscillator", "roc": "oscillator",
    "sma_20": "trend", "sma_50": "trend", "sma_200": "trend", "golden_cross": "trend", "adx": "trend", "aroon": "trend", "obv": "trend",
}
STRONG, WEAK = 0.5, 0.1
LEAST_VOTES = 5
RATIOS = (0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0)


def vote(up: Column, down: Column, valid: Column) -> Column:
    """1, -1 or 0; down wins over up; null where the indicator is."""
    return F.when(valid, F.when(down, -1).when(up, 1).otherwise(0))


def votes(wide: DataFrame) -> DataFrame:
    """vote_<rule> columns of an indicator frame (without volume, no obv rule)."""

    def over(a: str, b: str, known: str) -> Column:
        return vote(C(a) > C(b), C(a) < C(b), C(known).isNotNull())

    strong = C("adx") >= 20
    made = {
        "rsi": vote(C("rsi") < 30, C("rsi") > 70, C("rsi").isNotNull()),
        "stochastic": vote(C("stoch_k") < 20, C("stoch_k") > 80, C("stoch_k").isNotNull()),
        "bollinger": vote(C("bb_pct") < 0, C("bb_pct") > 1, C("bb_pct").isNotNull()),
        "macd": over("macd", "macd_signal", "macd"),
        "roc": vote(C("roc_20") > 0, C("roc_20") < 0, C("roc_20").isNotNull()),
        "sma_20": over("close", "sma_20", "sma_20"),
        "sma_50": over("close", "sma_50", "sma_50"),
        "sma_200": over("close", "sma_200", "sma_200"),
        "golden_cross": over("sma_50", "sma_200", "sma_200"),
        "adx": vote(strong & (C("di_plus") > C("di_minus")), strong & (C("di_plus") < C("di_minus")), C("adx").isNotNull()),
        "aroon": vote(C("aroon_osc") > 50, C("aroon_osc") < -50, C("aroon_osc").isNotNull()),
    }
    if "obv" in wide.columns:
        made["obv"] = over("obv", "obv_sma", "obv_sma")
    return wide.withColumns({f"vote_{k}": v for k, v in made.items()})


def vote_columns(voted: DataFrame) -> list[str]:
    return [f"vote_{r}" for r in RULES if f"vote_{r}" in voted.columns]


def score(voted: DataFrame, least: int = LEAST_VOTES) -> DataFrame:
    """The mean of a day's votes, null with under `least` of them."""
    names = vote_columns(voted)
    cast = F.array_compact(F.array(*(C(v) for v in names)))
    total = F.aggregate(cast, F.lit(0), lambda a, x: a + x)
    return voted.withColumn("votes", F.size(cast)).withColumn("score", F.when(C("votes") >= least, total / F.nullif(C("votes"), F.lit(0))))


def label(x: Column) -> Column:
    return F.when(x.isNull(), "undefined").when(x <= -STRONG, "strong_bear").when(x <= -WEAK, "bear").when(x < WEAK, "neutral").when(x < STRONG, "bull").otherwise("strong_bull")


def readings(voted: DataFrame) -> DataFrame:
    """What each rule says on each asset's last day: rule, group, the value it reads (null for crosses without one), its
    vote, and the vote in words. Rules without a vote are left out."""
    distance = lambda average: (C("close") / C(average) - 1) * 100
    nothing = F.lit(None).cast("double")
    value = {
        "rsi": C("rsi"), "stochastic": C("stoch_k"), "bollinger": C("bb_pct"), "macd": C("macd") - C("macd_signal"), "roc": C("roc_20"),
        "sma_20": distance("sma_20"), "sma_50": distance("sma_50"), "sma_200": distance("sma_200"), "golden_cross": nothing, "adx": C("adx"), "aroon": C("aroon_osc"), "obv": nothing,
    }
    # up, down and neither
    words = {
        "rsi": ("oversold, below 30", "overbought, above 70", "between 30 and 70"),
        "stochastic": ("oversold, below 20", "overbought, above 80", "between 20 and 80"),
        "bollinger": ("below the lower band", "above the upper band", "within the bands"),
        "macd": ("above its signal", "below its signal", "at its signal"),
        "roc": ("higher than 20 days ago", "lower than 20 days ago", "as 20 days ago"),
        **{f"sma_{n}": (f"above the average of {n} days", f"below the average of {n} days", f"at the average of {n} days") for n in (20, 50, 200)},
        "golden_cross": ("the 50-day average is above the 200-day one", "the 50-day average is below the 200-day one", "both averages are equal"),
        "adx": ("a strong rise", "a strong fall", "no clear trend, below 20"),
        "aroon": ("recent highs prevail", "recent lows prevail", "no clear direction"),
        "obv": ("volume confirms buyers", "volume confirms sellers", "volume confirms neither"),
    }
    of = lambda rule: F.struct(F.lit(rule).alias("rule"), F.lit(RULES[rule]).alias("grp"), value[rule].cast("double").alias("value"), C(f"vote_{rule}").alias("vote"), F.when(C(f"vote_{rule}") > 0, words[rule][0]).when(C(f"vote_{rule}") < 0, words[rule][1]).otherwise(words[rule][2]).alias("reading"))
    each = F.explode(F.array(*(of(v[5:]) for v in vote_columns(voted))))
    return latest(voted).select("asset", "d", each.alias("v")).select("asset", "d", "v.*").where("vote IS NOT NULL")


def latest(panel: DataFrame) -> DataFrame:
    return panel.withColumn("__last", F.max("d").over(whole())).where(C("d") == C("__last")).drop("__last")


def summary(voted: DataFrame) -> DataFrame:
    """Each asset's last day by group of rules and in all (`all`): votes, ups, downs, mean, label; no least number."""
    names = vote_columns(voted)
    pairs = F.array(*(F.struct(F.lit(n[5:]).alias("rule"), F.lit(RULES[n[5:]]).alias("grp"), C(n).alias("vote")) for n in names))
    long = latest(voted).select("asset", "d", F.explode(pairs).alias("v")).select("asset", "d", "v.*")
    groups = long.unionByName(long.withColumn("grp", F.lit("all"))).groupBy("asset", "d", "grp")
    out = groups.agg(F.count("vote").alias("votes"), F.count_if(C("vote") > 0).alias("ups"), F.count_if(C("vote") < 0).alias("downs"), F.avg("vote").alias("mean"))
    return out.withColumn("label", label(C("mean")))


def pivots(panel: DataFrame, side: int = 7) -> DataFrame:
    """Highs and lows that are the extreme of the days around them, one row each (`value`, `kind`)."""
    around = ordered().rowsBetween(-side, side)
    whole = F.count("close").over(around) == 2 * side + 1
    marked = panel.select("asset", "d", "high", "low", (whole & (C("high") == F.max("high").over(around))).alias("top"), (whole & (C("low") == F.min("low").over(around))).alias("bottom"))
    of = lambda flag, value, kind: marked.where(flag).select("asset", "d", C(value).alias("value"), F.lit(kind).alias("kind"))
    return of("top", "high", "high").unionByName(of("bottom", "low", "low"))


def tolerance(with_atr: DataFrame) -> DataFrame:
    """Each asset's width of a level: the median range relative to the close, within 1 and 6 percent; 2 if unknown."""
    return with_atr.groupBy("asset").agg(F.coalesce(F.greatest(F.lit(0.01), F.least(F.lit(0.06), F.percentile(C("atr") / C("close"), F.lit(0.5)))), F.lit(0.02)).alias("tolerance"))


def levels(points: DataFrame, widths: DataFrame) -> DataFrame:
    """Pivots in order of value, gathered while the next is at most the width above the level's mean. The pivots of one
    asset are few (one in a fortnight at most, of each kind)."""

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["value", "d", "kind"])
        width, made = 1 + float(frame["tolerance"].iloc[0]), []
        for value, d in zip(frame["value"], frame["d"]):
            if made and value <= made[-1][0] / made[-1][1] * width:
                made[-1] = (made[-1][0] + value, made[-1][1] + 1, max(made[-1][2], d))
            else:
                made.append((value, 1, d))
        return pd.DataFrame({"asset": frame["asset"].iloc[0], "level": [s / n for s, n, _ in made], "touches": [n for _, n, _ in made], "last_touch": [d for _, _, d in made]})

    return points.join(widths, "asset").groupBy("asset").applyInPandas(gather, "asset string, level double, touches long, last_touch date")


def nearest_levels(found: DataFrame, panel: DataFrame, k: int = 3) -> DataFrame:
    """The k nearest supports below and resistances above each asset's last close; a level at the close is neither."""
    price = latest(panel).select("asset", C("close").alias("price"))
    sided = found.join(price, "asset").where("level <> price").withColumn("side", F.when(C("level") < C("price"), "support").otherwise("resistance")).withColumn("distance_pct", (C("level") / C("price") - 1) * 100)
    order = Window.partitionBy("asset", "side").orderBy(F.abs("distance_pct"), "level")
    return sided.withColumn("rank", F.row_number().over(order)).where(C("rank") <= k)


def fibonacci(panel: DataFrame, days: int | None = None) -> DataFrame:
    """Seven levels between the extremes of all days, or of the last ones: down from the high if the low came first, else
    up."""
    recent = panel
    if days:
        recent = panel.withColumn("__n", F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("d")))).where(C("__n") <= days)
    ends = recent.groupBy("asset").agg(F.max("high").alias("top"), F.min("low").alias("bottom"), F.min_by("d", F.struct(-C("high"), "d")).alias("top_day"), F.min_by("d", F.struct("low", "d")).alias("bottom_day"))
    rising = C("bottom_day") < C("top_day")
    ratios = ends.withColumn("ratio", F.explode(F.array(*map(F.lit, RATIOS))))
    level = F.when(rising, C("top") - (C("top") - C("bottom")) * C("ratio")).otherwise(C("bottom") + (C("top") - C("bottom")) * C("ratio"))
    return ratios.select("asset", rising.alias("uptrend"), "top", "bottom", "ratio", level.alias("level"))
