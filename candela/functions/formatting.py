"""Numbers as text (decimal comma, points between thousands) and other scalar helpers, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "—"
#: Fixed units of compact amounts.
UNITS = ((1e12, "tri"), (1e9, "bi"), (1e6, "mi"), (1e3, "mil"))


def missing(x: Column) -> Column:
    return x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))


def number(x: Column, digits: int | Column = 2) -> Column:
    """1234.5 as 1.234,50; missing as a dash; never -0,00."""
    told = F.translate(F.format_number(x, digits), ",.", ".,")
    plain = F.when(told.rlike("^-[0.,]+$"), F.substr(told, F.lit(2))).otherwise(told)
    return F.when(missing(x), MISSING).otherwise(plain)


def price_digits(x: Column) -> Column:
    """Decimals of a price: two for large ones, more the smaller it is, about four significant ones at last."""
    size = F.abs(x)
    small = F.least(F.lit(12), 3 - F.floor(F.log10(F.nullif(size, F.lit(0.0))))).cast("int")
    return F.when(size == 0, 2).when(size >= 1000, 2).when(size >= 10, 2).when(size >= 1, 3).when(size >= 0.01, 4).when(size >= 1e-4, 6).otherwise(small)


def price(x: Column, symbol: str = "$") -> Column:
    digits = price_digits(x)
    out = F.when(missing(x), MISSING)
    for n in range(2, 13):
        out = out.when(digits == n, F.concat(F.lit(f"{symbol} "), number(x, n)))
    return out.otherwise(MISSING)


def _led(x: Column, symbol: str | None, told: Column) -> Column:
    """An absolute amount with its sign first, then the currency, if any."""
    return F.concat(F.when(x < 0, "-").otherwise(""), F.lit(f"{symbol} " if symbol else ""), told)


def money(x: Column, symbol: str | None = "$", digits: int = 2) -> Column:
    """An amount with its sign before the currency: -$ 1.234,50."""
    return F.when(missing(x), MISSING).otherwise(_led(x, symbol, number(F.abs(x), digits)))


def compact(x: Column, symbol: str | None = None) -> Column:
    """Amounts with the unit that fits, with or without a currency: 1,23 bi, -$ 1,23 bi."""
    size, out = F.abs(x), F.when(missing(x), MISSING)
    for least, unit in UNITS:
        out = out.when(size >= least, _led(x, symbol, F.concat(number(size / least, 2), F.lit(f" {unit}"))))
    return out.otherwise(_led(x, symbol, number(size, 2)))


def ratio(x: Column, digits: int = 2) -> Column:
    return number(x, digits)


def axis_format(x: Column) -> Column:
    """The format of an axis of prices around x, as d3 names it."""
    return F.concat(F.lit(",."), F.when(missing(x), 2).otherwise(price_digits(x)).cast("string"), F.lit("f"))


def percent(x: Column, digits: int = 2, signed: bool = False) -> Column:
    sign = F.when((F.round(x, digits) > 0) & F.lit(signed), "+").otherwise("")
    return F.when(missing(x), MISSING).otherwise(F.concat(sign, number(x, digits), F.lit("%")))


def title_of(asset: Column) -> Column:
    """A name for an asset that the catalogue doesn't know: its id's words with capitals."""
    return F.initcap(F.regexp_replace(asset, "-", " "))


def symbol_of(asset: Column) -> Column:
    """A symbol for it: its id's first word, six letters at most."""
    return F.upper(F.substring(F.split(asset, "-")[0], 1, 6))
