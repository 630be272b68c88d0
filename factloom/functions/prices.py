"""Prices, numbers and their spoken forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = "零一二三四五六七八九"


# Spellings of prices.
TEN_THOUSANDS = r"([0-9]+(?:\.[0-9]+)?)万元"
YUAN = r"(?<![0-9])([1-9][0-9]{1,2}(?:,[0-9]{3})+|[1-9][0-9]{4,6})元"


def price_set(c: Column) -> Column:
    """Distinct prices in ten thousands, two decimals: X万元, then yuan amounts with separators or of 5 to 7 digits."""
    big = F.transform(F.regexp_extract_all(c, F.lit(TEN_THOUSANDS), F.lit(1)), lambda v: F.round(v.cast("double"), 2))
    yuan = F.transform(F.regexp_extract_all(c, F.lit(YUAN), F.lit(1)), lambda v: F.round(F.replace(v, F.lit(","), F.lit("")).cast("double") / 10000, 2))
    return F.array_distinct(F.concat(big, yuan))


def yuan_list(c: Column) -> Column:
    """Distinct prices in yuan, ordered: X万 rounded, then bare numbers of 5 to 7 digits."""
    big = F.transform(F.regexp_extract_all(c, F.lit(r"(\d+(?:\.\d+)?)\s*万"), F.lit(1)), lambda v: F.bround(v.cast("double") * 10000, 0).cast("long"))
    bare = F.transform(F.regexp_extract_all(c, F.lit(r"(?<![\d.])(\d{5,7})(?![\d.]|\s*万)"), F.lit(1)), lambda v: v.cast("long"))
    return F.array_distinct(F.concat(big, bare))


def price_list(c: Column) -> Column:
    """Distinct prices in ten thousands as they come: X万, then amounts of five or six digits before 元."""
    big = F.transform(F.regexp_extract_all(c, F.lit(r"([0-9]+(?:\.[0-9]+)?)\s*万"), F.lit(1)), lambda v: v.cast("double"))
    yuan = F.transform(F.regexp_extract_all(c, F.lit(r"([0-9]{5,6})\s*元"), F.lit(1)), lambda v: v.cast("double") / 10000)
    return F.array_distinct(F.concat(big, yuan))


def written_price(value: Column) -> Column:
    """A price in ten thousands with two decimals at most."""
    return F.concat(F.regexp_replace(F.format_string("%.2f", value), r"\.?0+$", ""), F.lit("万元"))


def price_spellings(price: Column) -> Column:
    """The ways in which a text may spell the numbers of a price: plain, and from ten thousand on in ten thousands."""

    def spelt(number: Column) -> Column:
        v = number.cast("double")
        plain = F.when(v == F.floor(v), F.format_string("%d", v.cast("long"))).otherwise(v.cast("string"))
        fixed = F.format_string("%.2f", v / 10000)
        short = F.regexp_replace(F.format_string("%.10f", v / 10000), r"\.?0+$", "")
        more = F.array(fixed, F.regexp_replace(fixed, r"\.?0+$", ""), *(F.concat(x, F.lit(unit)) for unit in ("万", "万元") for x in (short, fixed)))
        return F.concat(F.array(plain), F.when(v >= 10000, more).otherwise(F.array().cast("array<string>")))

    return F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(price, F.lit(r"([0-9]+(?:\.[0-9]+)?)"), F.lit(1)), spelt)))


def names_price(text: Column, price: Column) -> Column:
    """Whether a text spells a price in any of these ways."""
    return F.exists(price_spellings(price), lambda s: F.contains(text, s))


def spoken(number: Column) -> Column:
    """A number as spoken: 0 to 99 in tens, longer ones digit by digit, decimals after 点."""
    whole, decimals = F.split_part(number, F.lit("."), F.lit(1)), F.split_part(number, F.lit("."), F.lit(2))
    read = lambda s: F.translate(s, "0123456789", DIGITS)
    n = whole.try_cast("int")
    tens, ones = F.substr(whole, F.lit(1), F.lit(1)), F.substr(whole, F.lit(2), F.lit(1))
    two = F.concat(F.when(tens == "1", "").otherwise(read(tens)), F.lit("十"), F.when(ones == "0", "").otherwise(read(ones)))
    said = F.when((F.length(whole) == 2) & (n >= 10), two).otherwise(read(whole))
    return F.when(decimals == "", said).otherwise(F.concat(said, F.lit("点"), read(decimals)))


def ratio(covered: Column, source: Column) -> Column:
    return F.when(source == 0, 0.0).otherwise(F.round(covered / source, 4))
