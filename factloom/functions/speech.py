"""Answers as they are read aloud."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.prices import spoken
from factloom.functions.text import text

# Units and abbreviations with their spoken forms, in this order.
SPOKEN = [
    ("N·m", "牛米"),
    ("N.m", "牛米"),
    ("kWh", "度电"),
    ("kW", "千瓦"),
    ("km", "公里"),
    ("mm", "毫米"),
    ("Ps", "匹"),
    ("ADS智能驾驶辅助系统", "智能驾驶辅助系统"),
    ("ADS", "智能驾驶辅助系统"),
    ("LCC", "车道居中辅助"),
    ("NCA", "领航辅助驾驶"),
    ("APA", "自动泊车"),
    ("RPA", "遥控泊车"),
    ("CDC", "可变阻尼悬架"),
    ("OTA", "在线升级"),
    ("NAPPA", "Nappa"),
]
DOUBLED = "智能驾驶辅助系统"
NUMBER = r"([0-9]+(?:\.[0-9]+)?)"


def replaced(c: Column, pattern: str, make: Callable[[Column], Column]) -> Column:
    """Each match of a pattern replaced by what its first group becomes."""
    between = F.split(c, pattern, -1)
    made = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), make)
    joined = F.array_join(F.zip_with(between, made, lambda b, m: F.concat(b, F.coalesce(m, F.lit("")))), "")
    return F.when(c.rlike(pattern), joined).otherwise(c)


def in_ten_thousands(amount: Column) -> Column:
    """An amount in yuan, with or without separators, as 万元 with two decimals at most."""
    value = F.replace(amount, F.lit(","), F.lit("")).try_cast("double") / 10000
    return F.concat(F.regexp_replace(F.regexp_replace(F.format_string("%.2f", value), "0+$", ""), r"\.$", ""), F.lit("万元"))


def answer_aloud(c: Column) -> Column:
    """An answer with prices in 万元, units and abbreviations spelt out, percentages in words and data volumes named."""
    found = replaced(text(c), r"[¥￥]\s*([0-9][0-9,]*(?:\.[0-9]+)?)", in_ten_thousands)
    found = replaced(found, r"(?<![0-9])([1-9][0-9]{1,2}(?:,[0-9]{3})+|[1-9][0-9]{4,6})元", in_ten_thousands)
    for old, new in SPOKEN:
        found = F.replace(found, F.lit(old), F.lit(new))
    found = F.regexp_replace(found, NUMBER + r"\s*V", "$1伏")
    found = replaced(found, NUMBER + r"\s*%", lambda v: F.concat(F.lit("百分之"), spoken(v)))
    found = F.regexp_replace(found, NUMBER + r"\s*G(?![A-Za-z])", "$1GB流量")
    found = F.regexp_replace(found, NUMBER + r"\s*GB(?!流量)", "$1GB流量")
    found = F.regexp_replace(found, "4K(?!高清)", "4K高清")
    return F.replace(found, F.lit(DOUBLED * 2), F.lit(DOUBLED))
