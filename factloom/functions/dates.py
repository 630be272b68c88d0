"""Dates of policies in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import has_any

# Spellings of ranges and months; words beside which a month is a date.
CN_RANGE = r"([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日(?:至|到|-|—|~)(?:([0-9]{4})年)?([0-9]{1,2})月([0-9]{1,2})日"
SLASH_RANGE = r"([0-9]{4})[/-]([0-9]{1,2})[/-]([0-9]{1,2}).{0,30}?([0-9]{4})[/-]([0-9]{1,2})[/-]([0-9]{1,2})"
MONTH = r"([0-9]{4})(?:年(?=[0-9]{1,2}月)|[/-](?=[0-9]{1,2}[/-][0-9]))([0-9]{1,2})"
PERIOD = r"[0-9]{4}年[0-9]{1,2}月|[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}"
DATE_WORDS = ["有效期", "截止", "活动周期", "活动时间", "上线时间", "下线时间", "限时", "下定", "大定", "政策周期", "期间", "至"]


def _date(*parts: Column) -> Column:
    return F.concat_ws("-", parts[0], *(F.lpad(p, 2, "0") for p in parts[1:]))


def policy_dates(text: Column) -> Column:
    """Struct (period, effective, expire): a Chinese range, else a slashed one, else the first month; 'unknown' where not stated."""
    g = lambda pattern, k: F.regexp_extract(text, pattern, k)
    row = lambda period, start, end: F.struct(period.alias("period"), start.alias("effective"), end.alias("expire"))
    unknown = F.lit("unknown")
    cn = [g(CN_RANGE, k) for k in range(1, 7)]
    slash = [g(SLASH_RANGE, k) for k in range(1, 7)]
    end_year = F.when(cn[3] != "", cn[3]).otherwise(cn[0])
    return (
        F.when(cn[0] != "", row(F.concat(cn[0], F.lit("年"), cn[1].cast("int").cast("string"), F.lit("月")), _date(*cn[:3]), _date(end_year, cn[4], cn[5])))
        .when(slash[0] != "", row(F.concat(slash[0], F.lit("年"), slash[1].cast("int").cast("string"), F.lit("月")), _date(*slash[:3]), _date(*slash[3:])))
        .when(g(MONTH, 1) != "", row(F.concat(g(MONTH, 1), F.lit("年"), g(MONTH, 2).cast("int").cast("string"), F.lit("月")), unknown, unknown))
        .otherwise(row(unknown, unknown, unknown))
    )


def policy_periods(text: Column) -> Column:
    """Distinct months (YYYY年M月) of a text that speaks of dates, however they are written."""
    found = F.regexp_extract_all(text, F.lit(f"({PERIOD})"), F.lit(1))
    months = F.transform(found, lambda m: F.concat(F.substring(m, 1, 4), F.lit("年"), F.regexp_extract(m, "[0-9]{4}[年./-]([0-9]{1,2})", 1).cast("int").cast("string"), F.lit("月")))
    return F.when(has_any(text, DATE_WORDS), F.array_distinct(months)).otherwise(F.array().cast("array<string>"))
