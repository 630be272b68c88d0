"""Normalising and extracting text columns. Null, missing and empty text are one thing: the empty string."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases and words that matching ignores or rewrites, in this order.
QUESTION_PHRASES = [("多少钱", "价格"), ("什么价位", "价格"), ("价格是多少", "价格"), ("官方指导价多少", "价格"), ("官方指导价是多少", "价格"), ("起售价多少", "价格"), ("续航是多少", "续航"), ("续航多少", "续航")]
QUESTION_FILLERS = ["请问", "想问一下", "麻烦问下", "这个", "这款车", "的", "是多少", "多少", "怎么样", "吗", "呢", "？", "?"]

# Topics by keyword, the first that occurs wins.
TOPICS = {
    "official_price": ["价格", "售价", "指导价", "多少钱", "价位", "起售价", "元起", "万元"],
    "finance": ["金融", "贷款", "分期", "免息", "贴息", "首付", "月供", "费率"],
    "benefit": ["权益", "优惠", "补贴", "赠送", "抵扣", "活动", "礼包"],
    "range": ["续航", "cltc", "公里", "电池"],
    "charging": ["补能", "充电", "快充", "超充"],
    "space": ["空间", "轴距", "车长", "尺寸"],
    "power": ["动力", "电机", "扭矩", "功率", "加速"],
    "adas": ["智驾", "辅助驾驶", "领航", "泊车", "ads", "nca", "lcc"],
    "config": ["配置", "座椅", "屏幕", "音响", "车机", "功能"],
    "warranty": ["质保", "保修", "道路救援", "售后"],
}

# Intents by keyword; the last is the general one.
INTENTS = {
    "PRICE": ["多少钱", "价格", "售价", "指导价", "卖多少钱", "现在多少钱", "起售价", "报价", "价位"],
    "CASH_DISCOUNT": ["现金优惠", "现金礼", "现金钜惠", "直降", "直享", "优惠力度", "优惠多少"],
    "TRADE_IN": ["置换补贴", "置换礼", "增换购", "增购", "以旧换新", "旧车置换", "换购补贴"],
    "FINANCE": ["金融政策", "金融礼", "贷款", "分期", "首付", "免息", "0息", "贴息", "年化利率", "年费率"],
    "WARRANTY": ["质保", "保修", "质保礼", "终身质保", "整车质保"],
    "TRAFFIC_SERVICE": ["免费流量", "车机流量", "娱乐流量", "基础流量", "流量权益", "流量礼"],
    "CHARGING_BENEFIT": ["送充电桩", "充电桩权益", "免费安装", "充电权益", "充电桩"],
    "GENERAL_BENEFIT": ["购车权益", "购车福利", "有什么优惠", "有什么活动", "有什么礼", "购车政策", "权益政策"],
}
INTENT_NAMES = list(INTENTS)
GENERAL = "GENERAL_BENEFIT"
GENERIC_BENEFIT = "(有什么|有哪些|享受|包括).{0,8}(权益|优惠|活动|礼|政策)"

# Words that say a policy has ended.
DEPRECATED = ["取消", "停止", "终止", "作废", "失效", "到期", "不再执行", "不再提供", "停售", "下架", "替代", "以新政策为准", "原政策废止", "活动结束"]
PRICE_WORDS = ["价格", "售价", "指导价", "多少钱"]

FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
HALF_WIDTH = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def half_width(c: Column) -> Column:
    """Full-width forms to ASCII: the part of NFKC that business text needs, on the JVM."""
    return F.translate(text(c), FULL_WIDTH, HALF_WIDTH)


def squeezed(c: Column) -> Column:
    """Runs of white space to one space, trimmed; case kept: the key of exact duplicates."""
    return F.trim(F.regexp_replace(half_width(c), r"(?U)\s+", " "))


def question_key(c: Column) -> Column:
    """Lower case without white space."""
    return F.lower(F.regexp_replace(text(c), r"(?U)\s+", ""))


def plain(c: Column) -> Column:
    """Half width, lower case, no white space, three marks in ASCII."""
    return F.translate(F.lower(F.regexp_replace(half_width(c), r"(?U)\s+", "")), "，。？", ",.?")


def question_text(c: Column) -> Column:
    """A question without fillers and punctuation, with its phrases unified."""
    found = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), QUESTION_PHRASES, plain(c))
    found = reduce(lambda x, w: F.replace(x, F.lit(w), F.lit("")), QUESTION_FILLERS, found)
    return F.regexp_replace(found, "[,.!！:：;；、]", "")


def _amounts(c: Column, pattern: str, suffix: str) -> Column:
    """Each match of a pattern (group 1: a number of ten thousands) as a plain number and a suffix."""
    between = F.split(c, pattern, -1)
    values = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    spelt = F.transform(values, lambda v: F.concat(F.bround(v.cast("double") * 10000, 0).cast("decimal(38,0)").cast("string"), F.lit(suffix)))
    return F.when(F.size(values) == 0, c).otherwise(F.array_join(F.zip_with(between, spelt, lambda b, v: F.concat(b, F.coalesce(v, F.lit("")))), ""))


def _spelt_alike(c: Column) -> Column:
    """An answer with its amounts in one spelling, its punctuation kept."""
    found = F.regexp_replace(plain(c), r"(\d+),(\d{3})(?=元)", "$1$2")
    found = F.replace(found, F.lit("人民币"), F.lit(""))
    found = _amounts(found, r"(\d+(?:\.\d+)?)万元", "元")
    found = _amounts(found, r"(\d+(?:\.\d+)?)万(?!(?:公里|千米))", "")
    return F.replace(F.replace(found, F.lit("百分之十"), F.lit("10%")), F.lit("百分之三点八"), F.lit("3.8%"))


def answer_text(c: Column) -> Column:
    """An answer with its amounts in one spelling and without punctuation (decimal points go too). Amounts of a million
    and more stay plain numbers."""
    return F.regexp_replace(_spelt_alike(c), "[，。,.!！;；]", "")


def numbers(answer: Column, marks: bool = False) -> Column:
    """Numbers of an answer in order, from its normalised text. With marks its punctuation is kept and parts numbers:
    1,000公里 holds 1 and 000 instead of 1000."""
    return F.regexp_extract_all(_spelt_alike(answer) if marks else answer_text(answer), F.lit(r"(\d+(?:\.\d+)?%?)"), F.lit(1))


def has_any(c: Column, words: list[str]) -> Column:
    """Whether a text has one of the words: one pattern, so that long lists do not swell the plan."""
    return c.contains(words[0]) if len(words) == 1 else c.rlike("|".join(re.escape(w) for w in words))


def topic(*fields: Column) -> Column:
    """The first topic with a keyword in the fields."""
    whole = plain(F.concat_ws(" ", *(text(f) for f in fields)))
    found = F.lit("general")
    for name, words in reversed(TOPICS.items()):
        found = F.when(has_any(whole, words), name).otherwise(found)
    return found


def intents(*fields: Column) -> Column:
    """Intents of the fields, in declaration order; the general one also where an offer is named but no kind of it."""
    whole = F.replace(F.lower(F.concat(*(text(f) for f in fields))), F.lit(" "), F.lit(""))
    special = [F.when(has_any(whole, words), F.lit(name)) for name, words in INTENTS.items() if name != GENERAL]
    kinds = F.filter(F.array(*special), lambda x: x.isNotNull())
    offers = ~F.arrays_overlap(kinds, F.array(*(F.lit(k) for k in ("CASH_DISCOUNT", "TRADE_IN", "FINANCE"))))
    general = has_any(whole, INTENTS[GENERAL]) | (whole.contains("优惠") & offers) | whole.rlike(GENERIC_BENEFIT)
    return F.concat(kinds, F.when(general, F.array(F.lit(GENERAL))).otherwise(F.array().cast("array<string>")))


def specific(found: Column) -> Column:
    return F.array_except(found, F.array(F.lit(GENERAL)))


def shares(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) > 0


def related(a: Column, b: Column) -> Column:
    """A common intent, or the general one on one side and any but PRICE on the other."""
    other = lambda x: F.size(F.array_except(x, F.array(F.lit("PRICE"), F.lit(GENERAL)))) > 0
    return shares(a, b) | (F.array_contains(a, GENERAL) & other(b)) | (F.array_contains(b, GENERAL) & other(a))


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha1(F.concat_ws("|", *(text(p) for p in parts))), 1, 12))
