"""Audit of added items against old ones: what each is like, and what that suggests.

Items are columns of structs n and o with question, answer, category, model, trim and knowledge_type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.functions.models import BRANDS

# Topics by word; weights and limits of the score.
TAG_WORDS = {
    "价格": ["价格", "多少钱", "指导价", "售价", "价位", "起售价", "报价"],
    "金融": ["金融", "分期", "贷款", "免息", "0息", "贴息", "月供", "首付"],
    "现金优惠": ["现金", "现金礼", "优惠", "钜惠", "直享"],
    "权益": ["权益", "活动", "礼", "礼包", "补贴", "购车"],
    "置换": ["置换", "增换购", "换购", "旧车", "增购"],
    "质保": ["质保", "保修", "三电", "整车质保"],
    "流量": ["流量", "基础服务", "娱乐", "尊享服务"],
    "续航": ["续航", "能跑", "公里", "CLTC"],
    "配置": ["配置", "功能", "配备", "装备"],
    "智驾": ["智驾", "辅助驾驶", "领航", "泊车", "NOA", "LCC", "NCA"],
    "保养": ["保养", "首保", "二保"],
}
QUESTION, TOKENS, ENTITIES, TAGS, OTHER_MODEL = 0.38, 0.22, 0.28, 0.12, 0.55
MODEL, TRIM, CATEGORY, KIND, TAG = 0.45, 0.10, 0.20, 0.10, 0.15
TOKEN = r"([A-Za-z]+[0-9A-Za-z+-]*|[\x{4e00}-\x{9fff}]{2,}|[0-9]+(?:\.[0-9]+)?)"
MARKS = r"[\s，。！？、,.!?；;：:\-_/\\|（）()【】\[\]\"'“”‘’]"


def squeezed(c: Column) -> Column:
    """Lower case without white space and marks, plus as a sign."""
    return F.regexp_replace(F.replace(F.lower(T.text(c)), F.lit("plus"), F.lit("+")), MARKS, "")


def tokens(*fields: Column) -> Column:
    """Distinct words, runs of Chinese characters and numbers of two characters or more, of the text and its squeezed form."""
    whole = F.concat_ws(" ", *(T.text(f) for f in fields))
    found = F.concat(*(F.regexp_extract_all(x, F.lit(TOKEN), F.lit(1)) for x in (whole, squeezed(whole))))
    return F.array_distinct(F.transform(F.filter(found, lambda t: F.length(t) >= 2), lambda t: F.lower(t)))


def tags(*fields: Column) -> Column:
    whole = F.concat(*(T.text(f) for f in fields))
    return F.filter(F.array(*(F.when(T.has_any(whole, w), F.lit(name)) for name, w in TAG_WORDS.items())), lambda x: x.isNotNull())


def model_tokens(model: Column) -> Column:
    """A model's name and the name without its brand; brands alone say nothing."""
    clean = F.regexp_replace(F.regexp_replace(T.text(model), r"(?U)\s+", ""), "^新(?=阿维塔)", "")
    bare = F.regexp_replace(clean, f"^(?:{'|'.join(BRANDS)})(?=.)", "")
    return F.transform(F.filter(F.array_distinct(F.array(clean, bare)), lambda m: (m != "") & ~m.isin(BRANDS)), lambda m: F.lower(m))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def scored(pairs: DataFrame, question_ratio: Column) -> DataFrame:
    """Pairs (n, o) with token_overlap, entity_score, intent_overlap, audit_score, model_match, category_match, number_change
    and suggestion. question_ratio: the matching-blocks ratio of the squeezed questions."""
    n, o = (lambda f: T.text(F.col(f"n.{f}"))), (lambda f: T.text(F.col(f"o.{f}")))
    rows = pairs.withColumns(
        {
            "nm": model_tokens(n("model")), "om": model_tokens(o("model")), "nt": tags(n("question"), n("category"), n("answer")), "ot": tags(o("question"), o("category"), o("answer")),
            "ns": tags(n("question"), n("category")), "os": tags(o("question"), o("category")), "nw": tokens(n("question"), n("category")), "ow": tokens(o("question"), o("category")),
            "nn": F.array_distinct(F.regexp_extract_all(n("answer"), F.lit(r"([0-9]+(?:\.[0-9]+)?)"), F.lit(1))), "on": F.array_distinct(F.regexp_extract_all(o("answer"), F.lit(r"([0-9]+(?:\.[0-9]+)?)"), F.lit(1))), "question_similarity": question_ratio,
        }
    )
    c, same = F.col, lambda f: (n(f) != "") & (n(f) == o(f))
    points = lambda holds, v: F.when(holds, v).otherwise(0.0)
    match = T.shares(c("nm"), c("om"))
    entity = points(match, MODEL) + points(same("trim"), TRIM) + points(same("category"), CATEGORY) + points(same("knowledge_type"), KIND) + points(T.shares(c("nt"), c("ot")), TAG)
    changed = (F.size("nn") > 0) & (F.size("on") > 0) & (F.array_sort("nn") != F.array_sort("on"))
    rows = rows.withColumns({"model_match": match, "category_match": same("category") | (F.size(F.array_except(F.array_intersect("ns", "os"), F.array(F.lit("权益")))) > 0), "number_change": changed, "entity_score": F.least(entity, F.lit(1.0)), "token_overlap": jaccard(c("nw"), c("ow")), "intent_overlap": jaccard(c("nt"), c("ot"))})
    total = QUESTION * c("question_similarity") + TOKENS * c("token_overlap") + ENTITIES * c("entity_score") + TAGS * c("intent_overlap")
    apart = (n("model") != "") & (o("model") != "") & ~c("model_match")
    rows = rows.withColumn("audit_score", F.when(apart, total * OTHER_MODEL).otherwise(total))
    s, m, g, k = c("audit_score"), c("model_match"), c("category_match"), c("number_change")
    wide = F.when((F.size("nt") == 1) & (F.size("ot") >= 2), "ONE_TO_MANY").when((F.size("nt") >= 2) & (F.size("ot") == 1), "MANY_TO_ONE").otherwise("REVIEW_REQUIRED")
    suggestion = (
        F.when(apart, F.when((s >= 0.68) & g, "REVIEW_REQUIRED").otherwise("TRUE_ADDED"))
        .when(m & g & k & (s >= 0.55), "SHOULD_UPDATE").when(m & g & ~k & (s >= 0.58), "DUPLICATE").when(m & (s >= 0.80) & ~k, "DUPLICATE").when(m & (s >= 0.72) & k, "SHOULD_UPDATE")
        .when(s >= 0.68, wide).when((s >= 0.58) & m & g, "REVIEW_REQUIRED").otherwise("TRUE_ADDED")
    )
    return rows.withColumn("suggestion", suggestion).drop("nm", "om", "nt", "ot", "ns", "os", "nw", "ow", "nn", "on")


def summary(top: DataFrame, added: int) -> DataFrame:
    """One row over the best candidate of each added item: with and without one, of high score, suspicious, by suggestion."""
    odd = ("SHOULD_UPDATE", "DUPLICATE", "ONE_TO_MANY", "MANY_TO_ONE", "REVIEW_REQUIRED")
    n = F.count(F.lit(1))
    return top.agg(n.alias("with_candidate"), (F.lit(added) - n).alias("without_candidate"), F.count_if(F.col("audit_score") >= 0.72).alias("high"), F.count_if(F.col("suggestion").isin(*odd)).alias("suspicious"), *(F.count_if(F.col("suggestion") == s).alias(s.lower()) for s in (*odd, "TRUE_ADDED")))
