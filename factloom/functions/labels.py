"""Kinds, categories and texts that follow from codes and keywords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import has_any, text

# Kinds of knowledge that stay as they are, and the category words of the others, in this order.
KNOWN_KINDS = ["product", "price", "policy", "store", "marketing", "finance", "general"]
KIND_WORDS = {
    "finance": ["金融", "金融政策", "免息", "分期", "贷款"],
    "price": ["价格", "售价", "指导价", "价位", "价格信息"],
    "policy": ["政策", "权益", "购车权益", "优惠", "补贴", "活动", "价格政策"],
    "product": ["配置", "车型信息", "空间", "动力", "续航", "补能", "智驾", "安全", "舒适", "质保", "道路救援"],
}
# Categories of questions by keyword, the first that occurs wins.
CATEGORY_WORDS = {
    "价格": ["价格", "售价", "指导价", "多少钱", "价位"],
    "金融": ["金融", "贷款", "免息", "分期", "月供"],
    "权益": ["权益", "优惠", "补贴", "活动", "赠送"],
    "续航": ["续航", "公里", "电耗"],
    "动力": ["动力", "电机", "发动机", "加速"],
    "空间": ["空间", "轴距", "后排", "座椅"],
    "智驾": ["智驾", "辅助驾驶", "泊车", "领航"],
    "安全": ["安全", "气囊", "碰撞"],
    "配置": ["配置", "功能", "屏幕", "车机"],
}
OTHER_CATEGORY = "通用"
# Kinds that are exported as dynamic.
EXPORTED_DYNAMIC = ["price", "policy", "store", "marketing", "finance", "dynamic"]
# Texts that say yes.
YES = ["是", "true", "True", "1", "yes", "需要确认"]

# Labels of changes and review reasons, and what each reason code says.
CHANGES = {"ADDED": "新增", "UPDATED": "更新", "UNCHANGED": "未变化", "REVIEW_REQUIRED": "待确认"}
REVIEW_REASONS = {
    "NO_RELIABLE_MATCH": "未找到可靠对应知识",
    "OUT_OF_DETECTED_SCOPE": "不在本轮识别范围内",
    "AMBIGUOUS_MATCH": "存在多个可能对应项",
    "ONE_TO_MANY": "一条历史知识可能对应多条新知识",
    "MANY_TO_ONE": "多条历史知识可能对应同一条新知识",
    "MODEL_CONFLICT": "车型信息存在冲突",
    "TRIM_CONFLICT": "版本信息存在冲突",
    "CATEGORY_CONFLICT": "分类信息存在冲突",
    "ANSWER_CONFLICT": "新旧答案存在明显冲突",
    "POSSIBLE_DEPRECATED": "新资料存在可能失效证据",
    "LOW_CONFIDENCE": "匹配置信度不足",
    "DUPLICATE_KNOWLEDGE": "存在重复知识",
    "MISSING_REQUIRED_FIELD": "缺少必要字段",
}
REASONS = {
    "EXACT_MATCH": "问题、车型和分类高度一致，形成确定匹配。",
    "STRUCTURED_MATCH": "车型、主题和结构字段一致，形成规则匹配。",
    "NEW_KNOWLEDGE": "未在历史知识中找到可靠对应知识。",
    "UNCHANGED": "新旧答案核心内容一致，仅存在格式或问法差异。",
    "ANSWER_CHANGED": "问题主题和车型一致，但回答内容发生变化。",
    "PRICE_CHANGED": "问题主题和车型一致，但回答中的价格发生变化。",
    "NUMBER_CHANGED": "问题主题和车型一致，但回答中的数字信息发生变化。",
    "POSSIBLE_DEPRECATED": "新资料出现取消、终止、作废或到期等可能失效证据。",
    "OLD_NOT_IN_SCOPE": "本轮新增资料中未明显涉及该旧知识，旧知识默认继续保留。",
    "OLD_IN_SCOPE_UNMATCHED": "本轮资料可能涉及该知识范围，但未找到可靠对应内容，默认建议保留并人工确认。",
    "MISSING_REQUIRED_FIELD": "知识缺少问题或回答等必要字段，无法可靠比较。",
    "AMBIGUOUS_MATCH": "存在多个候选知识，系统无法可靠选择唯一对应项。",
    "NO_NEW_KNOWLEDGE": "本轮新增资料未生成有效知识，无法执行可靠差异分析。",
    "NO_KNOWLEDGE": "没有可比较的知识。",
}


def labelled(code: Column, labels: dict[str, str]) -> Column:
    """The text of a code; a code without one stands for itself, null is empty."""
    table = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return F.coalesce(F.try_element_at(table, text(code)), text(code))


def change_summary(change: Column, fields: Column, category: Column) -> Column:
    """One sentence on a change: what was added, what changed, or that nothing did."""
    named = F.when(F.size(fields) > 0, F.array_join(fields, "、")).otherwise("回答")
    return (
        F.when(change == "ADDED", F.concat(F.lit("识别到一条新的"), F.when(text(category) == "", "知识").otherwise(category), F.lit("。")))
        .when(change == "UPDATED", F.concat(named, F.lit("发生变化，建议人工复核后更新。")))
        .when(change == "UNCHANGED", F.when(F.size(fields) > 0, "核心答案未变化，仅问法或格式存在差异。").otherwise("新旧知识内容一致。"))
        .otherwise("")
    )


def internal_kind(value: Column, category: Column, module: Column) -> Column:
    """The kind of knowledge: a known one, else by words of category and module, else by static or dynamic, else general."""
    own, where = F.lower(F.trim(text(value))), F.concat_ws(" ", text(category), text(module))
    found = F.when(own == "dynamic", "policy").when(own == "static", "product").otherwise("general")
    for kind, words in reversed(KIND_WORDS.items()):
        found = F.when(has_any(where, words), kind).otherwise(found)
    return F.when(own.isin(KNOWN_KINDS), own).otherwise(found)


def inferred_category(question: Column, answer: Column, given: Column) -> Column:
    """The given category, else the first with a word in question or answer."""
    whole = F.concat_ws(" ", text(question), text(answer))
    found = F.lit(OTHER_CATEGORY)
    for name, words in reversed(CATEGORY_WORDS.items()):
        found = F.when(has_any(whole, words), name).otherwise(found)
    return F.when(text(given) != "", given).otherwise(found)


def says_yes(value: Column) -> Column:
    return F.trim(text(value)).isin(YES)


def exported_kind(kind: Column) -> Column:
    return F.when(kind.isin(EXPORTED_DYNAMIC), "dynamic").otherwise("static")


def clean_name(value: Column) -> Column:
    """A name without the characters that file names may not have."""
    return F.regexp_replace(F.trim(text(value)), r'[\\/:*?"<>|]', "")
