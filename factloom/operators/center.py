"""What a reviewer sees: gaps, items to confirm, items held back and dynamic notices as one list, its counts, and changes by kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import models
from factloom.functions import text as T
from factloom.operators import gate

# Kinds that a row keeps, words that give it one, and labels.
KINDS = ["missing", "conflict", "inference", "dynamic_notice"]
CONFLICT_WORDS = ["冲突", "不一致", "矛盾"]
INFERENCE_WORDS = ["推断", "无法判断", "需确认", "适用范围", "版本归属"]
LABELS = {"missing": "信息缺失", "conflict": "信息冲突", "inference": "AI推断", "range_issue": "范围异常"}
ALL_MODELS, OPEN_POINT, NO_TRIM, UNKNOWN = "全部车型", "待人工关注事项", "未指定", "未识别"
NOT_FOUND, CHECK, NOT_FIT, PENDING = "资料中未找到可直接确认的信息", "补充资料或人工核查", "该知识不适合进入正式导出文件", "待确认知识"
NOTICE, NOTICE_ACTION = "已识别为动态知识，未来可能随市场政策变化更新。", "未来支持自动更新"
# Topics of notices by word, the first that occurs wins; others are benefits.
NOTICE_WORDS = {"价格知识": ["价格", "售价", "指导价", "多少钱", "价位"], "金融政策": ["金融", "贷款", "免息", "0息", "费率"], "活动政策": ["活动", "限时", "政策"]}
BENEFITS = "购车权益"

ROW = ("kind", "model", "item", "reason", "action")


def first_of(columns: list[Column], other: str) -> Column:
    """The first that says something."""
    return F.coalesce(*(F.when(T.text(c) != "", T.text(c)) for c in columns), F.lit(other))


def open_point(points: DataFrame, default_kind: str = "missing") -> DataFrame:
    """Points of any form with one set of columns: review_type, brand, model, trim, category, item, reason, suggestion."""
    c = lambda *names: [F.col(n) for n in names if n in points.columns]
    return points.select(
        first_of(c("review_type"), default_kind).alias("review_type"), first_of(c("brand"), "").alias("brand"), first_of(c("model", "vehicle"), ALL_MODELS).alias("model"), first_of(c("trim"), NO_TRIM).alias("trim"),
        first_of(c("category", "impact_module"), "").alias("category"), first_of(c("item", "missing_content", "question", "description"), OPEN_POINT).alias("item"), first_of(c("reason", "description"), NOT_FOUND).alias("reason"),
        first_of(c("suggestion", "confirm_content"), CHECK).alias("suggestion"),
    )


def kind_of(given: Column, whole: Column) -> Column:
    return F.when(given.isin(KINDS), given).when(T.has_any(whole, CONFLICT_WORDS), "conflict").when(T.has_any(whole, INFERENCE_WORDS), "inference").otherwise("missing")


def review_rows(gaps: DataFrame, confirm: DataFrame, items: DataFrame) -> DataFrame:
    """One list of kind, model, item, reason and action: open gaps, items to confirm, items that the gate holds back, and
    notices of exportable dynamic items."""
    whole = F.concat_ws(" ", "item", "reason", "suggestion")
    points = open_point(gaps).unionByName(open_point(confirm, "inference"))
    points = points.select(kind_of(F.col("review_type"), whole).alias("kind"), "model", "item", "reason", F.col("suggestion").alias("action"))
    c = lambda n: T.text(F.col(n))
    held = gate.gated(items).where("not exportable").select(first_of([F.col("review_type")], "missing").alias("kind"), first_of([F.col("model")], ALL_MODELS).alias("model"), first_of([gate.joined_questions(), F.col("category")], PENDING).alias("item"), first_of([F.col("export_block_reason")], NOT_FIT).alias("reason"), F.lit(CHECK).alias("action"))
    notices = gate.judged(items).where("exportable_now and knowledge_type = 'dynamic'").select(F.lit("dynamic_notice").alias("kind"), c("model").alias("model"), gate.joined_questions().alias("item"), F.lit(NOTICE).alias("reason"), F.lit(NOTICE_ACTION).alias("action"))
    return points.unionByName(held).unionByName(notices)


def review_counts(rows: DataFrame) -> DataFrame:
    """How many rows need attention by label, and how many notices there are by topic: measure, n."""
    label = F.lit(LABELS["missing"])
    for kind, name in LABELS.items():
        label = F.when(F.col("kind") == kind, name).otherwise(label)
    whole, topic = F.concat_ws(" ", "item", "reason"), F.lit(BENEFITS)
    for name, words in reversed(NOTICE_WORDS.items()):
        topic = F.when(T.has_any(whole, words), name).otherwise(topic)
    return rows.groupBy(F.when(F.col("kind") == "dynamic_notice", topic).otherwise(label).alias("measure")).agg(F.count(F.lit(1)).alias("n"))


def attention_rows(rows: DataFrame) -> DataFrame:
    """The rows that need attention, as they are shown."""
    label = F.lit(LABELS["missing"])
    for kind, name in LABELS.items():
        label = F.when(F.col("kind") == kind, name).otherwise(label)
    return rows.where("kind <> 'dynamic_notice'").select(label.alias("类型"), F.col("model").alias("车型"), F.col("item").alias("问题"), first_of([F.col("action"), F.col("reason")], "").alias("建议"))


def project_info(items: DataFrame) -> DataFrame:
    """One row: brand and model of the first item that has either."""
    found = items.where((T.text(F.col("brand")) != "") | (T.text(F.col("model")) != "")).agg(F.min_by(F.struct("brand", "model"), "ord").alias("f"))
    return found.select(first_of([F.col("f.brand")], UNKNOWN).alias("brand"), first_of([F.col("f.model")], UNKNOWN).alias("model"))


def change_rows(changes: DataFrame) -> DataFrame:
    """Changes (diff_id, change_type, structs o and n) as they are shown: model, question, before, after, category. New
    items lead; added ones have nothing before, unchanged ones only what stays."""
    o, n = (lambda f: T.text(F.col(f"o.{f}"))), (lambda f: T.text(F.col(f"n.{f}")))
    either = lambda f: F.when(F.col("n").isNotNull(), n(f)).otherwise(o(f))
    kind = F.col("change_type")
    before = F.when(kind == "ADDED", "").when((kind == "UNCHANGED") & F.col("o").isNull(), n("answer")).otherwise(o("answer"))
    return changes.select("diff_id", "change_type", either("model").alias("model"), either("question").alias("question"), before.alias("before"), F.when(kind == "UNCHANGED", "").otherwise(n("answer")).alias("after"), either("category").alias("category"))


def auto_added(changes: DataFrame, grouped: DataFrame) -> DataFrame:
    """Reviews of new items without an old one that no group has taken."""
    alone = changes.where("change_type = 'REVIEW_REQUIRED' and o is null and n is not null")
    return alone.join(grouped.select("diff_id").distinct(), "diff_id", "left_anti")


def relation_candidates(reviews: DataFrame, old: DataFrame) -> DataFrame:
    """Old items that reviews may stand in relation with: diff_id, old_id, place.

    reviews: diff_id, new_model (null without a new item), new_intents, old_ids (in order); old: knowledge_id, model,
    intents. A pair needs a related name where there is a new item, and related intents where both have any."""
    named = reviews.select("diff_id", "new_model", "new_intents", F.posexplode(F.array_distinct("old_ids")).alias("place", "old_id"))
    pairs = named.join(old.select(F.col("knowledge_id").alias("old_id"), F.col("model").alias("old_model"), F.col("intents").alias("old_intents")), "old_id")
    names = models.related_models(reviews.select(F.col("new_model").alias("model")).where("model is not null"), old.select("model")).select("new_model", "old_model").withColumn("kin", F.lit(True))
    pairs = pairs.join(names, ["new_model", "old_model"], "left")
    agree = (F.size("old_intents") == 0) | (F.coalesce(F.size("new_intents"), F.lit(0)) <= 0) | T.related(F.col("old_intents"), F.col("new_intents"))
    return pairs.where((F.col("new_model").isNull() | F.coalesce("kin", F.lit(False))) & agree).select("diff_id", "old_id", "place")
