"""How far facts and answers cover source records, and what is still open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.functions.prices import ratio

# Intents of dynamic fields and the words by which facts and answers show them; empty field values.
DYNAMIC_WORDS = {
    "cash": ["现金", "现金礼", "现金优惠", "现金补贴", "购车补贴", "直降", "优惠", "购车优惠", "抵扣车款"],
    "trade_in": ["置换", "增换购", "旧车", "换购补贴", "置换补贴"],
    "finance": ["金融", "贷款", "分期", "免息", "低息", "首付", "月供", "0息", "0首付"],
    "benefit": ["权益", "礼包", "赠送", "服务", "充电权益", "保养", "流量", "道路救援", "质保", "保修"],
    "activity": ["活动", "限时", "截止", "政策", "试驾", "预约", "抽奖", "8月", "12月31日"],
}
EMPTY_VALUES = ["", "-", "/", "无数据"]


def shows(text: Column, intent: Column) -> Column:
    """Whether a text has a word of an intent."""
    out = F.lit(False)
    for name, words in DYNAMIC_WORDS.items():
        out = F.when(intent == name, T.has_any(text, words)).otherwise(out)
    return out


def dynamic_coverage(records: DataFrame, facts: DataFrame, answers: DataFrame) -> DataFrame:
    """By intent: records whose source has it, of these with a fact that shows it, and with an answer to such a fact.

    records: record and one column an intent; facts: record, fact_id, content; answers: fact_id, answer (exportable ones).
    """
    fields = records.select("record", F.explode(F.array(*(F.struct(F.lit(i).alias("intent"), F.trim(T.text(F.col(i))).alias("value")) for i in DYNAMIC_WORDS))).alias("f")).select("record", "f.*")
    wanted = fields.where(~F.col("value").isin(EMPTY_VALUES)).select("record", "intent")
    shown = wanted.join(facts, "record").where(shows(F.col("content"), F.col("intent"))).select("record", "intent", "fact_id").distinct()
    told = shown.join(answers, "fact_id").where(shows(F.col("answer"), F.col("intent"))).select("record", "intent").distinct().withColumn("told", F.lit(1))
    seen = shown.select("record", "intent").distinct().withColumn("seen", F.lit(1))
    out = wanted.join(seen, ["record", "intent"], "left").join(told, ["record", "intent"], "left").groupBy("intent").agg(F.count(F.lit(1)).alias("source"), F.count("seen").alias("fact"), F.count("told").alias("answerable"))
    return out.withColumn("ratio", ratio(F.col("answerable"), F.col("source")))


def range_guard(overviews: DataFrame, facts: DataFrame) -> DataFrame:
    """Overview items (rag_id, model, answer, refs) that miss an endpoint: the model's least or greatest price unnamed in the
    answer, or a fact at an endpoint uncited. facts: model, fact_id, price. Models with one price need no range."""
    ends = facts.groupBy("model").agg(F.min("price").alias("low"), F.max("price").alias("high")).where("low < high")
    cited = facts.join(ends, "model").where((F.col("price") == F.col("low")) | (F.col("price") == F.col("high"))).select("model", "fact_id")
    missed = overviews.join(ends, "model").select("rag_id", "model", "refs", (~F.contains("answer", F.col("low").cast("string")) | ~F.contains("answer", F.col("high").cast("string"))).alias("unnamed"))
    # Cited endpoint facts are counted and taken from all: a model may have very many items and facts at one price.
    refs = missed.select("rag_id", "model", F.explode("refs").alias("fact_id")).distinct()
    hits = refs.join(cited, ["model", "fact_id"]).groupBy("rag_id").agg(F.count(F.lit(1)).alias("hits"))
    found = missed.join(cited.groupBy("model").agg(F.count(F.lit(1)).alias("ends")), "model").join(hits, "rag_id", "left")
    return found.withColumn("uncited", F.col("ends") - F.coalesce("hits", F.lit(0))).where("unnamed or uncited > 0").select("rag_id", "unnamed", "uncited")


def filled_from_facts(items: DataFrame, facts: DataFrame) -> DataFrame:
    """Items (rag_id, category, refs) with what their facts say: dynamic if any fact is, the first fact's category if theirs is blank."""
    refs = items.select("rag_id", F.posexplode("refs").alias("pos", "fact_id")).join(facts.select("fact_id", F.col("category").alias("fact_category"), "knowledge_type"), "fact_id")
    known = refs.groupBy("rag_id").agg(F.bool_or(F.col("knowledge_type") == "dynamic").alias("dynamic"), F.min_by("fact_category", F.when(F.col("fact_category") != "", F.col("pos"))).alias("first"))
    out = items.join(known, "rag_id", "left")
    return out.select("rag_id", F.when(T.text(F.col("category")) == "", F.coalesce("first", F.lit(""))).otherwise(F.col("category")).alias("category"), F.when(F.coalesce("dynamic", F.lit(False)), "dynamic").otherwise("static").alias("knowledge_type"))


def open_gaps(gaps: DataFrame, covered: DataFrame) -> DataFrame:
    """Gaps (gap_id, model, category) that no covered (model, category) answers; gaps without a model need only the category."""
    named = gaps.where("model <> ''").join(covered.select("model", "category").distinct(), ["model", "category"], "left_anti")
    general = gaps.where("model = ''").join(covered.select("category").distinct(), "category", "left_anti")
    return named.select("gap_id").unionByName(general.select("gap_id"))


def version_alias(a: Column, b: Column) -> Column:
    """Equal version labels, or one within the other without model years; bare codes never match by containment."""
    left, right = T.plain(a), T.plain(b)
    bare = lambda c: F.regexp_replace(c, r"20\d{2}款|款", "")
    x, y = bare(left), bare(right)
    inside = (F.length(x) >= 2) & (F.length(y) >= 2) & ~x.rlike("^[a-z0-9]+$") & ~y.rlike("^[a-z0-9]+$") & (F.contains(x, y) | F.contains(y, x))
    return (left != "") & (right != "") & ((left == right) | inside)


# Coverage that a release needs.
PRICE_GATE, DYNAMIC_GATE = 0.95, 0.9


def coverage_report(rows: DataFrame, legacy: DataFrame) -> DataFrame:
    """By measure (price or an intent): covered, total, coverage, missing, how many the earlier report lacked, and whether a
    release may go ahead. rows: measure, covered, total; legacy: measure, covered."""
    before = legacy.select("measure", F.col("covered").alias("earlier"))
    joined = rows.join(before, "measure", "left").withColumn("coverage", ratio(F.col("covered"), F.col("total")))
    needed = F.when(F.col("measure") == "price", PRICE_GATE).otherwise(DYNAMIC_GATE)
    fixed = F.greatest(F.lit(0).cast("long"), F.col("covered") - F.coalesce("earlier", F.lit(0).cast("long")))
    return joined.select("measure", "covered", "total", "coverage", (F.col("total") - F.col("covered")).alias("missing"), fixed.alias("fixed"), (F.col("coverage") >= needed).alias("passes"))
