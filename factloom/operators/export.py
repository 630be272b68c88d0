"""Items between their forms: from generation to knowledge, and from knowledge to the two exported sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import labels
from factloom.functions import text as T
from factloom.functions.speech import answer_aloud
from factloom.operators import gate

# Words that make an item of no kind a dynamic one; the sheets' names and columns.
DYNAMIC_WORDS = ["价格", "售价", "金融", "优惠", "权益", "活动", "政策", "补贴"]
SHEETS = {"static": "车型配置知识库", "dynamic": "价格政策知识库"}
COLUMNS = {"model": "车型", "trim": "版本", "question": "问题", "answer": "回答", "category": "分类"}
MANY_BRANDS = "多品牌"


def exported_kind() -> Column:
    given, whole = T.text(F.col("knowledge_type")), F.concat_ws(" ", *(T.text(F.col(f)) for f in ("category", "module", "answer")))
    return F.when(given.isin("static", "dynamic"), given).when(T.has_any(whole, DYNAMIC_WORDS), "dynamic").otherwise("static")


def rows(items: DataFrame) -> DataFrame:
    """The rows of the exported sheets: kind (static or dynamic), ord, model, trim, question (one a line), answer as it is
    read aloud, category. Items that the gate holds back are absent."""
    good = gate.judged(items).where("exportable_now")
    c = lambda f: T.text(F.col(f))
    return good.select(
        exported_kind().alias("kind"), "ord", c("model").alias("model"), c("trim").alias("trim"), gate.joined_questions("\n").alias("question"), answer_aloud(F.col("answer")).alias("answer"), F.when(c("category") == "", c("module")).otherwise(c("category")).alias("category")
    )


def write(items: DataFrame, path: str) -> None:
    """Both sheets as CSV with their headers, one folder a kind, in order within each file. Nothing is gathered."""
    out = rows(items)
    for kind, name in SHEETS.items():
        sheet = out.where(F.col("kind") == kind).sortWithinPartitions("ord").select(*(F.col(f).alias(n) for f, n in COLUMNS.items()))
        sheet.write.option("header", True).option("escape", '"').csv(f"{path}/{name}")


def project_name(items: DataFrame, by: list[str], other: Column) -> DataFrame:
    """A name for each group of items: brand and model where there is one of each, the brand where models are many, a
    fixed name for many brands, else another."""
    first = lambda f: F.max(F.when(T.text(F.col(f)) != "", F.col(f)))
    many = lambda f: F.count_distinct(F.when(T.text(F.col(f)) != "", F.col(f)))
    known = items.groupBy(*by).agg(first("brand").alias("brand"), first("model").alias("model"), many("brand").alias("brands"), many("model").alias("models"))
    brand, model = labels.clean_name(F.col("brand")), labels.clean_name(F.col("model"))
    both = F.when(F.startswith(model, brand), model).otherwise(F.concat(brand, model))
    name = F.when((F.col("brands") == 1) & (F.col("models") == 1), both).when((F.col("brands") == 1) & (F.col("models") > 1), brand).when(F.col("brands") > 1, MANY_BRANDS).otherwise(labels.clean_name(other))
    return known.select(*by, name.alias("name"))


def knowledge_items(items: DataFrame, source_file: Column | None = None) -> DataFrame:
    """Generated items as knowledge: the first question, the normalised one, the kind and whether to confirm it; an item
    without id gets one from its place and content."""
    c = lambda f: T.text(F.col(f))
    question = gate.first_question()
    own = T.stable_id("RAG", F.col("ord").cast("string"), question, F.col("answer"), F.col("category"))
    given = [F.col("knowledge_id")] if "knowledge_id" in items.columns else []
    return items.select(
        F.coalesce(*(F.nullif(T.text(g), F.lit("")) for g in [*given, F.col("rag_id")]), own).alias("knowledge_id"), "ord", question.alias("question"), T.question_key(question).alias("normalized_question"), c("answer").alias("answer"), c("category").alias("category"), "brand", "model", "trim",
        labels.internal_kind(F.col("knowledge_type"), F.col("category"), F.col("module")).alias("knowledge_type"), "answer_type", labels.says_yes(F.col("need_confirm")).alias("need_confirm"), F.coalesce("fact_refs", F.array().cast("array<string>")).alias("fact_refs"),
        F.filter(F.array(F.lit("") if source_file is None else T.text(source_file)), lambda f: f != "").alias("source_files"),
    )


def as_items(knowledge: DataFrame) -> DataFrame:
    """Knowledge as items to export: price, policy, store, marketing, finance and dynamic ones are dynamic, others static."""
    return knowledge.withColumn("knowledge_type", labels.exported_kind(F.col("knowledge_type")))


def preview(knowledge: DataFrame, limit: int = 50) -> DataFrame:
    """The first items by order, for display."""
    return knowledge.orderBy("ord").limit(limit).select("question", "answer", "category", F.coalesce("model", F.lit("")).alias("model"), F.coalesce("trim", F.lit("")).alias("trim"), F.array_join("source_files", "、").alias("source"))
