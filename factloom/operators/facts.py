"""Grouping, packing and deduplication of extracted facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as T

# Categories whose dynamic facts keep their trim in the group key.
VERSION_WORDS = ["价格", "优惠", "金融", "置换", "补贴"]
MAX_PACKED = 30


def fact_key(c: Column) -> Column:
    """Half width, lower case, without white space and punctuation: 12.98 and 1298 are one."""
    return F.regexp_replace(T.plain(c), r"[\s,.，。!！?？:：;；、'\"“”‘’()（）\[\]【】\-_/\\|]", "")


def distinct_facts(facts: DataFrame, scope: list[Column] | None = None) -> DataFrame:
    """The first fact (by ord) of each normalised category and content, within a scope if one is given, with its number."""
    key = F.unhex(F.md5(F.to_json(F.array(*(scope or []), fact_key(F.col("category")), fact_key(F.col("content")))).cast("binary")))
    first = facts.groupBy(key.alias("key")).agg(F.min(F.struct("ord", *(c for c in facts.columns if c != "ord"))).alias("f"))
    return first.select("f.*")


def renumbered(rows: DataFrame, prefix: str, order: str = "ord", width: int = 3) -> DataFrame:
    """Adds number and its label by global order. Two passes: ranks inside key ranges, then the ranges' offsets."""
    spark_rows = rows.withColumn("range", F.floor(F.col(order) / 100_000))
    sizes = spark_rows.groupBy("range").count()
    before = sizes.select("range", (F.sum("count").over(Window.orderBy("range")) - F.col("count")).alias("before"))
    inner = F.row_number().over(Window.partitionBy("range").orderBy(order))
    return spark_rows.join(before, "range").withColumn("number", F.col("before") + inner).withColumn("label", F.format_string(f"{prefix}%0{width}d", "number")).drop("range", "before")


def group_key() -> list[Column]:
    specific = (F.col("knowledge_type") == "dynamic") & T.has_any(F.col("category"), VERSION_WORDS)
    return [F.col("brand"), F.col("model"), F.when(specific, F.col("trim")).otherwise("").alias("group_trim"), F.col("category"), F.col("knowledge_type")]


def fact_groups(facts: DataFrame) -> DataFrame:
    """Groups of facts that are answered together: size and the first fact's ord."""
    return facts.groupBy(*group_key()).agg(F.count(F.lit(1)).alias("size"), F.min("ord").alias("first_ord"), F.count_distinct("trim").alias("trims"))


def aggregation_hints(facts: DataFrame) -> DataFrame:
    """The groups with repeats: whether some content stands in them for more than one trim."""
    keys = group_key()
    names = ["brand", "model", "group_trim", "category", "knowledge_type"]
    contents = facts.groupBy(*keys, "content").agg(F.count_distinct("trim").alias("n"))
    return contents.groupBy(*names).agg(F.max(F.col("n") > 1).alias("repeats"), F.count(F.lit(1)).alias("contents"))


def packed(groups: DataFrame, by: str, size: str, order: str, limit: int = MAX_PACKED) -> DataFrame:
    """Neighbouring groups put into packs of at most limit rows within each ``by``; a larger group is a pack of its own.
    Columns: by, order, size, pack (from 0). One ordered array for each ``by``, folded on the JVM."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).alias("s"))))
    start = F.struct(F.lit(-1).alias("pack"), F.lit(0).cast("long").alias("held"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        fits = (acc["pack"] >= 0) & (acc["held"] + r["s"] <= limit)
        pack = F.when(fits, acc["pack"]).otherwise(acc["pack"] + 1)
        return F.struct(pack.alias("pack"), F.when(fits, acc["held"] + r["s"]).otherwise(r["s"]).cast("long").alias("held"), F.array_append(acc["out"], pack).alias("out"))

    folded = groups.groupBy(by).agg(rows.alias("rows")).withColumn("packs", F.aggregate("rows", start, step)["out"])
    return folded.select(by, F.explode(F.arrays_zip("rows", "packs")).alias("z")).select(by, F.col("z.rows.o").alias(order), F.col("z.rows.s").alias(size), F.col("z.packs").alias("pack"))


def price_stats(facts: DataFrame, price: str = "price") -> DataFrame:
    """Least and greatest price of each model, and how many facts state them."""
    ends = facts.groupBy("model").agg(F.min(price).alias("low"), F.max(price).alias("high"))
    at = facts.join(ends, "model")
    return at.groupBy("model", "low", "high").agg(F.count_if(F.col(price) == F.col("low")).alias("at_low"), F.count_if(F.col(price) == F.col("high")).alias("at_high"))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
