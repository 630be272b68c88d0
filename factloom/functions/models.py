"""Model names and how two of them relate, on the dimension of distinct names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import text

# Brand prefixes and variant suffixes, tried in this order.
BRANDS = ["哈弗", "长城", "魏牌", "坦克"]
VARIANTS = ["燃油版", "PHEV", "插混版", "纯电版", "经典版", "国潮版", "汽油版"]
SHORT = "^[A-Za-z]?[0-9]+[A-Za-z]?$"
ALNUM = "^[A-Za-z0-9]+$"


def with_parts(models: DataFrame, name: str = "model") -> DataFrame:
    """Adds canonical, bare (without brand), family and variant (bare without a variant's word), short."""
    clean = F.regexp_replace(F.replace(F.regexp_replace(text(F.col(name)), r"(?U)\s+", ""), F.lit("＋"), F.lit("+")), "(?i)plus", "PLUS")
    clean = F.regexp_replace(clean, "^新(?=阿维塔)", "")
    out = models.withColumn("canonical", clean)
    out = out.withColumn("bare", F.regexp_replace("canonical", f"^(?:{'|'.join(BRANDS)})(?=.)", ""))
    out = out.withColumn("variant", F.regexp_extract("bare", f"^.+?({'|'.join(VARIANTS)})$", 1))
    return out.withColumn("family", F.expr("left(bare, length(bare) - length(variant))")).withColumn("short", F.col("bare").rlike(SHORT))


def relation(a: str, b: str) -> Column:
    """EXACT, ALIAS, VARIANT, FAMILY, CONFLICT or UNKNOWN of two names with parts, as aliases a and b."""
    l, r = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))  # noqa: E731, E741
    brief = F.when(l("short"), l("bare")).otherwise(r("bare"))
    full = F.when(l("short"), r("bare")).otherwise(l("bare"))

    def prefix(long: Column, stem: Column) -> Column:
        rest = F.substr(long, F.length(stem) + 1)
        return F.when(stem.rlike(ALNUM) & rest.rlike(ALNUM), "CONFLICT").otherwise("FAMILY")

    return (
        F.when((l("canonical") == "") | (r("canonical") == ""), "UNKNOWN")
        .when(l("canonical") == r("canonical"), "EXACT")
        .when(l("bare") == r("bare"), "ALIAS")
        .when((l("short") | r("short")) & (brief != "") & F.endswith(full, brief), "ALIAS")
        .when((l("family") != "") & (l("family") == r("family")), F.when(l("variant") != r("variant"), "VARIANT").otherwise("FAMILY"))
        .when(F.startswith(l("bare"), r("bare")), prefix(l("bare"), r("bare")))
        .when(F.startswith(r("bare"), l("bare")), prefix(r("bare"), l("bare")))
        .otherwise("CONFLICT")
    )


def related_models(new: DataFrame, old: DataFrame) -> DataFrame:
    """Pairs (new_model, old_model, relation) of distinct names that are EXACT, ALIAS, FAMILY or VARIANT.

    Related names share a family, or one bare name begins or ends with the other, so three equi-joins find all pairs
    and no name is compared with every other.
    """
    n, o = (with_parts(d.select(F.col("model")).where("model <> ''").distinct()) for d in (new, old))

    def keys(d: DataFrame) -> DataFrame:
        cut = F.sequence(F.lit(1), F.length("bare"))
        ends = F.transform(cut, lambda i: F.concat(F.lit("<"), F.substr("bare", F.lit(1), i)))
        tails = F.transform(cut, lambda i: F.concat(F.lit(">"), F.substr("bare", i)))
        own = F.array(F.concat(F.lit("="), F.col("family")))
        return d.select("model", "bare", F.explode(F.array_distinct(F.concat(own, ends, tails))).alias("key"))

    def whole(d: DataFrame) -> DataFrame:
        return d.select("model", F.explode(F.array(F.concat(F.lit("="), F.col("family")), F.concat(F.lit("<"), F.col("bare")), F.concat(F.lit(">"), F.col("bare")))).alias("key"))

    pairs = (
        keys(n).select(F.col("model").alias("new_model"), "key").join(whole(o).withColumnRenamed("model", "old_model"), "key")
        .unionByName(whole(n).withColumnRenamed("model", "new_model").join(keys(o).select(F.col("model").alias("old_model"), "key"), "key"))
        .select("new_model", "old_model")
        .distinct()
    )
    both = pairs.join(n.alias("n"), F.col("new_model") == F.col("n.model")).join(o.alias("o"), F.col("old_model") == F.col("o.model"))
    return both.select("new_model", "old_model", relation("n", "o").alias("relation")).where(F.col("relation").isin("EXACT", "ALIAS", "FAMILY", "VARIANT"))
