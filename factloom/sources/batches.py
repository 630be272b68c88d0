"""Records of a document in batches, and how far facts cover them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import half_width, has_any

# Records and characters of a batch.
BATCH_RECORDS, BATCH_CHARS = 3, 12_000
# Words that show an intent in a fact; values that say nothing.
INTENT_WORDS = {
    "cash": ["现金", "直降", "购车优惠"],
    "trade_in": ["置换", "增换购", "旧车"],
    "finance": ["金融", "贷款", "分期", "免息", "首付", "月供"],
    "benefit": ["权益", "礼包", "赠送", "服务", "充电权益", "保养"],
    "activity": ["活动", "限时", "截止", "政策"],
}
NOTHING = ["", "-", "无", "暂无", "none", "null"]
GAP = 2  # two line breaks part records, and context from the first


def record_batches(records: DataFrame, context: Column, size: int = BATCH_RECORDS, max_chars: int = BATCH_CHARS) -> DataFrame:
    """From records (doc_id, place, chars): record (from 1) and batch (from 0) of each. A batch holds at most size records
    and max_chars characters with the context that leads it; a record that alone exceeds them is a batch of its own.

    A document's records are folded in order, so its number of records bounds a row."""
    lead = F.when(context > 0, context + GAP).otherwise(0)
    listed = records.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "chars"))).alias("all"))
    start = F.struct(F.lit(-1).alias("batch"), F.lit(0).alias("held"), F.lit(0).alias("chars"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        alone = lead + r["chars"] > max_chars
        new = alone | (acc["held"] == 0) | (acc["held"] >= size) | (acc["chars"] + GAP + r["chars"] > max_chars)
        batch = acc["batch"] + new.cast("int")
        return F.struct(
            batch.alias("batch"),
            F.when(alone, 0).when(new, 1).otherwise(acc["held"] + 1).alias("held"),
            F.when(alone, 0).when(new, lead + r["chars"]).otherwise(acc["chars"] + GAP + r["chars"]).cast("int").alias("chars"),
            F.array_append(acc["out"], batch).alias("out"),
        )

    dealt = listed.withColumn("batches", F.aggregate("all", start, step)["out"])
    return dealt.select("doc_id", F.posexplode(F.arrays_zip("all", "batches")).alias("k", "r")).select("doc_id", (F.col("k") + 1).alias("record"), "r.all.place", F.col("r.batches").alias("batch"))


def record_coverage(records: DataFrame, facts: DataFrame) -> DataFrame:
    """How many records (record, series, one column an intent) have facts (record, content): measure (vehicle, series and
    each intent that the source speaks of), covered, total."""
    plain = lambda x: F.lower(F.regexp_replace(half_width(x), r"(?U)\s+", ""))
    shown = facts.groupBy("record").agg(*(F.bool_or(has_any(F.col("content"), words)).alias(f"has_{i}") for i, words in INTENT_WORDS.items()))
    rows = records.join(shown.withColumn("found", F.lit(True)), "record", "left")
    one = lambda name, wanted, covered: F.struct(F.lit(name).alias("measure"), F.count_if(wanted & covered).alias("covered"), F.count_if(wanted).alias("total"))
    found = F.coalesce("found", F.lit(False))
    parts = [one("vehicle", F.lit(True), found)]
    parts += [one(i, ~plain(F.col(i)).isin(NOTHING), F.coalesce(F.col(f"has_{i}"), F.lit(False))) for i in INTENT_WORDS]
    series = F.when(plain(F.col("series")) != "", plain(F.col("series")))
    parts.append(F.struct(F.lit("series").alias("measure"), F.count_distinct(F.when(found, series)).alias("covered"), F.count_distinct(series).alias("total")))
    return rows.agg(F.array(*parts).alias("all")).select(F.explode("all").alias("m")).select("m.*")


def uncovered(records: DataFrame, facts: DataFrame, intent: str) -> DataFrame:
    """Records whose source speaks of an intent that none of their facts shows."""
    plain = F.lower(F.regexp_replace(half_width(F.col(intent)), r"(?U)\s+", ""))
    shown = facts.where(has_any(F.col("content"), INTENT_WORDS[intent])).select("record").distinct()
    return records.where(~plain.isin(NOTHING)).join(shown, "record", "left_anti").select("record")
