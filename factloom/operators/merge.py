"""Review decisions, merging, and duplicates of the merged knowledge base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as T


def default_decision(change_type: Column, old: Column, new: Column) -> Column:
    """What becomes of a change row without a review; null for unchanged rows."""
    accept = (change_type.isin("ADDED", "UPDATED")) | ((change_type == "REVIEW_REQUIRED") & old.isNull() & new.isNotNull())
    return F.when(change_type == "UNCHANGED", None).when(accept, "ACCEPT_NEW").otherwise("KEEP_OLD")


def decided(changes: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Change rows (diff_id, change_type, old_id, new_id) with decision, confirmed and keep_old: the reviewer's, else the default."""
    own = default_decision(F.col("change_type"), F.col("old_id"), F.col("new_id"))
    if decisions is None:
        return changes.withColumns({"decision": own, "confirmed": F.lit(False), "keep_old": F.lit(False)})
    given = decisions.select(F.col("diff_id"), F.col("decision").alias("given"), F.coalesce("confirmed", F.lit(False)).alias("confirmed"), F.coalesce("keep_old", F.lit(False)).alias("keep_old"))
    joined = changes.join(given, "diff_id", "left").withColumns({"confirmed": F.coalesce("confirmed", F.lit(False)), "keep_old": F.coalesce("keep_old", F.lit(False))})
    return joined.withColumn("decision", F.coalesce("given", own)).drop("given")


def merged(rows: DataFrame) -> DataFrame:
    """From decided rows: the kept items in order (diff_id, slot, item_id, effect), 0 to 2 a row."""
    old, new, d = F.col("old_id"), F.col("new_id"), F.col("decision")
    entry = lambda slot, item, effect: F.when(item.isNotNull(), F.struct(F.lit(slot).alias("slot"), item.alias("item_id"), F.lit(effect).alias("effect")))
    keep = F.array(entry(0, old, "kept_old"))
    accepted = F.when(F.col("change_type") == "ADDED", entry(1, new, "added")).when(F.col("change_type") == "UPDATED", entry(1, new, "updated")).otherwise(entry(1, new, "new"))
    both = F.array(F.when(F.col("keep_old") | new.isNull(), entry(0, old, "kept_old")), accepted)
    removed = (d == "REMOVE") & F.col("confirmed")
    out = (
        F.when(F.col("change_type") == "UNCHANGED", F.when(F.coalesce(removed, F.lit(False)), F.filter(keep, lambda x: F.lit(False))).otherwise(keep))
        .when(removed | (d == "SKIP"), F.filter(keep, lambda x: F.lit(False)))
        .when(d == "ACCEPT_NEW", both)
        .otherwise(keep)
    )
    return rows.select("diff_id", F.explode(F.filter(out, lambda x: x.isNotNull())).alias("e")).select("diff_id", "e.*")


def counters(rows: DataFrame, items: DataFrame) -> DataFrame:
    """One row: added_accepted, updated_accepted, kept_old, removed, skipped."""
    kept = items.agg(*(F.count_if(F.col("effect") == e).alias(name) for e, name in (("added", "added_accepted"), ("updated", "updated_accepted"), ("kept_old", "kept_old"))))
    gone = rows.agg(F.count_if((F.col("decision") == "REMOVE") & F.col("confirmed")).alias("removed"), F.count_if((F.col("decision") == "SKIP") & (F.col("change_type") != "UNCHANGED")).alias("skipped"))
    return kept.crossJoin(gone)


def duplicate_warnings(items: DataFrame) -> DataFrame:
    """Items whose model, question key and category repeat an earlier item's: first_id, knowledge_id, warning_type."""
    keys = [F.trim(F.coalesce("model", F.lit(""))), T.question_key(F.col("question")), F.trim(F.coalesce("category", F.lit("")))]
    order = Window.partitionBy(*keys).orderBy("ord")
    first = items.where((keys[0] != "") | (keys[1] != "") | (keys[2] != "")).select(
        "knowledge_id", F.first("knowledge_id").over(order).alias("first_id"), F.when(F.first("answer").over(order).eqNullSafe(F.col("answer")), "duplicate_exact").otherwise("duplicate_possible").alias("warning_type"), F.row_number().over(order).alias("n")
    )
    return first.where("n > 1").drop("n")


def duplicate_key(keys: list[str]) -> Column:
    """A digest of the squeezed keys; null and empty are one."""
    return F.sha2(F.to_json(F.array(*(T.squeezed(F.col(k)) for k in keys))), 256)


def without_duplicates(items: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """The first item, by ord, of each group of equal keys. Only digests and orders are shuffled, reduced before; items are
    then chosen by their order, so copies that share an id do not stay together."""
    first = items.groupBy(duplicate_key(keys).alias("dup_key")).agg(F.min("ord").alias("ord")).select("ord")
    return items.join(first, "ord", "left_semi").select(*items.columns)


def duplicate_groups(items: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """Each group of equal items: kept_id and how many were removed."""
    groups = items.groupBy(duplicate_key(keys).alias("dup_key")).agg(F.min_by(id_col, "ord").alias("kept_id"), (F.count(F.lit(1)) - 1).alias("removed"))
    return groups.where("removed > 0").select("kept_id", "removed")
