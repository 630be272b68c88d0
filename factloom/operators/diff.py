"""Snapshot diff: what a new knowledge base changes in an old one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import match
from factloom.operators.lineage import settled

# Confidence of each change.
UNCHANGED, UPDATED, ADDED, REVIEW = 0.96, 0.9, 0.9, 0.62


def combined(a: Column, b: Column) -> Column:
    return F.when((a <= 0) | (b <= 0), 0.0).otherwise(F.round(F.least(a, b), 4))


def ended(question: Column, answer: Column) -> Column:
    return T.has_any(F.concat_ws(" ", question, answer), T.DEPRECATED)


def changed(pairs: DataFrame) -> DataFrame:
    """For pairs of structs o and n: change_type, reason_code, change_confidence, changed_fields."""
    o, n = (lambda x: F.col(f"o.{x}")), (lambda x: F.col(f"n.{x}"))
    missing = (o("question") == "") | (o("answer") == "") | (n("question") == "") | (n("answer") == "")
    flag = o("need_confirm") != n("need_confirm")
    same = (o("a") == n("a")) & ~flag
    other_numbers = o("numbers") != n("numbers")
    priced = T.has_any(F.concat(o("question"), n("question"), o("category"), n("category")), T.PRICE_WORDS)
    reworded = F.when(o("q") != n("q"), F.lit("question"))
    fields = F.array(F.lit("answer"), reworded, F.when(other_numbers, F.lit("number")), F.when(other_numbers & priced, F.lit("price")), F.when(flag, F.lit("need_confirm")))
    over = ended(n("question"), n("answer"))
    return pairs.withColumns(
        {
            "change_type": F.when(missing | over, "REVIEW_REQUIRED").when(same, "UNCHANGED").otherwise("UPDATED"),
            "reason_code": F.when(missing, "MISSING_REQUIRED_FIELD").when(over, "POSSIBLE_DEPRECATED").when(same, "UNCHANGED").when(other_numbers & priced, "PRICE_CHANGED").when(other_numbers, "NUMBER_CHANGED").otherwise("ANSWER_CHANGED"),
            "change_confidence": F.when(missing | over, REVIEW).when(same, UNCHANGED).otherwise(UPDATED),
            "changed_fields": F.when(missing, F.array().cast("array<string>")).when(over, F.array(F.lit("answer"))).otherwise(F.filter(F.when(same, F.array(reworded)).otherwise(fields), lambda x: x.isNotNull())),
        }
    )


SCOPE = ("brand", "model", "trim", "category", "knowledge_type", "source_file")


def update_scope(new: DataFrame, old: DataFrame) -> DataFrame:
    """One row: sorted distinct values of each dimension, confidence, and old categories that the new items leave out."""
    values = [F.array_sort(F.filter(F.collect_set(F.trim(F.coalesce(F.col(c), F.lit("")))), lambda x: x != "")).alias(c) for c in SCOPE]
    row = new.agg(F.count(F.lit(1)).alias("n"), *values).crossJoin(old.agg(F.array_sort(F.filter(F.collect_set(F.trim(F.coalesce("category", F.lit("")))), lambda x: x != "")).alias("old_categories")))
    known = sum((F.when(F.size(c) > 0, 1).otherwise(0) for c in ("brand", "model", "category", "knowledge_type", "source_file")), F.lit(0))
    return row.select(*SCOPE, F.when(F.col("n") == 0, 0.0).otherwise(F.least(F.lit(0.95), F.lit(0.45) + known * 0.1)).alias("confidence"), F.array_except("old_categories", "category").alias("not_obvious_categories"))


def in_scope(old: DataFrame, new: DataFrame) -> DataFrame:
    """The old items with in_scope: their model is new too (or blank on either side), and their category or type is."""
    seen = lambda c: new.where(F.coalesce(F.col(c), F.lit("")) != "").select(F.col(c).alias(f"seen_{c}")).distinct()
    any_model = new.where("model <> ''").limit(1).agg((F.count(F.lit(1)) > 0).alias("any_model"))
    out = old
    for c in ("model", "category", "knowledge_type"):
        out = out.join(seen(c), (F.col(c) == F.col(f"seen_{c}")), "left")
    out = out.crossJoin(F.broadcast(any_model))
    elsewhere = F.col("any_model") & (F.col("model") != "") & F.col("seen_model").isNull()
    return out.withColumn("in_scope", ~elsewhere & (F.col("seen_category").isNotNull() | F.col("seen_knowledge_type").isNotNull())).drop("seen_model", "seen_category", "seen_knowledge_type", "any_model")


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """All change rows: new items in order, then old items that none consumed. Columns side (0 new, 1 old), ord, new_id,
    old_id, change_type, reason_code, match_method, match_confidence, change_confidence, overall_confidence,
    changed_fields, candidate_ids.

    With old items and no new ones there is one row without items, as the reference has it.
    """
    if new.limit(1).count() == 0 and old.limit(1).count() > 0:
        empty = "0 AS side, CAST(0 AS BIGINT) AS ord, CAST(NULL AS STRING) AS new_id, CAST(NULL AS STRING) AS old_id, 'REVIEW_REQUIRED' AS change_type, 'NO_NEW_KNOWLEDGE' AS reason_code, 'UNMATCHED' AS match_method"
        return old.sparkSession.sql(f"SELECT {empty}, {match.REVIEW}D AS match_confidence, {REVIEW}D AS change_confidence, {REVIEW}D AS overall_confidence, CAST(array() AS ARRAY<STRING>) AS changed_fields, '' AS candidate_ids")
    n, o = settled(match.normalized(new)), settled(match.normalized(old))
    whole = n.where("question <> '' and answer <> ''")
    found = match.scored(match.candidates(whole, o))
    parts = match.model_groups(match.related_models(whole, o))
    assigned = settled(match.assign(found, parts))
    pairs = changed(assigned.where("outcome = 'MATCHED'").join(n.select(F.struct("*").alias("n")), F.col("new_id") == F.col("n.knowledge_id")).join(o.select(F.struct("*").alias("o")), F.col("old_id") == F.col("o.knowledge_id")))
    none = F.array().cast("array<string>")

    def row(side, ord_, new_id, old_id, kind, reason, method, sure, change, fields=none, ids=F.lit("")):
        overall = combined(sure, change) if not isinstance(change, float) else combined(sure, F.lit(change))
        change = F.lit(change) if isinstance(change, float) else change
        return [F.lit(side).alias("side"), ord_.alias("ord"), new_id.alias("new_id"), old_id.alias("old_id"), kind.alias("change_type"), reason.alias("reason_code"), method.alias("match_method"), sure.cast("double").alias("match_confidence"), change.alias("change_confidence"), overall.alias("overall_confidence"), fields.alias("changed_fields"), ids.alias("candidate_ids")]

    nothing = F.lit(None).cast("string")
    matched = pairs.select(*row(0, F.col("n.ord"), F.col("new_id"), F.col("old_id"), F.col("change_type"), F.col("reason_code"), F.col("method"), F.col("score"), F.col("change_confidence"), F.col("changed_fields")))
    c = F.col
    unclear = assigned.where("outcome = 'AMBIGUOUS'").join(n, c("new_id") == c("knowledge_id")).select(*row(0, c("ord"), c("new_id"), nothing, F.lit("REVIEW_REQUIRED"), c("reason"), F.lit("AMBIGUOUS"), F.lit(match.REVIEW), F.lit(REVIEW), ids=c("candidate_ids")))
    added_rows = row(0, c("ord"), c("knowledge_id"), nothing, F.lit("ADDED"), F.lit("NEW_KNOWLEDGE"), F.lit("UNMATCHED"), F.lit(0.0), F.lit(ADDED))
    added_rows[9] = F.lit(ADDED).alias("overall_confidence")
    added = whole.join(assigned.select("new_id"), c("knowledge_id") == c("new_id"), "left_anti").select(*added_rows)
    lacking = n.where("question = '' or answer = ''").select(*row(0, c("ord"), c("knowledge_id"), nothing, F.lit("REVIEW_REQUIRED"), F.lit("MISSING_REQUIRED_FIELD"), F.lit("UNMATCHED"), F.lit(match.REVIEW), F.lit(REVIEW)))
    rest = in_scope(o.join(assigned.where("old_id is not null").select("old_id"), c("knowledge_id") == c("old_id"), "left_anti"), new)
    state = F.when((c("question") == "") | (c("answer") == ""), "MISSING_REQUIRED_FIELD").when(ended(c("question"), c("answer")), "POSSIBLE_DEPRECATED").when(c("in_scope"), "OLD_IN_SCOPE_UNMATCHED").otherwise("OLD_NOT_IN_SCOPE")
    calm = state == "OLD_NOT_IN_SCOPE"
    swept = rest.select(*row(1, c("ord"), nothing, c("knowledge_id"), F.when(calm, "UNCHANGED").otherwise("REVIEW_REQUIRED"), state, F.lit("UNMATCHED"), F.when(calm, F.lit(0.0)).otherwise(F.lit(match.REVIEW)), F.when(calm, F.lit(UNCHANGED)).otherwise(F.lit(REVIEW))))
    return matched.unionAll(unclear).unionAll(added).unionAll(lacking).unionAll(swept)


def numbered(rows: DataFrame) -> DataFrame:
    """Adds diff_id by position (new items first). For the finished, reported result: one ordered pass."""
    return rows.withColumn("diff_id", F.format_string("DIFF-%04d", F.row_number().over(Window.orderBy("side", "ord"))))


def summary(rows: DataFrame) -> DataFrame:
    kinds = ("ADDED", "UPDATED", "UNCHANGED", "REVIEW_REQUIRED")
    return rows.agg(F.count(F.lit(1)).alias("total_count"), *(F.count_if(F.col("change_type") == k).alias(f"{k.lower()}_count") for k in kinds))
