"""Deduplication variants, grounding, linkage, relation groups and similarity audits."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators.lineage import settled

ANSWER_PREFIX = 80
#: Links between reviews and old items that one task follows in order.
SMALL = 10_000


def rag_deduplicated(items: DataFrame) -> DataFrame:
    """Items of equal model, category, question and answer start become one: the first's id, all trims and references in order."""
    keys = [F.col("model"), F.col("category"), T.question_key(F.col("question")).alias("q"), F.substr(T.question_key(F.col("answer")), F.lit(1), F.lit(ANSWER_PREFIX)).alias("a")]
    rows = F.array_sort(F.collect_list(F.struct("ord", "rag_id", "trim")))
    out = items.groupBy(*keys).agg(rows.alias("rows"))
    return out.select(F.col("rows")[0]["rag_id"].alias("rag_id"), F.array_join(F.array_distinct("rows.trim"), "、").alias("trims"), F.size("rows").cast("long").alias("members"))


def restore_deduplicated(items: DataFrame) -> DataFrame:
    """Repeats of a question (same model, trim, category) with the first's answer go; others stay, flagged, after the rest."""
    key = [F.col(c) for c in ("model", "trim", "category")] + [T.question_key(F.col("question"))]
    first = F.first("answer").over(Window.partitionBy(*key).orderBy("ord"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("ord"))
    marked = items.withColumns({"place": place, "same": T.squeezed(first) == T.squeezed(F.col("answer"))})
    return marked.where("place = 1 or not same").withColumn("uncertain", F.col("place") > 1).drop("place", "same")


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key, found by aggregation."""
    return rows.groupBy(*keys).agg(F.min(F.struct(order, *(c for c in rows.columns if c not in keys and c != order))).alias("r")).select(*keys, "r.*")


def ungrounded(facts: DataFrame, material: DataFrame, key: str) -> DataFrame:
    """The facts with a number that their material lacks: columns of facts and missing (the numbers, in order)."""
    numbers = F.array_distinct(F.regexp_extract_all("content", F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)))
    joined = facts.join(material.select(key, F.col("text").alias("material")), key, "left")
    missing = F.filter(numbers, lambda n: ~F.coalesce(F.contains("material", n), F.lit(False)))
    return joined.withColumn("missing", missing).where(F.size("missing") > 0).drop("material")


def linked_by_price(records: DataFrame, facts: DataFrame, batch: str) -> DataFrame:
    """Facts linked to the only record of their batch that has the fact's price; prices of several records are not guessed."""
    only = records.groupBy(batch, "price").agg(F.count(F.lit(1)).alias("n"), F.min("record").alias("record")).where("n = 1")
    return facts.join(only.select(batch, "price", "record"), [batch, "price"])


def relation_groups(candidates: DataFrame, small: int = SMALL) -> DataFrame:
    """Groups of reviews that share old items. candidates: review_ord, diff_id, reason, old_id, old_place.

    Reviews of several old items by MANY_TO_ONE stand alone; then each old item, in order of first mention, takes its
    reviews that no earlier one took, if two or more are left; what remains stands alone. Columns: group_id, diff_id.

    One component of the review/old-item graph may hold nearly all rows, so the order is followed without gathering one:
    a review is surely free for its first old item still open. An old item with two such reviews takes what reaches it,
    one that fewer than two can reach takes nothing and its reviews go on to their next. The first open item is always
    decided, so rounds end; the last ``small`` links are followed one by one in one task.
    """
    listed = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("old_place", "old_id"))), lambda x: x["old_id"]))
    reviews = settled(candidates.groupBy("review_ord", "diff_id").agg(F.min_by("reason", F.struct("old_place", "old_id")).alias("reason"), listed.alias("olds")))
    alone = (F.col("reason") == "MANY_TO_ONE") & (F.size("olds") > 1)
    links = reviews.where(~F.coalesce(alone, F.lit(False))).select("review_ord", "diff_id", F.posexplode("olds").alias("place", "old_id"))
    first = links.groupBy("old_id").agg(F.min(F.struct("review_ord", "diff_id", "place")).alias("turn"))
    live = settled(links.join(first, "old_id").select("diff_id", "old_id", "turn", F.lit(False).alias("takes")))
    taken = None
    while (count := live.count()) > small:
        head = F.col("turn") == F.min("turn").over(Window.partitionBy("diff_id"))
        led = live.withColumn("head", head)
        reach = led.groupBy("old_id").agg((F.bool_or("takes") | (F.count_if("head") > 1)).alias("now"), (F.count(F.lit(1)) > 1).alias("may"))
        led = led.drop("takes").join(reach, "old_id").withColumn("goes", F.max(F.col("head") & F.col("now")).over(Window.partitionBy("diff_id")))
        led = settled(led.where("now or may"))
        now = led.where("head and goes").select(F.concat(F.lit("REL-"), "old_id").alias("group_id"), "diff_id")
        taken = now if taken is None else taken.unionAll(now)
        live = led.where("not goes").select("diff_id", "old_id", "turn", F.col("now").alias("takes"))
    if count:

        def follow(rows: pd.DataFrame) -> pd.DataFrame:
            out, gone = [], set()
            for _, own in rows.groupby(["review_ord", "first_id", "place"], sort=True):
                free = [d for d in own["diff_id"] if d not in gone]
                if len(free) > 1 or own["takes"].iloc[0]:
                    out += [(f"REL-{own['old_id'].iloc[0]}", d) for d in free]
                    gone.update(free)
            return pd.DataFrame(out, columns=["group_id", "diff_id"])

        rest = live.select("diff_id", "old_id", "takes", "turn.review_ord", F.col("turn.diff_id").alias("first_id"), "turn.place", F.lit(0).alias("one"))
        now = settled(rest.groupBy("one").applyInPandas(follow, "group_id string, diff_id string"))
        taken = now if taken is None else taken.unionAll(now)
    single = reviews if taken is None else reviews.join(taken, "diff_id", "left_anti")
    single = single.select(F.concat(F.lit("REL-"), "diff_id").alias("group_id"), "diff_id")
    return single if taken is None else taken.unionAll(single)


def expanded_decisions(groups: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Decisions of the groups' reviews: diff_id, decision, confirmed, keep_old. Without a choice new items come in and old ones stay."""
    given = groups if chosen is None else groups.join(chosen, "group_id", "left")
    choice = F.lit("ADD_NEW_KEEP_OLD") if chosen is None else F.coalesce("choice", F.lit("ADD_NEW_KEEP_OLD"))
    return given.select("diff_id", F.when(choice == "KEEP_OLD_ONLY", "SKIP").otherwise("ACCEPT_NEW").alias("decision"), F.lit(False).alias("confirmed"), (choice == "ADD_NEW_KEEP_OLD").alias("keep_old"))


def relation_decisions(groups: DataFrame, choices: DataFrame) -> DataFrame:
    """Decisions of the members of relation groups: diff_id, decision, keep_old, confirmed.

    groups: group_id, group_ord, diff_id, is_new (a new item's review; else an old item's row), change_type, item_id.
    choices: group_id, choice, confirmed, selected (ids kept by CUSTOM; null: none). Without a choice new items come in
    beside the old. Old rows are decided only if unchanged or under review; of several groups of a row the last counts."""
    rows = groups.join(choices, "group_id", "left").where("is_new or change_type in ('UNCHANGED', 'REVIEW_REQUIRED')")
    choice = F.coalesce("choice", F.lit("ADD_NEW_KEEP_OLD"))
    picked = F.coalesce(F.array_contains("selected", F.col("item_id")), F.lit(False))
    custom, new = choice == "CUSTOM", F.col("is_new")
    of_new = F.when((choice == "KEEP_OLD_ONLY") | (custom & ~picked), "SKIP").otherwise("ACCEPT_NEW")
    of_old = F.when((choice == "REPLACE_OLD_WITH_NEW") | (custom & ~picked), "REMOVE").otherwise("KEEP_OLD")
    keep = new & ((choice == "ADD_NEW_KEEP_OLD") | (custom & picked))
    sure = ~new & F.coalesce("confirmed", F.lit(False)) & (of_old == "REMOVE")
    decided = rows.select("diff_id", "group_ord", "group_id", F.struct(F.when(new, of_new).otherwise(of_old).alias("decision"), keep.alias("keep_old"), sure.alias("confirmed")).alias("d"))
    return decided.groupBy("diff_id").agg(F.max_by("d", F.struct("group_ord", "group_id")).alias("d")).select("diff_id", "d.*")


def shared_tokens(left: DataFrame, right: DataFrame, left_id: str, right_id: str, k: int) -> DataFrame:
    """For each left text the k right texts of greatest token Jaccard similarity. Texts meet over common tokens, counted by
    equi-join; tokens are counted before, so no text is compared with one that shares nothing."""
    tokens = lambda d, i: d.select(F.col(i), F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 2))).alias("w"))
    a, b = tokens(left, left_id), tokens(right, right_id)
    sizes = lambda d, i, n: d.groupBy(i).agg(F.count(F.lit(1)).alias(n))
    common = a.join(b, "w").groupBy(left_id, right_id).agg(F.count(F.lit(1)).alias("both"))
    scored = common.join(sizes(a, left_id, "na"), left_id).join(sizes(b, right_id, "nb"), right_id)
    scored = scored.withColumn("jaccard", F.round(F.col("both") / (F.col("na") + F.col("nb") - F.col("both")), 6))
    order = Window.partitionBy(left_id).orderBy(F.col("jaccard").desc(), right_id)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(left_id, right_id, "jaccard", "rank")


def similarity(a: Column, b: Column) -> Column:
    """Matching-blocks ratio of two texts (0 to 1), by Arrow batches."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(x, y)])

    return ratio(a, b)


def stratified(rows: DataFrame, score: str, risky: Column, key: str, n: int, seed: int = 7) -> DataFrame:
    """n rows of greatest score, n further risky ones, n further in a seeded hash order; no row twice."""
    top = rows.orderBy(F.col(score).desc(), key).limit(n).withColumn("stratum", F.lit("suspicious"))
    rest = rows.join(top.select(key), key, "left_anti")
    danger = rest.where(risky).orderBy(F.col(score).desc(), key).limit(n).withColumn("stratum", F.lit("risky"))
    rest = rest.join(danger.select(key), key, "left_anti")
    return top.unionByName(danger).unionByName(rest.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n).withColumn("stratum", F.lit("random")))
