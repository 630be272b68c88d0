"""Blocked, scored matching of a new knowledge snapshot with an old one."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.functions.models import related_models
from factloom.operators.lineage import settled

MAX_CANDIDATES = 5
MARGIN = 0.08
ROUNDS = 60  # labels jump as well as spread, so a chain of names takes the logarithm of its length
# Rule scores. They are doubles, summed in this order.
REVIEW, STRUCTURED, NORMALIZED_QUESTION = 0.68, 0.82, 0.95

FIELDS = ("ord", "knowledge_id", "question", "answer", "category", "model", "trim", "knowledge_type", "need_confirm")


def normalized(items: DataFrame) -> DataFrame:
    """The items with their normalised question, answer, topic, signature, numbers, intents and surface intents."""
    c = F.col
    for name in ("brand", "module"):
        if name not in items.columns:
            items = items.withColumn(name, F.lit(""))
    topic = T.topic(c("question"), c("category"), c("module"), c("knowledge_type"), c("answer"))
    return items.select(
        *FIELDS,
        T.question_text(c("question")).alias("q"),
        T.answer_text(c("answer")).alias("a"),
        T.numbers(c("answer")).alias("numbers"),
        topic.alias("topic"),
        F.concat_ws("|", *(T.plain(c(f)) for f in ("brand", "model", "trim", "knowledge_type")), topic).alias("signature"),
        T.intents(c("question"), c("category"), c("module"), c("knowledge_type"), c("answer")).alias("intents"),
        T.intents(c("question"), c("category")).alias("surface"),
    )


def _tier(n: str, o: str) -> Column:
    """The first rule by which a pair of related models becomes a candidate; null if none does."""
    new, old = (lambda x: F.col(f"{n}.{x}")), (lambda x: F.col(f"{o}.{x}"))
    rules = [F.when(new("q") == old("q"), 1), F.when(new("signature") == old("signature"), 2)]
    rules += [F.when(F.array_contains(new("intents"), k) & F.array_contains(old("intents"), k), 3 + 2 * i) for i, k in enumerate(T.INTENT_NAMES)]
    first = T.specific(new("intents"))
    position = F.array_position(F.array(*(F.lit(k) for k in T.INTENT_NAMES)), F.get(first, F.lit(0))).cast("int")
    rules.append(F.when((F.size(first) > 0) & T.related(new("intents"), old("intents")), 2 + 2 * position))
    rules.append(F.when(new("model") == old("model"), 30))
    rules.append(F.when(F.col("relation").isin("EXACT", "ALIAS"), 31))
    rules.append(F.when((F.col("relation") != "ALIAS") | (F.col("same_family")), 32))
    rules.append(F.when((new("category") != "") & (new("category") == old("category")), 33))
    rules.append(F.when((new("knowledge_type") != "") & (new("knowledge_type") == old("knowledge_type")), 34))
    return F.least(*rules)


def _keys(items: DataFrame, offered: bool) -> DataFrame:
    """The keys over which rules join items of related names (offered: as old items are found, else as new ones look), one a row.

    Related intents become equal keys: an item with the general intent looks for one with any kind of offer, and the other
    way round."""
    c, none = F.col, F.array().cast("array<string>")
    offers = F.size(F.array_except("intents", F.array(F.lit("PRICE"), F.lit(T.GENERAL)))) > 0
    general = F.array_contains("intents", T.GENERAL)
    when = lambda holds, key: F.when(holds, F.array(F.lit(key))).otherwise(none)
    kin = when(offers, "i|*") if offered else F.concat(when(general, "i|*"), when(offers, f"i|{T.GENERAL}"))
    plain = F.filter(F.array(F.concat(F.lit("q|"), "q"), F.concat(F.lit("s|"), "signature"), F.lit("m|"), F.when(c("category") != "", F.concat(F.lit("c|"), "category")), F.when(c("knowledge_type") != "", F.concat(F.lit("k|"), "knowledge_type"))), lambda k: k.isNotNull())
    keys = F.array_distinct(F.concat(plain, F.transform("intents", lambda i: F.concat(F.lit("i|"), i)), kin))
    return items.select("model", "ord", "knowledge_id", F.explode(keys).alias("key"))


def candidates(new: DataFrame, old: DataFrame, limit: int = MAX_CANDIDATES) -> DataFrame:
    """From normalised snapshots: pairs n, o (structs), relation, tier and rank, at most ``limit`` for each new item.

    Every rule is an equality of keys, and of the old items of one name and key only the first ``limit`` can be chosen, so
    a new item meets that many a key and name, however many items its name has."""
    pairs = related_models(new, old).withColumn("same_family", F.col("relation").isin("EXACT", "FAMILY", "VARIANT"))
    first = F.row_number().over(Window.partitionBy("model", "key").orderBy("ord", "knowledge_id"))
    offered = _keys(old, True).withColumn("place", first).where(F.col("place") <= limit).select(F.col("model").alias("old_model"), "key", F.col("knowledge_id").alias("old_id"))
    looking = _keys(new, False).select(F.col("model").alias("new_model"), "key", F.col("knowledge_id").alias("new_id"))
    met = looking.join(pairs, "new_model").join(offered, ["old_model", "key"]).select("new_id", "old_id", "relation", "same_family").distinct()
    joined = met.join(new.select(F.struct("*").alias("n")), F.col("new_id") == F.col("n.knowledge_id")).join(old.select(F.struct("*").alias("o")), F.col("old_id") == F.col("o.knowledge_id"))
    tiered = joined.withColumn("tier", _tier("n", "o")).where("tier is not null").select("n", "o", "relation", "tier")
    order = Window.partitionBy("n.knowledge_id").orderBy("tier", "o.ord")
    return tiered.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def scored(pairs: DataFrame) -> DataFrame:
    """Candidates with score, method and reason; pairs that a veto or a low score drops are gone."""
    n, o = (lambda x: F.col(f"n.{x}")), (lambda x: F.col(f"o.{x}"))
    both = lambda f: (n(f) != "") & (o(f) != "") & (n(f) == o(f))
    ns, os_ = T.specific(n("intents")), T.specific(o("intents"))
    nf, of = T.specific(n("surface")), T.specific(o("surface"))
    apart = lambda a, b: (F.size(a) > 0) & (F.size(b) > 0) & ~T.shares(a, b)
    veto = ((n("trim") != "") & (o("trim") != "") & (n("trim") != o("trim"))) | apart(nf, of) | apart(ns, os_)
    one_to_many = F.array_contains(o("surface"), T.GENERAL) & (F.size(of) == 0) & (F.size(ns) > 0)
    many_to_one = F.array_contains(n("surface"), T.GENERAL) & (F.size(nf) == 0) & (F.size(os_) > 0)
    shared_specific = T.shares(ns, os_)
    near = T.related(n("intents"), o("intents"))
    shared_number = T.shares(n("numbers"), o("numbers"))
    same_topic = (n("topic") == o("topic")) & (n("topic") != "general")
    incomplete = (n("category") == "") | (o("category") == "") | (n("knowledge_type") == "") | (o("knowledge_type") == "")
    compatible = both("category") | both("knowledge_type") | incomplete
    open_intents = T.shares(n("intents"), o("intents")) | (F.size(n("intents")) == 0) | (F.size(o("intents")) == 0)
    strong = F.col("relation").isin("EXACT", "ALIAS") & shared_specific
    kin = F.col("relation").isin("FAMILY", "VARIANT")
    points = [
        F.when(F.col("relation") == "EXACT", 0.28).when(F.col("relation") == "ALIAS", 0.26).when(kin, 0.12).otherwise(0.0),
        F.when(both("trim"), 0.12).otherwise(0.0),
        F.when(both("category"), 0.18).otherwise(0.0),
        F.when(both("knowledge_type"), 0.14).otherwise(0.0),
        F.when(same_topic, 0.24).otherwise(0.0),
        F.when(shared_specific, 0.24).when(near, 0.10).otherwise(0.0),
        F.when(shared_number, 0.08).otherwise(0.0),
    ]
    total = points[0]
    for p in points[1:]:
        total = total + p
    pairs = pairs.where(~veto).withColumn("total", total)
    result = lambda score, method, reason: F.struct(score.cast("double").alias("score"), F.lit(method).alias("method"), F.lit(reason).alias("reason"))
    verdict = (
        F.when(one_to_many, result(F.lit(REVIEW), "AMBIGUOUS", "ONE_TO_MANY"))
        .when(many_to_one, result(F.lit(REVIEW), "AMBIGUOUS", "MANY_TO_ONE"))
        .when((o("q") != "") & (o("q") == n("q")) & compatible & open_intents, result(F.lit(NORMALIZED_QUESTION), "NORMALIZED_QUESTION", "NORMALIZED_QUESTION"))
        .when(strong & (o("q") == n("q")), result(F.lit(0.94), "STRUCTURED", "MODEL_STRONG+INTENT+QUESTION"))
        .when(strong & shared_number, result(F.lit(0.88), "STRUCTURED", "MODEL_STRONG+INTENT+NUMBER"))
        .when(strong & same_topic, result(F.lit(0.86), "STRUCTURED", "MODEL_STRONG+INTENT+TOPIC"))
        .when(kin & near & (F.col("total") >= REVIEW), result(F.col("total"), "AMBIGUOUS", "MODEL_FAMILY_REVIEW"))
        .when(F.col("total") >= STRUCTURED, result(F.least(F.col("total"), F.lit(0.9)), "STRUCTURED", "STRUCTURED_V2"))
        .when(F.col("total") >= REVIEW, result(F.col("total"), "AMBIGUOUS", "REVIEW_CANDIDATE_V2"))
    )
    return pairs.withColumn("v", verdict).where("v is not null").select("n", "o", "relation", "tier", "rank", "v.score", "v.method", "v.reason")


def best(pairs: DataFrame) -> DataFrame:
    """Each new item's best candidate and the margin to the next, without consumption of old items: new_id, old_id,
    score, method, reason, outcome (MATCHED or AMBIGUOUS)."""
    order = Window.partitionBy("n.knowledge_id").orderBy(F.col("score").desc(), "rank")
    top = pairs.select("*", F.row_number().over(order).alias("place"), F.lead("score").over(order).alias("next")).where("place = 1")
    close = F.col("next").isNotNull() & (F.col("score") - F.col("next") < MARGIN)
    outcome = F.when(close | (F.col("method") == "AMBIGUOUS"), "AMBIGUOUS").otherwise("MATCHED")
    return top.select(F.col("n.knowledge_id").alias("new_id"), F.col("o.knowledge_id").alias("old_id"), "score", "method", "reason", outcome.alias("outcome"))


def model_groups(pairs: DataFrame) -> DataFrame:
    """Columns model and part: parts of the graph of related names, so that no candidate pair crosses parts.

    Labels spread to the least name in reach, written to the checkpoint folder each round.
    """
    edges = pairs.select(F.concat(F.lit("n:"), "new_model").alias("a"), F.concat(F.lit("o:"), "old_model").alias("b"))
    edges = settled(edges.unionAll(edges.select("b", "a")).distinct())
    labels = edges.select(F.col("a").alias("node"), F.col("a").alias("part")).distinct()
    for _ in range(ROUNDS):
        least = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("part").alias("low"))
        spread = labels.join(least, F.col("node") == F.col("a"), "left").select("node", F.least("part", F.coalesce("low", "part")).alias("part"))
        jump = spread.select(F.col("node").alias("part"), F.col("part").alias("further"))
        spread = settled(spread.join(jump, "part", "left").select("node", F.least("part", F.coalesce("further", "part")).alias("part")))
        if spread.join(labels, ["node", "part"], "left_anti").limit(1).count() == 0:
            return spread
        labels = spread
    raise RuntimeError(f"the graph of names did not settle in {ROUNDS} rounds")


def assign(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Greedy assignment: new items in order take their best old item unless it is taken or the choice is ambiguous.

    Old items only meet new ones of related names, so each part of the names' graph is assigned on its own.
    Columns: new_id, old_id (null if ambiguous), score, method, reason, outcome, candidate_ids.
    """
    rows = pairs.select(F.col("n.knowledge_id").alias("new_id"), F.col("n.ord").alias("new_ord"), F.concat(F.lit("n:"), F.col("n.model")).alias("node"), F.col("o.knowledge_id").alias("old_id"), "rank", "score", "method", "reason").join(parts, "node")

    def greedy(group: pd.DataFrame) -> pd.DataFrame:
        taken: set[str] = set()
        out = []
        for _, offers in group.sort_values(["new_ord", "rank"]).groupby("new_ord", sort=True):
            free = offers[~offers["old_id"].isin(taken)].sort_values("score", ascending=False, kind="stable")
            if free.empty:
                continue
            top = free.iloc[0]
            close = len(free) > 1 and top["score"] - free.iloc[1]["score"] < MARGIN
            unclear = close or top["method"] == "AMBIGUOUS"
            if not unclear:
                taken.add(top["old_id"])
            known = top["reason"] in ("ONE_TO_MANY", "MANY_TO_ONE", "AMBIGUOUS_MATCH")
            reason = top["reason"] if not unclear or known else "AMBIGUOUS_MATCH" if close else "LOW_CONFIDENCE"
            out.append((top["new_id"], None if unclear else top["old_id"], float(top["score"]), "AMBIGUOUS" if unclear else top["method"], reason, "AMBIGUOUS" if unclear else "MATCHED", ",".join(free["old_id"])))
        return pd.DataFrame(out, columns=["new_id", "old_id", "score", "method", "reason", "outcome", "candidate_ids"])

    return rows.groupBy("part").applyInPandas(greedy, "new_id string, old_id string, score double, method string, reason string, outcome string, candidate_ids string")
