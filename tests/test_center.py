"""The review centre, audits, modes and extraction on single cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_gate import items

from factloom.functions import prices
from factloom.operators import audit, center
from factloom.plans import modes

PAIR = "struct<question:string,answer:string,category:string,model:string,trim:string,knowledge_type:string>"


def test_one_list_of_open_points(spark):
    gaps = spark.createDataFrame([("", None, "缺价格", None, "前后矛盾"), ("other", "H6", None, "说明", None), ("conflict", "H9", "x", None, None)], "review_type string, vehicle string, missing_content string, description string, reason string")
    rows = center.review_rows(gaps, gaps.limit(0), items(spark, {"answer": ""}, {"knowledge_type": "dynamic"}, {}))
    got = sorted((r["kind"], r["model"], r["item"], r["reason"]) for r in rows.collect())
    assert got == sorted([("missing", center.ALL_MODELS, "缺价格", "前后矛盾"), ("missing", "H6", "说明", "说明"), ("conflict", "H9", "x", center.NOT_FOUND), ("missing", "M1", "有尾门吗", "同车型同主题已有有效知识，缺失型RAG不进入正式Excel"), ("dynamic_notice", "M1", "有尾门吗", center.NOTICE)])
    assert {r["measure"]: r["n"] for r in center.review_counts(rows).collect()} == {"信息缺失": 3, "信息冲突": 1, "活动政策": 1}
    assert center.attention_rows(rows).count() == 4


def test_relation_candidates(spark):
    reviews = spark.createDataFrame([("D1", "哈弗H6", ["PRICE"], ["o1", "o2", "o1", "o3", "x"]), ("D2", None, None, ["o2"])], "diff_id string, new_model string, new_intents array<string>, old_ids array<string>")
    old = spark.createDataFrame([("o1", "H6", ["PRICE"]), ("o2", "H9", ["PRICE"]), ("o3", "H6", ["WARRANTY"])], "knowledge_id string, model string, intents array<string>")
    got = sorted((r["diff_id"], r["old_id"], r["place"]) for r in center.relation_candidates(reviews, old).collect())
    assert got == [("D1", "o1", 0), ("D2", "o2", 0)]


@pytest.mark.parametrize(
    "n, o, ratio, want",
    [
        (("H6多少钱", "十万", "价格", "哈弗H6", "", "price"), ("H6价格", "十万", "价格", "H6", "", "price"), 0.8, "DUPLICATE"),
        (("H6多少钱", "10万", "价格", "H6", "", "price"), ("H6价格", "12万", "价格", "H6", "", "price"), 0.8, "SHOULD_UPDATE"),
        (("H6多少钱", "10万", "价格", "H6", "", "price"), ("H9价格", "10万", "价格", "H9", "", "price"), 0.9, "TRUE_ADDED"),
        (("续航", "500", "续航", "", "", ""), ("流量", "10G", "流量", "", "", ""), 0.0, "TRUE_ADDED"),
    ],
)
def test_audit_suggestions(spark, n, o, ratio, want):
    pairs = spark.createDataFrame([(n, o)], f"n {PAIR}, o {PAIR}")
    r = audit.scored(pairs, F.lit(ratio)).first()
    assert r["suggestion"] == want and 0 <= r["audit_score"] <= 1
    top = audit.summary(audit.scored(pairs, F.lit(ratio)), 3).first()
    assert (top["with_candidate"], top["without_candidate"], top["suspicious"]) == (1, 2, int(want != "TRUE_ADDED"))


def test_tokens_of_mixed_text(spark):
    d = spark.createDataFrame([("哈弗H6 Plus 多少钱？1.5T 价",)], "t string")
    assert set(d.select(audit.tokens(F.col("t"))).first()[0]) == {"哈弗", "h6", "plus", "多少钱", "1.5", "h6+", "多少钱1", "5t价"} - {"多少钱1", "5t价"} | {"15"}
    assert list(d.select(audit.model_tokens(F.lit("哈弗 H6"))).first()[0]) == ["哈弗h6", "h6"] and not d.select(audit.model_tokens(F.lit("坦克"))).first()[0]


@pytest.mark.parametrize("text, price, want", [("约12.98万", "129800", True), ("129800元", "129800", True), ("13万", "129800", False), ("9万元起", "90000元", True), ("x", "", False)])
def test_spellings_of_prices(spark, text, price, want):
    assert spark.createDataFrame([(text, price)], "t string, p string").select(prices.names_price(F.col("t"), F.col("p"))).first()[0] == want


def test_modes_and_failed_chunks(spark, monkeypatch):
    monkeypatch.setenv("FACTS_MODE", "chunked")
    assert modes.setting(spark, "FACTS_MODE") == "chunked" and modes.setting(spark, "NO_SUCH", "d") == "d"
    spark.conf.set("spark.factloom.FACTS_MODE", "single")
    assert modes.setting(spark, "FACTS_MODE") == "single"
    spark.conf.unset("spark.factloom.FACTS_MODE")
    chunks = spark.createDataFrame([(1, 1, "b。c"), (1, 0, "a！"), (2, 0, None), (3, 0, "bad")], "doc_id long, chunk int, text string")

    def extract(text):
        if text == "bad":
            raise ValueError("no")
        return modes.sentences(text)

    got = modes.extracted(chunks, extract)
    assert [(r["doc_id"], r["content"]) for r in got.where("error is null").orderBy("doc_id", "chunk", "place").collect()] == [(1, "a"), (1, "b"), (1, "c")]
    with pytest.raises(Exception, match="chunk 0: no"):
        modes.all_or_nothing(got).collect()
