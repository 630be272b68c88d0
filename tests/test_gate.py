"""The gate, the checks and the router on single items that each meet one rule."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factloom.functions import dates, labels, speech
from factloom.operators import export, gate, review

SCHEMA = "ord long, rag_id string, brand string, model string, trim string, category string, module string, intent string, answer_type string, answer string, review_type string, knowledge_status string, need_confirm string, exportable boolean, knowledge_type string, questions array<string>, fact_refs array<string>"
GOOD = {"brand": "B", "model": "M1", "trim": "全系", "category": "配置", "module": "", "intent": "", "answer_type": "fact_answer", "answer": "有电动尾门", "review_type": "", "knowledge_status": "", "need_confirm": "否", "exportable": True, "knowledge_type": "static", "questions": ["有尾门吗"], "fact_refs": ["F1"]}


def items(spark, *changes):
    rows = [{"ord": k, "rag_id": f"R{k}", **GOOD, **c} for k, c in enumerate(changes)]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)


VETOES = [
    {"exportable": False}, {"answer_type": "NEED_CONFIRM"}, {"need_confirm": " 是 "}, {"review_type": "range_issue"}, {"trim": "需确认", "answer": "质保三年"}, {"answer": "价格12.5万元，不同版本价格会有差异"},
    {"answer": "后排座椅支持前后滑动"}, {"knowledge_status": "Invalid"}, {"answer": " "}, {"answer": None}, {"answer": "暂未提供"}, {"answer": "没有，建议咨询门店"},
]
PASSES = [{}, {"need_confirm": "True"}, {"review_type": "scope_conflict"}, {"trim": "需确认"}, {"answer": "价格12.5万元和13万元，不同版本价格会有差异"}, {"answer": "建议咨询门店"}, {"exportable": None}, {"questions": None, "fact_refs": None}]


def test_vetoes(spark):
    got = gate.judged(items(spark, *VETOES, *PASSES)).orderBy("ord").collect()
    assert [r["exportable_now"] for r in got] == [False] * len(VETOES) + [True] * len(PASSES)


def test_covered_topics(spark):
    rows = items(spark, {}, {"answer": ""}, {"answer": "", "model": "M2"}, {"answer": "", "review_type": "conflict", "model": "M 1"})
    got = {r["rag_id"]: (r["exportable"], r["export_block_reason"], r["review_type"], r["knowledge_status"]) for r in gate.gated(rows).collect()}
    assert got == {"R0": (True, None, "", ""), "R1": (False, gate.COVERED_REASON, "missing", "missing"), "R2": (False, gate.DEFAULT_REASON, "missing", "missing"), "R3": (False, gate.COVERED_REASON, "conflict", "unconfirmed")}


def test_price_conflicts(spark):
    price = lambda v, trim="": {"answer": f"售价{v}", "trim": trim, "answer_type": "fact_answer"}
    got = gate.price_conflicts(items(spark, price("12万元"), price("130,000元"), price("12.50万元", "全系"), price("9万元", "Pro"), price("9万元", "Pro"), price("8万元和9万元"))).collect()
    assert [(r["trim"], r["item"]) for r in got] == [("全系", "M1全系存在多个价格：12万元、12.5万元、13万元")]


def test_row_and_group_checks(spark):
    found = lambda d: sorted((r["rag_id"], r["issue_type"]) for r in d.collect())
    rows = items(
        spark, {"answer": "Pro和Max都有", "trim": "Pro"}, {"answer": "字" * 181, "knowledge_type": "dynamic"}, {"answer": "除180系列外，Max有"}, {"answer": "限时补贴"}, {"answer": "道路救援，见活动政策"}, {"answer": "见活动政策", "category": "x"},
        {"answer": "可以自动驾驶"}, {"questions": ["多少钱", "怎么样"]}, {"answer": "2024年3月5日上线", "category": ""},
    )
    assert found(gate.row_issues(rows)) == [("R0", gate.VERSION_MISMATCH), ("R1", gate.TOO_LONG), ("R2", gate.CONTRADICTION), ("R3", gate.MISPLACED), ("R5", gate.MISPLACED), ("R6", gate.ADAS_CLAIM), ("R7", gate.TOO_BROAD)]
    twice = items(spark, {"trim": "A"}, {"trim": "B"}, {"answer": "有限时活动2024年3月起", "knowledge_type": "dynamic"}, {"answer": "限时2024/5/1止", "knowledge_type": "dynamic"})
    assert found(gate.group_issues(twice)) == [("", gate.MIXED_PERIODS), ("R0", gate.DUPLICATE)]
    many = items(spark, *({"answer": f"屏幕{k}", "trim": "P"} for k in range(10)), {"model": "M3", "answer": "售价9万元", "trim": "P"}, {"model": "M3", "answer": "售价8万元", "trim": "Q"})
    assert found(gate.group_issues(many)) == sorted([("", gate.CONFIG_HEAVY), ("", gate.NO_OVERVIEW)])


def test_rules_and_routes(spark):
    rows = items(spark, {"questions": [""]}, {"answer": ""}, {"fact_refs": ["F1", " "]}, {"fact_refs": None}, {"trim": "需确认", "answer": "质保三年"}, {"trim": "", "fact_refs": ["F1", "F2"]}, {"trim": ""}, {"trim": "", "answer": "1、2、3"}, {"knowledge_type": "Policy", "answer": "仅限门店"})
    issues = gate.rule_issues(rows)
    assert sorted((r["rag_id"], r["issue_type"], r["detail"]) for r in issues.collect()) == [("R0", gate.NO_QUESTION, ""), ("R1", gate.NOT_EXPORTABLE, "missing_answer"), ("R1", gate.NO_ANSWER, ""), ("R2", gate.BAD_REFS, ""), ("R3", gate.BAD_REFS, "")]
    got = {r["rag_id"]: (r["route"], r["reasons"]) for r in gate.routes(rows, issues).collect()}
    assert got["R0"] == got["R2"] == ("rule_issue", "RULE_ISSUE") and got["R4"] == ("rule_issue", "NON_EXPORTABLE")
    assert got["R5"] == ("llm", "MULTI_FACT") and got["R6"] == ("rule_pass", "LOW_RISK_STATIC_SINGLE_FACT") and got["R7"] == ("llm", "MULTI_NUMERIC_CONDITION")
    assert got["R8"] == ("llm", "DYNAMIC_KNOWLEDGE,SCOPE_COMPLEXITY")
    assert gate.qc_summary(rows, issues).first()["overall_result"] == "需处理"


@pytest.mark.parametrize(
    "text, want",
    [
        ("￥129,800起", "12.98万元起"), ("优惠 10000元", "优惠 1万元"), ("0123456元", "0123456元"), ("150kW，310N·m，400 V", "150千瓦，310牛米，400伏"), ("3.5%和12%", "百分之三点五和百分之十二"), ("100%", "百分之一零零"),
        ("每月5G", "每月5GB流量"), ("5GHz", "5GHz"), ("10 GB，4K屏，4K高清", "10GB流量，4K高清屏，4K高清"), ("ADS和LCC", "智能驾驶辅助系统和车道居中辅助"), (None, ""), ("", ""),
    ],
)
def test_answers_are_read_aloud(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(speech.answer_aloud(F.col("t"))).first()[0] == want


@pytest.mark.parametrize(
    "text, want",
    [("2024年3月5日至4月1日", ("2024年3月", "2024-03-05", "2024-04-01")), ("2024/3/5 起，到 2025/1/31", ("2024年3月", "2024-03-05", "2025-01-31")), ("见2024-06-01", ("2024年6月", "unknown", "unknown")), ("2024.6.1", ("unknown",) * 3), ("2023年07月", ("2023年7月", "unknown", "unknown"))],
)
def test_policy_dates(spark, text, want):
    assert tuple(spark.createDataFrame([(text,)], "t string").select(dates.policy_dates(F.col("t")).alias("p")).select("p.*").first()) == want


def test_kinds_and_labels(spark):
    d = spark.createDataFrame([("ADDED", "金融政策", ""), (None, "", "static"), ("X", "续航", "Price")], "a string, b string, c string")
    got = d.select(labels.labelled(F.col("a"), labels.CHANGES), labels.internal_kind(F.col("c"), F.col("b"), F.lit(None)), labels.inferred_category(F.lit("多少钱"), F.lit(""), F.col("b"))).collect()
    assert sorted(map(tuple, got)) == sorted([("新增", "finance", "金融政策"), ("", "product", "价格"), ("X", "price", "续航")])


def test_exported_sheets(spark, tmp_path):
    export.write(items(spark, {"answer": "售价129800元", "knowledge_type": "other"}, {}, {"answer": ""}), f"file://{tmp_path}/out")
    sheets = {k: [tuple(r) for r in spark.read.option("header", True).csv(f"file://{tmp_path}/out/{n}").collect()] for k, n in export.SHEETS.items()}
    assert sheets == {"static": [("M1", "全系", "有尾门吗", "有电动尾门", "配置")], "dynamic": [("M1", "全系", "有尾门吗", "售价12.98万元", "配置")]}


def test_relation_choices(spark):
    groups = spark.createDataFrame([("G1", 1, "n1", True, "REVIEW_REQUIRED", "a"), ("G1", 1, "o1", False, "UNCHANGED", "b"), ("G1", 1, "o2", False, "UPDATED", "c"), ("G2", 2, "n1", True, "REVIEW_REQUIRED", "a"), ("G2", 2, "o3", False, "REVIEW_REQUIRED", "d")], "group_id string, group_ord int, diff_id string, is_new boolean, change_type string, item_id string")
    choices = spark.createDataFrame([("G2", "CUSTOM", True, ["d"])], "group_id string, choice string, confirmed boolean, selected array<string>")
    got = {r["diff_id"]: (r["decision"], r["keep_old"], r["confirmed"]) for r in review.relation_decisions(groups, choices).collect()}
    assert got == {"n1": ("SKIP", False, False), "o1": ("KEEP_OLD", False, False), "o3": ("KEEP_OLD", False, False)}
