"""Sheets and documents become text and items."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factloom.sources import batches, layout, restore

CELLS = "file string, sheet string, row int, col int, value string"


def sheet(spark, *rows):
    return spark.createDataFrame([("f", "s", r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row)], CELLS)


MATRIX = [["品牌", "B", "B", ""], ["车系 名称", "S1", "S2", "x"], ["车型名称", "N1", "", ""], ["备注", "r", "q", ""], ["备注", "t", "", ""], ["", "", "", ""], ["其他", "", " 1 ", ""]]


def test_a_matrix_of_vehicles(spark):
    cells = sheet(spark, *MATRIX)
    assert [r["col"] for r in layout.vehicle_columns(cells).orderBy("col").collect()] == [1, 2]
    assert layout.orientation(cells).first()["orientation"] == layout.MATRIX
    assert layout.sheet_texts(cells).first()["text"] == f"{layout.MATRIX_MARK}\n\n【车型记录1】\n品牌: B\n车系 名称: S1\n车型名称: N1\n备注: r\n备注_2: t\n\n【车型记录2】\n品牌: B\n车系 名称: S2\n备注: q\n其他: 1"
    assert layout.orientation(sheet(spark, *MATRIX[:4])).first()["orientation"] == layout.ROWS


def test_a_table_below_a_title(spark):
    cells = sheet(spark, ["购车权益总表", ""], ["", ""], ["序号", "", "权益名称", "权益名称"], ["1", "a", "", "长" * 50], ["", "", "", ""], ["2", "b", "c", ""])
    rows = layout.sheet_rows(cells)
    assert layout.header_rows(rows).first()["index"] == 1
    assert layout.sheet_texts(cells).first()["text"] == f"{layout.PREFACE_MARK}\n购车权益总表\n\n字段：序号 | 字段2 | 权益名称 | 权益名称_2\n\n记录1：\n序号: 1\n字段2: a\n权益名称_2: {'长' * 50}\n\n记录2：\n序号: 2\n字段2: b\n权益名称: c"


def test_cells_without_a_header(spark):
    assert layout.sheet_texts(sheet(spark, ["", "x"], ["y"])).first()["text"] == "记录1：\n列2: x\n\n记录2：\n列1: y\n"
    assert layout.sheet_texts(sheet(spark, ["", " "])).count() == 0


@pytest.mark.parametrize("value, kind, want", [("1", "b", "是"), ("false", "b", "否"), ("249800.0", "n", "249800"), ("0.123456789", "n", "0.12345679"), ("1.50", "n", "1.5"), ("2024-01-02 00:00:00", "d", "2024-01-02"), ("2024-01-02 03:04:05", "d", "2024-01-02 03:04:05"), (" a　\r\n", "s", "a"), (None, "n", ""), ("x", "n", "x")])
def test_typed_cells(spark, value, kind, want):
    assert spark.createDataFrame([(value, kind)], "v string, k string").select(layout.cell_text(F.col("v"), F.col("k"))).first()[0] == want


def lines(spark, *docs):
    return spark.createDataFrame([(d, k, t) for d, texts in enumerate(docs) for k, t in enumerate(texts)], "doc_id long, line long, text string")


QA = ["{", '"车系":"H6",', '"问题":"价格？",', '"答案":"十万"', "}"]


def test_blocks_of_braces(spark):
    got = restore.record_blocks(lines(spark, ["}", "x", *QA, "y", '{"a": {"b": 1}}', "{", "z"], ["no braces"])).orderBy("doc_id", "block").collect()
    assert [(r["first"], r["last"], r["closed"], r["text"]) for r in got] == [(2, 6, True, "\n".join(QA)), (8, 8, True, '{"a": {"b": 1}}'), (9, 10, False, "{\nz")]


def test_standard_records_and_report(spark):
    broken = [x.replace('"答案":"', '"答案":') for x in QA]
    intent = ['{"意图名称1": "n", "意图描述1": "怎么买", "参考内容1": "到店"}']
    found = restore.standard_records(lines(spark, [*QA, *QA, *broken, *intent, '{"a": 1}', "{bad}", '{"车系":"", "问题":"", "答案":"x"}']))
    assert sorted((r["mode"], r["state"], r["answer"]) for r in found.where("state in ('qa_v1', 'intent_v1')").collect()) == [("repaired", "qa_v1", "十万"), ("strict", "intent_v1", "到店"), ("strict", "qa_v1", "十万"), ("strict", "qa_v1", "十万")]
    r = restore.standard_report(found).first()
    assert (r["candidates"], r["strict"], r["repaired"], r["failed"], r["skipped"], r["duplicate_exact"], r["duplicate_possible"], r["standard"]) == (7, 3, 1, 2, 1, 2, 2, True)


def test_json_in_any_state():
    assert restore.json_values('{"问题": "a"}{"问题": "b"}') == [{"问题": "a"}, {"问题": "b"}]
    assert restore.json_values("[1, 2]") == [1, 2] and restore.json_values("“x”") == ["x"]
    assert restore.json_values('x {"a": 1} y {bad} {"b": 2') == [{"a": 1}]
    assert restore.repaired('{"问题":"a"}') is None


def test_fast_reading(spark):
    doc = ["1. 多少钱？", "答：十万", "以门店为准", "Q：续航 A：500公里", "金融政策", "首付两成，三年免息可选", "这是下一行", '{"问题": "颜色", "答案": "红色"}', "有几个座位？", "谢谢大家"]
    got = {(r["source"], r["question"]): (r["answer"], r["category"]) for r in restore.fast_items(lines(spark, doc)).collect()}
    assert got == {("paragraph", "多少钱？"): ("十万 以门店为准", "价格"), ("inline", "续航"): ("500公里", "续航"), ("heading", "金融政策"): ("首付两成，三年免息可选 这是下一行", "金融"), ("json", "颜色"): ("红色", "通用")}


def test_each_document_by_its_format(spark):
    got = restore.restored(lines(spark, QA * 3, ["多少钱？", "答：十万"], ["nothing"])).collect()
    assert sorted((r["doc_id"], r["source"]) for r in got) == [(0, "qa_v1")] * 3 + [(1, "paragraph")]


def test_exported_sheets_come_back(spark):
    rows = spark.createDataFrame([("f", 1, "H6", "全系", "多少钱", "十万", "价格"), ("f", 2, None, None, " ", None, None)], "file string, index int, `车型` string, `版本` string, `问题` string, `回答` string, `分类` string")
    got = restore.excel_items(rows).collect()
    assert [(r["question"], r["knowledge_type"], r["model"]) for r in got] == [("多少钱", "price", "H6")]
    with pytest.raises(ValueError, match="分类"):
        restore.excel_items(rows.drop("分类"))


def test_tables_by_their_headers(spark):
    head = spark.createDataFrame([("d", 0, "序号"), ("d", 1, "用户问题："), ("d", 2, "标准 回答"), ("d", 3, "车型名")], "doc string, col int, value string")
    places = restore.header_places(head, ["doc"])
    assert {r["field"]: r["col"] for r in places.collect()} == {"question": 1, "answer": 2, "model": 3}
    cells = spark.createDataFrame([("d", 1, 1, "多少钱？"), ("d", 1, 2, " 十万  元"), ("d", 1, 3, "H6"), ("d", 2, 1, "只有问题")], "doc string, row int, col int, value string")
    assert [(r["question"], r["answer"], r["model"], r["category"]) for r in restore.sheet_items(cells, places, ["doc"]).collect()] == [("多少钱？", "十万 元", "H6", "价格")]


def test_records_in_batches(spark):
    sizes = [10, 10, 10, 10, 95, 40, 30, 30, 1]
    rows = spark.createDataFrame([(1, k, n) for k, n in enumerate(sizes)], "doc_id long, place int, chars int")
    got = [r["batch"] for r in batches.record_batches(rows, F.lit(8), 3, 100).orderBy("record").collect()]
    assert got == [0, 0, 0, 1, 2, 3, 3, 4, 4]
    assert batches.uncovered(spark.createDataFrame([(1, "有"), (2, "无"), (3, "有")], "record int, cash string"), spark.createDataFrame([(1, "现金礼"), (3, "置换")], "record int, content string"), "cash").collect()[0]["record"] == 3
