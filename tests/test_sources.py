"""Files, sheets, chunks and review groups on small made inputs."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from factloom.functions import prices
from factloom.operators import facts, merge, review
from factloom.sources import chunks, office, sheets


def zipped(**files):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, content in files.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), content)
    return data.getvalue()


SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook():
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{SHEET}" xmlns:r="{REL}"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{SHEET}"><si><t>name</t></si></sst>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{SHEET}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5.0</v></c></row><row><c r="A2" t="b"><v>1</v></c></row></sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells></worksheet>')
    return data.getvalue()


def test_workbook_cells():
    assert list(office.workbook_cells(workbook())) == [("S", 0, 0, "name"), ("S", 0, 1, "name"), ("S", 0, 2, "5"), ("S", 1, 0, "是")]


def test_archives():
    inner = zipped(c_dot_png="x")
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("b.zip", inner)
        z.writestr("a/d.JPG", "yy")
        z.writestr("note.txt", "n")
    assert list(office.archive_images(data.getvalue())) == [("a/d.JPG", 2), ("b.zip!c.png", 1)]
    bad = io.BytesIO()
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("../x.png", "x")
    with pytest.raises(ValueError, match="unsafe"):
        list(office.archive_images(bad.getvalue()))


def test_files_are_read_and_failures_kept_apart(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook())
    (tmp_path / "b.txt").write_text("one\n\ntwo\n")
    (tmp_path / "c.xlsx").write_bytes(b"not a workbook")
    rows = office.read_files(spark, str(tmp_path)).collect()
    assert sorted((r["line"], r["text"]) for r in rows if r["path"].endswith("a.xlsx")) == [(0, "name | name | 5"), (1, "是")]
    assert [r["text"] for r in rows if r["path"].endswith("b.txt")] == ["one", "two"]
    assert [r["error"][:10] for r in rows if r["error"]] == ["BadZipFile"]


def test_merged_cells_and_headers(spark):
    cells = spark.createDataFrame([("f", "s", 0, 0, "x"), ("f", "s", 2, 2, "y")], "file string, sheet string, row int, col int, value string")
    ranges = spark.createDataFrame([("f", "s", 0, 0, 1, 1)], "file string, sheet string, r1 int, c1 int, r2 int, c2 int")
    assert sheets.merged_expanded(cells, ranges).count() == 5
    heads = spark.createDataFrame([("s", 1, "a"), ("s", 2, "a"), ("s", 3, " ")], "sheet string, col int, header string")
    got = sheets.unique_headers(heads, ["sheet"], "header", "col", "col").orderBy("col").collect()
    assert [r["header"] for r in got] == ["a", "a_2", "字段3"]


def test_chunks_keep_all_text_and_bounds():
    text = "第一章 开始\n\n" + "。".join("句子" * 10 for _ in range(900)) + "\n\n" + "x" * 15000 + "\n\n尾"
    got = chunks.chunks(text)
    assert all(len(t) <= chunks.MOST for _, t in got)
    assert "".join(t.replace("\n", "") for _, t in got) == text.replace("\n", "")
    assert chunks.chunks("") == [] and got[1][0] == "第一章 开始"


def test_packing_matches_a_plain_loop(spark):
    sizes = [10, 25, 5, 40, 1, 29, 30, 2]
    groups = spark.createDataFrame([("a", k, s) for k, s in enumerate(sizes)], "g string, k int, s long")
    packs, held, pack = [], 0, -1
    for s in sizes:
        if pack >= 0 and held + s <= 30:
            held += s
        else:
            pack, held = pack + 1, s
        packs.append(pack)
    assert [r["pack"] for r in facts.packed(groups, "g", "s", "k").orderBy("k").collect()] == packs


def test_relation_groups(spark):
    rows = [("p", 1, "D1", "ONE_TO_MANY", "o1", 0), ("p", 2, "D2", "ONE_TO_MANY", "o1", 0), ("p", 2, "D2", "ONE_TO_MANY", "o2", 1), ("p", 3, "D3", "ONE_TO_MANY", "o2", 0), ("p", 4, "D4", "MANY_TO_ONE", "o1", 0), ("p", 4, "D4", "MANY_TO_ONE", "o3", 1)]
    d = spark.createDataFrame(rows, "part string, review_ord long, diff_id string, reason string, old_id string, old_place int")
    groups = review.relation_groups(d)
    assert sorted(map(tuple, groups.collect())) == [("REL-D3", "D3"), ("REL-D4", "D4"), ("REL-o1", "D1"), ("REL-o1", "D2")]
    chosen = spark.createDataFrame([("REL-o1", "KEEP_OLD_ONLY")], "group_id string, choice string")
    got = {r["diff_id"]: (r["decision"], r["keep_old"]) for r in review.expanded_decisions(groups, chosen).collect()}
    assert got == {"D1": ("SKIP", False), "D2": ("SKIP", False), "D3": ("ACCEPT_NEW", True), "D4": ("ACCEPT_NEW", True)}


def test_merge_keeps_unchanged_and_dedup_is_idempotent(spark):
    rows = spark.createDataFrame([("D1", "UNCHANGED", "o1", "n1"), ("D2", "UPDATED", "o2", "n2"), ("D3", "REVIEW_REQUIRED", "o3", None)], "diff_id string, change_type string, old_id string, new_id string")
    assert sorted(r["item_id"] for r in merge.merged(merge.decided(rows)).collect()) == ["n2", "o1", "o3"]
    items = spark.createDataFrame([(1, "a", "x  y"), (2, "b", " x y"), (3, "c", None), (4, "d", "")], "ord long, id string, q string")
    once = merge.without_duplicates(items, "id", ["q"])
    assert sorted(r["id"] for r in once.collect()) == ["a", "c"] == sorted(r["id"] for r in merge.without_duplicates(once, "id", ["q"]).collect())


@pytest.mark.parametrize("number, want", [("7", "七"), ("10", "十"), ("12", "十二"), ("30", "三十"), ("45.6", "四十五点六"), ("128", "一二八")])
def test_spoken(spark, number, want):
    assert spark.range(1).select(prices.spoken(F.lit(number))).first()[0] == want
