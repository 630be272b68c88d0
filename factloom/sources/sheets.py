"""Sheets as long tables of cells (file, sheet, row, col, value), and line-based texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean_cell(c: Column) -> Column:
    """No-break and ideographic spaces to spaces, trimmed; null to empty."""
    return F.trim(F.translate(F.coalesce(c.cast("string"), F.lit("")), " 　", "  "))


def merged_expanded(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """Every cell of a merged range (file, sheet, r1, c1, r2, c2) gets its top-left value."""
    at = ranges.join(cells.select("file", "sheet", F.col("row").alias("r1"), F.col("col").alias("c1"), F.col("value").alias("top")), ["file", "sheet", "r1", "c1"])
    spread = at.select("file", "sheet", F.explode(F.sequence("r1", "r2")).alias("row"), "c1", "c2", "top").select("file", "sheet", "row", F.explode(F.sequence("c1", "c2")).alias("col"), "top")
    out = cells.join(spread, ["file", "sheet", "row", "col"], "full")
    return out.select("file", "sheet", "row", "col", F.coalesce("top", "value").alias("value"))


def row_extents(cells: DataFrame) -> DataFrame:
    """The rows that have values: last filled column and number of filled cells."""
    return cells.where(clean_cell(F.col("value")) != "").groupBy("file", "sheet", "row").agg(F.max("col").alias("last_col"), F.count(F.lit(1)).alias("filled"))


def unique_headers(headers: DataFrame, by: list[str], name: str, order: str, position: str) -> DataFrame:
    """Blank headers are named by their position; repeats get _2, _3 and so on."""
    named = F.when(clean_cell(F.col(name)) == "", F.concat(F.lit("字段"), F.col(position).cast("string"))).otherwise(F.col(name))
    out = headers.withColumn(name, named)
    k = F.row_number().over(Window.partitionBy(*by, name).orderBy(order))
    return out.withColumn("k", k).withColumn(name, F.when(F.col("k") == 1, F.col(name)).otherwise(F.concat_ws("_", name, F.col("k").cast("string")))).drop("k")


def records(cells: DataFrame) -> DataFrame:
    """A matrix sheet whose rows are fields (label) and whose columns are records: one text of 'label: value' lines a column."""
    lines = F.array_sort(F.collect_list(F.struct("row", "value", "label")))
    out = cells.where(F.col("value") != "").groupBy("file", "sheet", "col").agg(lines.alias("lines"))
    return out.select("file", "sheet", "col", F.array_join(F.transform("lines", lambda x: F.concat(x["label"], F.lit(": "), x["value"])), "\n").alias("record"), F.size("lines").cast("long").alias("fields"))


def lines(docs: DataFrame) -> DataFrame:
    """The non-blank lines of texts, numbered from 0."""
    kept = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return docs.select("doc_id", F.posexplode(kept).alias("line", "text")).withColumn("line", F.col("line").cast("long"))


def question_answers(turns: DataFrame) -> DataFrame:
    """Each user turn with the assistant turns up to the next user turn: conv_id, pair, question, answer."""
    k = F.count_if(F.col("role") == "user").over(Window.partitionBy("conv_id").orderBy("turn"))
    answers = F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text"))))
    out = turns.withColumn("pair", k).where("pair > 0").groupBy("conv_id", "pair").agg(F.max(F.when(F.col("role") == "user", F.col("text"))).alias("question"), answers.alias("answers"))
    return out.where("size(answers) > 0").select("conv_id", "pair", "question", F.array_join("answers.text", "\n").alias("answer"))


def record_blocks(material: DataFrame, marker: str) -> DataFrame:
    """Lines (doc_id, line, text) cut into records at lines that hold a marker; record 0 is the shared context."""
    k = F.count_if(F.col("text").contains(marker)).over(Window.partitionBy("doc_id").orderBy("line"))
    return material.withColumn("record", k)


def parsed_records(material: DataFrame, marker: str = "【车型记录") -> DataFrame:
    """Texts (doc_id, text) whose records begin at marker lines: doc_id, record (from 1), field, value of each 'field: value' line."""
    blocks = record_blocks(lines(material), marker).where("record > 0")
    found = blocks.where(F.col("text").contains(":") & ~F.col("text").startswith(marker))
    return found.select("doc_id", "record", F.trim(F.substring_index("text", ":", 1)).alias("field"), F.trim(F.expr("substr(text, instr(text, ':') + 1)")).alias("value"))
