"""Knowledge items restored from exported sheets and from documents, as lines (doc_id, line, text) and cell tables.

Records of braces are gaps and islands over a running depth; questions and answers in paragraphs follow the order of a
document's lines, so each document is read on its own; its size bounds a group.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import labels
from factloom.functions import text as T

# Columns of an exported sheet.
STANDARD_COLUMNS = ["车型", "版本", "问题", "回答", "分类"]
# Header names of tables, by the field they stand for.
HEADERS = {
    "question": ["问题", "问", "question", "q", "faq", "用户问题"],
    "answer": ["回答", "答", "answer", "a", "话术", "回复", "标准回答"],
    "category": ["分类", "类别", "category", "模块"],
    "model": ["车型", "model"],
    "trim": ["版本", "版型", "trim"],
    "brand": ["品牌", "brand"],
}
# Keys of a record by field, the first present counts; keys of the two standard schemas.
RECORD_KEYS = {
    "question": ["问题", "question", "Q", "q", "用户问题"],
    "answer": ["答案", "回答", "answer", "A", "a", "标准回答"],
    "model": ["车型", "车系", "model"],
    "trim": ["版本", "版型", "trim"],
    "brand": ["品牌", "brand"],
    "category": ["分类", "类别", "category", "模块"],
}
QA_KEYS, INTENT_KEYS = ["车系", "问题", "答案"], ["意图名称1", "意图描述1", "参考内容1"]
REPAIR_KEYS = ["车系", "车型", "问题", "答案", "回答", "意图名称1", "意图描述1", "参考内容1"]
# Least records, share of readable ones and of known schemas of a standard document.
MIN_RECORDS, MIN_READ, MIN_KNOWN = 3, 0.8, 0.8
MAX_QUESTION, MAX_ANSWER = 120, 1500

# Patterns of lines.
JSON_MARK = r'["“”]?(?:问题|答案|回答|车型|车系|分类|版本)["“”]?\s*[:：]'
NUMBERED = r"^\s*(?:[0-9]+[.、]|[（(]?[0-9]+[）)]|[一二三四五六七八九十]+[、.])\s*"
ASKS, ANSWERS = r"^(?:Q|q|问|问题)\s*[:：]\s*", r"^(?:A|a|答|回答)\s*[:：]\s*"
INLINE = [r"^(?:Q|q|问|问题)\s*[:：]\s*(.+?)\s*(?:A|a|答|回答)\s*[:：]\s*(.+)$", r"^(.+?[?？])\s*(?:A|a|答|回答)\s*[:：]\s*(.+)$"]
HEADING_WORDS = "政策|权益|价格|金融|配置|质保|救援|流量|续航|动力|空间|智驾|车型|基础信息"


def clean_text(c: Column) -> Column:
    """White space to single spaces, trimmed; zero-width marks go."""
    return F.trim(F.regexp_replace(F.translate(T.text(c), "​﻿", ""), r"(?U)\s+", " "))


def has_json_mark(c: Column) -> Column:
    return c.rlike(JSON_MARK)


def looks_like_json(c: Column) -> Column:
    c = F.trim(c)
    return has_json_mark(c) & ((c.contains("{") & c.contains("}")) | c.startswith("["))


def without_number(c: Column) -> Column:
    return F.regexp_replace(c, NUMBERED, "")


def is_question(c: Column) -> Column:
    bare = without_number(c)
    return bare.rlike(ASKS) | bare.endswith("?") | bare.endswith("？")


def question_of(c: Column) -> Column:
    return F.trim(F.regexp_replace(without_number(c), ASKS, ""))


def is_answer(c: Column) -> Column:
    return c.rlike(ANSWERS)


def answer_of(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, ANSWERS, ""))


def inline_pair(c: Column) -> Column:
    """Struct (question, answer) of a line that holds both, else null."""
    pair = lambda p: F.struct(F.regexp_extract(c, p, 1).alias("question"), F.regexp_extract(c, p, 2).alias("answer"))
    return F.when(c.rlike(INLINE[0]), pair(INLINE[0])).when(c.rlike(INLINE[1]), pair(INLINE[1]))


def is_heading(c: Column) -> Column:
    ends = F.substring(c, -1, 1).isin("。", "，", ",", "；", ";")
    return ~has_json_mark(c) & (F.length(c) <= 40) & ~ends & ~is_answer(c) & c.rlike(HEADING_WORDS)


def valid_pair(question: Column, answer: Column) -> Column:
    """Whether question and answer are of fair length and hold no pieces of records."""
    q, a = clean_text(question), clean_text(answer)
    braces = r"[{}\[\]]"
    made_up = q.contains("是什么？") & (q.contains("答案") | q.contains("回答"))
    return (F.length(q) >= 2) & (F.length(a) >= 2) & ~has_json_mark(q) & ~has_json_mark(a) & ~q.rlike(braces) & ~a.rlike(braces) & (F.length(q) <= MAX_QUESTION) & (F.length(a) <= MAX_ANSWER) & ~made_up


def header_places(headers: DataFrame, by: list[str]) -> DataFrame:
    """From header cells (by.., col, value): the column of each field: the first whose name is an alias, else the first
    that holds one. Columns by.., field, col."""
    aliases = headers.sparkSession.createDataFrame([(f, a) for f, names in HEADERS.items() for a in names], "field string, alias string")
    name = F.lower(F.regexp_replace(clean_text(F.col("value")), "[：:]", ""))
    found = headers.select(*by, "col", name.alias("name")).join(F.broadcast(aliases), F.contains("name", "alias"))
    return found.groupBy(*by, "field").agg(F.min(F.struct((F.col("name") != F.col("alias")).alias("inside"), "col"))["col"].alias("col"))


def sheet_items(rows: DataFrame, places: DataFrame, by: list[str]) -> DataFrame:
    """From cells below a header (by.., row, col, value) and header_places: one row an item, fields as columns."""
    cells = rows.join(places, [*by, "col"]).groupBy(*by, "row").agg(*(F.max(F.when(F.col("field") == f, clean_text(F.col("value")))).alias(f) for f in HEADERS))
    items = cells.fillna("", list(HEADERS)).where(valid_pair(F.col("question"), F.col("answer")))
    return items.withColumn("category", labels.inferred_category(F.col("question"), F.col("answer"), F.col("category")))


def excel_items(rows: DataFrame) -> DataFrame:
    """Rows of an exported sheet (file, index and the standard columns) as items; blank ones go. A missing column is an error."""
    lacking = [x for x in STANDARD_COLUMNS if x not in rows.columns]
    if lacking:
        raise ValueError(f"not an exported sheet: no column {', '.join(lacking)}")
    c = lambda x: T.text(F.col(x))
    kept = rows.where((F.trim(c("问题")) != "") | (F.trim(c("回答")) != ""))
    return kept.select(
        T.stable_id("XLSX", F.col("file"), F.col("index").cast("string"), c("问题"), c("回答"), c("分类")).alias("knowledge_id"),
        c("问题").alias("question"),
        T.question_key(F.col("问题")).alias("normalized_question"),
        c("回答").alias("answer"),
        c("分类").alias("category"),
        c("车型").alias("model"),
        c("版本").alias("trim"),
        labels.internal_kind(F.lit(""), F.col("分类"), F.lit("")).alias("knowledge_type"),
        F.lit(False).alias("need_confirm"),
        "file",
    )


def record_blocks(lines: DataFrame) -> DataFrame:
    """Runs of lines whose braces close: doc_id, block (from 1), first and last line, closed, text. A run that never closes
    is there with closed = false."""
    order = Window.partitionBy("doc_id").orderBy("line")
    count = lambda mark: F.length("text") - F.length(F.replace("text", F.lit(mark), F.lit("")))
    rows = lines.withColumns({"opens": count("{"), "closes": count("}")})
    rows = rows.withColumn("after", F.sum(F.col("opens") - F.col("closes")).over(order))
    # Closing braces outside a run count for nothing: the depth is measured from the least one so far.
    rows = rows.withColumn("floor", F.least(F.lit(0), F.min("after").over(order)))
    rows = rows.withColumn("depth", F.col("after") - F.col("floor")).withColumn("before", F.coalesce(F.lag("depth").over(order), F.lit(0)))
    rows = rows.withColumn("starts", (F.col("before") == 0) & (F.col("opens") > 0)).where("before > 0 or opens > 0")
    rows = rows.withColumn("block", F.count_if("starts").over(order))
    parts = F.array_sort(F.collect_list(F.struct("line", "text")))["text"]
    return rows.groupBy("doc_id", "block").agg(F.min("line").alias("first"), F.max("line").alias("last"), (F.min_by("depth", -F.col("line")) == 0).alias("closed"), F.array_join(parts, "\n").alias("text"))


REPAIR = re.compile(r'^(\s*"([^"]+)"\s*:\s*)([^"].*")(\s*,?\s*)$')


def repaired(raw: str) -> str | None:
    """A record whose values lack their opening quote, mended; None if that makes it no valid one."""
    lines, changed = [], False
    for line in raw.splitlines():
        m = REPAIR.match(line)
        if m and m[2] in REPAIR_KEYS:
            line, changed = f"{m[1]}{json.dumps(m[3].strip()[:-1], ensure_ascii=False)}{m[4]}", True
        lines.append(line)
    try:
        json.loads("\n".join(lines))
    except ValueError:
        return None
    return "\n".join(lines) if changed else None


def json_values(text: str) -> list:
    """All values in a text: as a whole, with joined objects parted, else every object that can be read."""
    text = text.translate(str.maketrans("“”‘’", "\"\"''")).strip()
    for candidate in (text, "[" + text.replace("}{", "},{") + "]" if "}{" in text else text):
        try:
            found = json.loads(candidate)
            return found if isinstance(found, list) else [found]
        except ValueError:
            continue
    values, at, reader = [], text.find("{"), json.JSONDecoder()
    while at >= 0:
        try:
            value, end = reader.raw_decode(text, at)
            values.append(value)
        except ValueError:
            end = at + 1
        at = text.find("{", end)
    return values


def _plain(record: dict) -> dict[str, str]:
    return {str(k): v if isinstance(v, str) else "" if v is None else json.dumps(v, ensure_ascii=False) for k, v in record.items()}


def parsed(blocks: DataFrame, column: str = "text") -> DataFrame:
    """The rows with mode (strict, repaired or failed) and record (a map of strings) of their texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            modes, records = [], []
            for raw in batch[column].fillna(""):
                mode, found = "strict", None
                try:
                    found = json.loads(raw)
                except ValueError:
                    mended = repaired(raw)
                    if mended:
                        mode, found = "repaired", json.loads(mended)
                good = isinstance(found, dict) and bool(found)
                modes.append(mode if good else "failed")
                records.append(_plain(found) if good else {})
            yield batch.assign(mode=modes, record=records)

    from pyspark.sql.types import MapType, StringType, StructType

    schema = StructType([*blocks.schema.fields]).add("mode", StringType()).add("record", MapType(StringType(), StringType()))
    return blocks.mapInPandas(run, schema)


def standard_records(lines: DataFrame) -> DataFrame:
    """Records of documents whose lines are JSON: the blocks with mode, record and state: qa_v1, intent_v1, skipped (another
    schema), failed (unreadable, unclosed or not a question with an answer); and question, answer, model, category."""
    rows = parsed(record_blocks(lines))
    has = lambda keys: F.size(F.array_intersect(F.map_keys("record"), F.array(*(F.lit(k) for k in keys)))) == len(keys)
    value = lambda k: clean_text(F.try_element_at("record", F.lit(k)))
    schema = F.when(~F.col("closed") | (F.col("mode") == "failed"), "failed").when(has(QA_KEYS), "qa_v1").when(has(INTENT_KEYS), "intent_v1").otherwise("skipped")
    rows = rows.withColumn("schema", schema)
    qa = F.col("schema") == "qa_v1"
    rows = rows.withColumns(
        {
            "question": F.when(qa, value("问题")).otherwise(value("意图描述1")),
            "answer": F.when(qa, value("答案")).otherwise(value("参考内容1")),
            "model": F.when(qa, value("车系")).otherwise(""),
            "category": F.when(qa, value("分类")).otherwise(""),
        }
    )
    q, a, m = F.col("question"), F.col("answer"), F.col("model")
    bad = (q == "") | (a == "") | q.rlike(r'[{}]|"答案"|"回答"') | a.rlike(r'[{}]|"问题"') | (q.contains("答案") & q.contains("是什么")) | m.rlike(r'[{}]|"问题"|"答案"')
    return rows.withColumn("state", F.when(F.col("schema").isin("qa_v1", "intent_v1") & bad, "failed").otherwise(F.col("schema")))


def standard_report(records: DataFrame) -> DataFrame:
    """By document: whether it is a standard one, and how many records were read strictly, mended, failed, skipped, and how
    many repeat an item or its question."""
    good = F.col("state").isin("qa_v1", "intent_v1")
    closed = F.col("closed")
    read = closed & (F.col("mode") != "failed")
    known = read & F.col("schema").isin("qa_v1", "intent_v1")
    counts = records.groupBy("doc_id").agg(
        F.count_if(closed).alias("candidates"),
        F.count_if(read).alias("readable"),
        F.count_if(known).alias("known"),
        F.count_if(good & (F.col("mode") == "strict")).alias("strict"),
        F.count_if(good & (F.col("mode") == "repaired")).alias("repaired"),
        F.count_if(F.col("state") == "failed").alias("failed"),
        F.count_if(F.col("state") == "skipped").alias("skipped"),
        F.count_if(F.col("state") == "qa_v1").alias("qa_v1"),
        F.count_if(F.col("state") == "intent_v1").alias("intent_v1"),
    )
    surplus = lambda keys, name: records.where(good).groupBy("doc_id", *keys).agg((F.count(F.lit(1)) - 1).alias("more")).groupBy("doc_id").agg(F.sum("more").alias(name))
    out = counts.join(surplus(["model", "question", "answer"], "duplicate_exact"), "doc_id", "left").join(surplus(["model", T.question_key(F.col("question")).alias("key")], "duplicate_possible"), "doc_id", "left")
    standard = (F.col("candidates") >= MIN_RECORDS) & (F.col("readable") >= MIN_READ * F.col("candidates")) & (F.col("known") >= MIN_KNOWN * F.col("readable"))
    return out.fillna(0).withColumn("standard", standard)


FAST = "doc_id long, place int, source string, question string, answer string, category string, model string, trim string, brand string"


def _classified(lines: DataFrame) -> DataFrame:
    c = F.col("text")
    pair = inline_pair(c)
    return lines.select(
        "doc_id", "line", "text", looks_like_json(c).alias("json"), has_json_mark(c).alias("mark"), pair["question"].alias("iq"), pair["answer"].alias("ia"),
        is_question(c).alias("asks"), question_of(c).alias("q"), is_answer(c).alias("answers"), answer_of(c).alias("a"), is_heading(c).alias("heading"),
    )


def _read_document(lines: pd.DataFrame) -> pd.DataFrame:
    """The items of one document's classified lines: records, then questions with answers, then headings with their bodies.

    A line that one reading uses is free for none of the later ones."""
    rows = lines.sort_values("line").to_dict("records")
    doc, out, used = rows[0]["doc_id"], [], set()

    def add(source: str, place: int, **fields: str) -> None:
        out.append({"doc_id": doc, "place": place, "source": source, **{f: " ".join(str(fields.get(f) or "").split()) for f in HEADERS}})

    for k, r in enumerate(rows):
        if r["json"] or r["mark"]:
            used.add(k)
        if r["json"]:
            for record in (x for v in json_values(r["text"]) for x in (v if isinstance(v, list) else [v]) if isinstance(x, dict)):
                plain = _plain(record)
                add("json", k, **{f: next((plain[n] for n in names if plain.get(n)), "") for f, names in RECORD_KEYS.items()})
    k = 0
    while k < len(rows):
        r, end, parts = rows[k], k + 1, []
        if r["iq"]:
            add("inline", k, question=r["iq"], answer=r["ia"])
            used.add(k)
        elif r["asks"]:
            while end < len(rows) and not rows[end]["asks"] and (rows[end]["answers"] or parts):
                parts.append(rows[end]["a"] if rows[end]["answers"] else rows[end]["text"])
                end += 1
            if parts:
                add("paragraph", k, question=r["q"], answer="\n".join(parts))
                used.update(range(k, end))
        k = end if parts else k + 1
    k = 0
    while k < len(rows):
        end, body = k + 1, []
        if k not in used and rows[k]["heading"]:
            while end < len(rows) and (end in used or not (rows[end]["heading"] or rows[end]["asks"])):
                if end not in used:
                    body.append(rows[end]["text"])
                end += 1
            if len("\n".join(body).strip()) >= 8:
                add("heading", k, question=rows[k]["text"], answer="\n".join(body))
                k = end
                continue
        k += 1
    return pd.DataFrame(out, columns=["doc_id", "place", "source", *HEADERS])


def fast_items(lines: DataFrame) -> DataFrame:
    """Items read from documents' lines without a standard schema: doc_id, place, source (json, inline, paragraph or heading)
    and the fields; pairs that are not valid go."""
    found = _classified(lines).groupBy("doc_id").applyInPandas(_read_document, FAST)
    found = found.where(valid_pair(F.col("question"), F.col("answer")))
    return found.withColumn("category", labels.inferred_category(F.col("question"), F.col("answer"), F.col("category")))


def restored(lines: DataFrame) -> DataFrame:
    """Every document's items by its format: standard records where the document is a standard one, else the fast reading.
    A document that yields nothing has no rows. Columns doc_id, place, source, question, answer, category, model."""
    records = standard_records(lines)
    report = standard_report(records).where("standard").select("doc_id")
    good = records.join(report, "doc_id", "left_semi").where("state in ('qa_v1', 'intent_v1')")
    columns = ["doc_id", "place", "source", "question", "answer", "category", "model"]
    standard = good.select("doc_id", F.col("block").cast("int").alias("place"), F.col("state").alias("source"), "question", "answer", "category", "model")
    return standard.unionByName(fast_items(lines.join(report, "doc_id", "left_anti")).select(*columns))


def restore_counters(items: DataFrame) -> DataFrame:
    """One row: items, distinct models, and items to be confirmed."""
    return items.agg(F.count(F.lit(1)).alias("restored"), F.count_distinct(F.when(F.col("model") != "", F.col("model"))).alias("models"), F.count_if("need_confirm").alias("need_confirm"))
