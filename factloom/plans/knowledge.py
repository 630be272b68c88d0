"""Registered queries of the gate, the checks, sheets, labels, restoring and export, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import dates, labels, prices, speech
from factloom.functions import text as T
from factloom.operators import audit, center, coverage, export, gate, review
from factloom.plans import entities as E
from factloom.plans import modes
from factloom.plans.registry import any_sql, case_sql, in_sql, query, read
from factloom.shipping import ship
from factloom.sources import batches, layout, restore, sheets

# ---- the gate, its checks and the router ----

ASKED = "concat_ws(' ', nullif(qa, ''), nullif(qb, ''))"
PRICES = """list_distinct(list_concat(list_transform(regexp_extract_all({0}, '([0-9]+(?:\\.[0-9]+)?)万元', 1), lambda x: round(x::DOUBLE, 2)),
 list_transform(regexp_extract_all({0}, '(^|[^0-9])([1-9][0-9]{{1,2}}(?:,[0-9]{{3}})+|[1-9][0-9]{{4,6}})元', 2), lambda x: round(replace(x, ',', '')::DOUBLE / 10000, 2))))"""
MISSING = f"(trim(answer) = '' OR {any_sql('answer', gate.MISSING)} OR ({any_sql('answer', gate.MISSING_HINTS)} AND {any_sql('answer', gate.MISSING_BESIDE)}))"
BLOCKED = f"""(NOT exportable OR lower(answer_type) = 'need_confirm' OR trim(need_confirm) IN {in_sql(gate.CONFIRM)} OR review_type IN {in_sql(gate.BLOCKING_REVIEW)}
 OR (trim("trim") = '需确认' AND {any_sql('whole', gate.HIGH_RISK)}) OR (topic = '价格' AND trim("trim") = '全系' AND {any_sql('whole', gate.SINGLE_PRICE)} AND len({PRICES.format('whole')}) = 1)
 OR regexp_matches(whole, '{'|'.join(gate.UNCLEAR)}') OR lower(knowledge_status) IN {in_sql(gate.BLOCKING_STATUS)} OR {MISSING})"""
OTHER = "CASE WHEN category <> '' THEN category WHEN module <> '' THEN module ELSE '其他' END"
ITEMS = f"""SELECT *, NOT {BLOCKED} AS live FROM (SELECT *, {case_sql('whole', gate.TOPICS, OTHER)} AS topic FROM (SELECT *, {ASKED} AS asked, list_filter([ra, rb], lambda x: x <> '') AS refs,
 concat_ws(' ', brand, model, "trim", category, module, intent, answer_type, answer, review_type, knowledge_status, {ASKED}) AS whole, concat_ws(' ', category, module, {ASKED}, answer) AS checked,
 replace(model, ' ', '') AS model_key FROM ({E.duck(E.ITEMS)})))"""
JUDGED = f"SELECT *, live AND (answer_type IN ('fact_answer', 'sales_translation') OR len(refs) > 0) AS effective FROM ({ITEMS})"


@query(
    f"""WITH j AS ({JUDGED}), e AS (SELECT DISTINCT brand, model_key, topic FROM j WHERE effective)
SELECT rag_id, live AS exportable, CASE WHEN live THEN NULL WHEN e.topic IS NOT NULL THEN '{gate.COVERED_REASON}' ELSE '{gate.DEFAULT_REASON}' END AS export_block_reason,
CASE WHEN live OR review_type IN {in_sql(gate.BLOCKING_REVIEW)} THEN review_type ELSE 'missing' END AS review_type,
CASE WHEN live THEN knowledge_status WHEN review_type IN ('conflict', 'inference', 'range_issue') THEN 'unconfirmed' ELSE 'missing' END AS knowledge_status
FROM j LEFT JOIN e USING (brand, model_key, topic)"""
)
def quality_gate(spark, sf_dir):
    return gate.gated(E.items(spark, sf_dir)).select("rag_id", "exportable", "export_block_reason", "review_type", "knowledge_status")


@query(f"SELECT rag_id, topic, effective FROM ({JUDGED})")
def quality_topics(spark, sf_dir):
    return gate.judged(E.items(spark, sf_dir)).select("rag_id", "topic", "effective")


@query(
    f"""WITH p AS (SELECT *, {PRICES.format('answer')} AS prices, CASE WHEN "trim" = '' THEN '全系' ELSE "trim" END AS t FROM ({JUDGED}) WHERE effective AND topic = '价格'),
g AS (SELECT brand, t, arg_min(model, ord) AS model, list_sort(list_distinct(list(prices[1]))) AS prices FROM p WHERE len(prices) = 1 GROUP BY brand, model_key, t)
SELECT brand, model, t AS "trim", model || t || '存在多个价格：' || array_to_string(list_transform(prices, lambda v: regexp_replace(printf('%.2f', v), '\\.?0+$', '') || '万元'), '、') AS item FROM g WHERE len(prices) > 1"""
)
def price_conflicts(spark, sf_dir):
    return gate.price_conflicts(E.items(spark, sf_dir))


@query(
    f"""WITH j AS ({JUDGED}) SELECT DISTINCT model FROM j m WHERE live AND model <> '' AND topic = '价格' AND NOT EXISTS (SELECT 1 FROM j g WHERE g.live AND g.topic = '价格' AND g."trim" = '全系' AND g.model = m.model)"""
)
def price_overview_missing(spark, sf_dir):
    priced = gate.judged(E.items(spark, sf_dir)).where("exportable_now and model <> '' and topic = '价格'")
    whole = priced.where(F.col("trim") == gate.WHOLE_RANGE).select("model").distinct()
    return priced.select("model").distinct().join(whole, "model", "left_anti")


REASON = f"""CASE WHEN NOT exportable THEN 'exportable=false' WHEN lower(trim(answer_type)) = 'need_confirm' THEN 'answer_type=need_confirm' WHEN lower(trim(need_confirm)) IN {in_sql(gate.CONFIRM)} THEN 'need_confirm'
 WHEN trim(review_type) IN {in_sql(gate.BLOCKING_REVIEW)} THEN 'review_type=' || trim(review_type) WHEN lower(trim(knowledge_status)) IN {in_sql(gate.BLOCKING_STATUS)} THEN 'knowledge_status=' || lower(trim(knowledge_status)) WHEN {MISSING} THEN 'missing_answer' ELSE '' END"""
ISSUES = f"""SELECT rag_id, '{gate.NO_QUESTION}' AS issue_type, 'error' AS risk_level, '' AS detail FROM ({JUDGED}) WHERE trim(asked) = '' UNION ALL SELECT rag_id, '{gate.NO_ANSWER}', 'error', '' FROM ({JUDGED}) WHERE trim(answer) = ''
UNION ALL SELECT rag_id, '{gate.NOT_EXPORTABLE}', 'error', why FROM (SELECT *, {REASON} AS why FROM ({JUDGED})) WHERE why <> '' UNION ALL SELECT rag_id, '{gate.BAD_REFS}', 'warning', '' FROM ({JUDGED}) WHERE live AND list_contains(refs, ' ')"""


@query(ISSUES)
def rule_qc(spark, sf_dir):
    return gate.rule_issues(E.items(spark, sf_dir))


@query(
    f"SELECT total_rag, warning, error, greatest(total_rag - warning - error, 0) AS pass, CASE WHEN error > 0 THEN '需处理' WHEN warning > 0 THEN '需优化' ELSE '通过' END AS overall_result FROM (SELECT (SELECT count(*) FROM part) AS total_rag, count(*) FILTER (risk_level = 'warning') AS warning, count(*) FILTER (risk_level = 'error') AS error FROM ({ISSUES}))"
)
def qc_summary(spark, sf_dir):
    items = E.items(spark, sf_dir)
    return gate.qc_summary(items, gate.rule_issues(items))


SIGNALS = f"""concat_ws(',', CASE WHEN lower(knowledge_type) IN {in_sql(gate.DYNAMIC_TYPES)} THEN 'DYNAMIC_KNOWLEDGE' END, CASE WHEN len(list_filter(refs, lambda r: trim(r) <> '')) > 1 THEN 'MULTI_FACT' END,
 CASE WHEN len(regexp_extract_all(answer, '[0-9]+(\\.[0-9]+)?')) >= 3 THEN 'MULTI_NUMERIC_CONDITION' END, CASE WHEN {any_sql('said', gate.POLICY_WORDS)} THEN 'POLICY_OR_PRICE_SIGNAL' END, CASE WHEN {any_sql('said', gate.SCOPE_WORDS)} THEN 'SCOPE_COMPLEXITY' END)"""


@query(
    f"""SELECT rag_id, CASE WHEN hit OR NOT live THEN 'rule_issue' WHEN signals <> '' THEN 'llm' ELSE 'rule_pass' END AS route, CASE WHEN hit THEN 'RULE_ISSUE' WHEN NOT live THEN 'NON_EXPORTABLE' WHEN signals <> '' THEN signals ELSE 'LOW_RISK_STATIC_SINGLE_FACT' END AS reasons
FROM (SELECT *, {SIGNALS} AS signals, rag_id IN (SELECT rag_id FROM ({ISSUES})) AS hit FROM (SELECT *, concat_ws(' ', brand, model, "trim", category, knowledge_type, module, intent, answer, asked) AS said FROM ({JUDGED})))"""
)
def risk_route(spark, sf_dir):
    items = E.items(spark, sf_dir)
    return gate.routes(items, gate.rule_issues(items))


DATED = f"(regexp_matches(checked, '{gate.DATE}') AND {any_sql('checked', dates.DATE_WORDS)})"
NAMED = "list_filter([" + ", ".join(f"CASE WHEN contains(answer, '{w}') THEN '{w}' END" for w in gate.VERSION_WORDS) + "], lambda w: w IS NOT NULL)"
ROW_RULES = {
    gate.VERSION_MISMATCH: f"\"trim\" <> '' AND \"trim\" NOT IN ('全系', '不同版本') AND len({NAMED}) >= 2 AND len(list_filter({NAMED}, lambda w: NOT contains(\"trim\", w))) > 0",
    gate.TOO_LONG: "knowledge_type = 'dynamic' AND length(answer) > 180",
    gate.CONTRADICTION: f"contains(answer, '除180系列外') AND {any_sql('answer', gate.EXCLUDED_BESIDE)}",
    gate.MISPLACED: f"knowledge_type = 'static' AND ({any_sql('checked', gate.STRONG_POLICY)} OR {DATED} OR ({any_sql('checked', gate.POLICY_SOURCES)} AND NOT {any_sql('checked', gate.STATIC_SERVICE)}))",
    gate.ADAS_CLAIM: any_sql("answer", gate.ADAS_WORDS),
    gate.TOO_BROAD: " + ".join(f"{any_sql('asked', w)}::INT" for w in gate.QUESTION_KINDS.values()) + " >= 2",
}


@query(" UNION ALL ".join(f"SELECT rag_id, '{kind}' AS issue_type, 'warning' AS risk_level, '' AS detail FROM ({JUDGED}) WHERE live AND ({rule})" for kind, rule in ROW_RULES.items()))
def qc_rows(spark, sf_dir):
    return gate.row_issues(E.items(spark, sf_dir))


def _squeezed_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '\\s+', '', 'g'), '{gate.MARKS}', '', 'g')".replace("\"']", "\"'']")


CORE = "\"trim\" IN ('全系', '不同版本')"


@query(
    f"""WITH v AS (SELECT * FROM ({JUDGED}) WHERE live), d AS (SELECT arg_min(rag_id, ord) AS rag_id FROM v GROUP BY model, category, {_squeezed_sql('asked')}, left({_squeezed_sql('answer')}, 80) HAVING count(DISTINCT "trim") > 1),
m AS (SELECT DISTINCT model, category, regexp_extract(x, '^[0-9]+') || '年' || regexp_extract(x, '^[0-9]+[年./-]([0-9]+)', 1)::INT || '月' AS month FROM (SELECT model, category, unnest(regexp_extract_all(checked, '{dates.PERIOD}')) AS x FROM v WHERE knowledge_type = 'dynamic' AND {any_sql('checked', dates.DATE_WORDS)})),
p AS (SELECT model, category, array_to_string(list_sort(list(month)), '、') AS months FROM m GROUP BY 1, 2 HAVING count(*) > 1),
b AS (SELECT model, count(*) AS n, count(*) FILTER ({any_sql('checked', gate.CONFIG_WORDS)}) AS config, count(*) FILTER ({CORE} AND {any_sql('checked', gate.CORE_WORDS)}) AS core, count(*) FILTER ({any_sql('checked', gate.PRICE_WORDS)} AND NOT ({CORE} OR "trim" = '')) AS vp, count(*) FILTER ({any_sql('checked', gate.PRICE_WORDS)} AND ({CORE} OR "trim" = '')) AS mp FROM v WHERE model <> '' GROUP BY 1)
SELECT rag_id, '{gate.DUPLICATE}' AS issue_type, '' AS detail, 'warning' AS risk_level FROM d UNION ALL SELECT '', '{gate.MIXED_PERIODS}', '发现' || model || '存在多个' || category || '周期：' || months, 'warning' FROM p
UNION ALL SELECT '', '{gate.CONFIG_HEAVY}', model, 'warning' FROM b WHERE n >= 10 AND config / n::DOUBLE > 0.45 AND core < 4 UNION ALL SELECT '', '{gate.NO_OVERVIEW}', model, 'warning' FROM b WHERE vp >= 2 AND mp = 0"""
)
def qc_groups(spark, sf_dir):
    return gate.group_issues(E.items(spark, sf_dir))


@query("SELECT 'R' || l_partkey AS rag_id, l_returnflag AS issue_type, l_linestatus AS description, min(l_orderkey * 10 + l_linenumber) AS ord FROM lineitem GROUP BY 1, 2, 3")
def issue_dedup(spark, sf_dir):
    issues = read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("R"), F.col("l_partkey").cast("string")).alias("rag_id"), F.col("l_returnflag").alias("issue_type"), F.col("l_linestatus").alias("description"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord")
    )
    return gate.distinct_issues(issues)


# ---- sheets ----

GRID = E.duck(E.GRID)
SUPPLIERS = "(SELECT s_suppkey, s_name, s_nationkey AS nk, CAST(round(abs(s_acctbal)) AS BIGINT) AS amount, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier)"


@query(f"SELECT 'f' || nk % 3 AS file, nk::VARCHAR AS sheet, CASE WHEN nk % 2 = 0 AND count(*) >= 2 THEN '{layout.MATRIX}' ELSE '{layout.ROWS}' END AS orientation FROM {SUPPLIERS} GROUP BY nk")
def sheet_orientation(spark, sf_dir):
    return layout.orientation(E.grid(spark, sf_dir))


@query(f"""SELECT 'f' || nk % 3 AS file, nk::VARCHAR AS sheet, k AS record, concat_ws(chr(10), '品牌: 牌' || nk, '车系 名称: 系' || k, '车型名称: ' || s_name, '厂商指导价: ' || amount, CASE WHEN s_suppkey % 3 > 0 THEN '能源类型: 电动' END,
 CASE WHEN s_suppkey % 2 > 0 THEN '备注: 注' || s_suppkey END, '备注' || CASE WHEN s_suppkey % 2 > 0 THEN '_2' ELSE '' END || ': 另' || s_suppkey) AS text FROM {SUPPLIERS} WHERE nk % 2 = 0""")
def vehicle_records(spark, sf_dir):
    return layout.matrix_records(E.grid(spark, sf_dir)).withColumn("record", F.col("record").cast("long"))


@query(f"SELECT DISTINCT 'f' || nk % 3 AS file, nk::VARCHAR AS sheet, 1 AS index FROM {SUPPLIERS} WHERE nk % 2 = 1 AND nk % 7 <> 3")
def sheet_headers(spark, sf_dir):
    grid = E.grid(spark, sf_dir).where(F.col("sheet").cast("int") % 2 == 1)
    return layout.header_rows(layout.sheet_rows(grid))


@query(f"SELECT 'f' || nk % 3 AS file, nk::VARCHAR AS sheet, k AS record, concat_ws(chr(10), '序号: ' || k, '名称: ' || s_name, '字段3: ' || amount, CASE WHEN s_suppkey % 4 > 0 THEN '名称_2: 说' || k END) AS text FROM {SUPPLIERS} WHERE nk % 2 = 1 AND nk % 7 <> 3")
def table_records(spark, sf_dir):
    rows = layout.sheet_rows(E.grid(spark, sf_dir).where(F.col("sheet").cast("int") % 2 == 1))
    return layout.table_records(rows, layout.header_rows(rows)).withColumn("record", F.col("record").cast("long"))


RECORD_TEXT = {
    "matrix": "'【车型记录' || k || '】' || chr(10) || concat_ws(chr(10), '品牌: 牌' || nk, '车系 名称: 系' || k, '车型名称: ' || s_name, '厂商指导价: ' || amount, CASE WHEN s_suppkey % 3 > 0 THEN '能源类型: 电动' END, CASE WHEN s_suppkey % 2 > 0 THEN '备注: 注' || s_suppkey END, '备注' || CASE WHEN s_suppkey % 2 > 0 THEN '_2' ELSE '' END || ': 另' || s_suppkey)",
    "table": "'记录' || k || '：' || chr(10) || concat_ws(chr(10), '序号: ' || k, '名称: ' || s_name, '字段3: ' || amount, CASE WHEN s_suppkey % 4 > 0 THEN '名称_2: 说' || k END)",
    "plain": "'记录' || (k + 1) || '：' || chr(10) || '列2: ' || s_name || chr(10)",
}


@query(
    f"""SELECT 'f' || nk % 3 AS file, nk::VARCHAR AS sheet, '{layout.MATRIX}' AS orientation, '{layout.MATRIX_MARK}' || chr(10) || string_agg(chr(10) || {RECORD_TEXT['matrix']}, chr(10) ORDER BY k) AS text FROM {SUPPLIERS} WHERE nk % 2 = 0 GROUP BY nk HAVING count(*) >= 2
UNION ALL SELECT 'f' || nk % 3, nk::VARCHAR, '{layout.ROWS}', '{layout.PREFACE_MARK}' || chr(10) || '用户购车权益说明' || chr(10) || chr(10) || '字段：序号 | 名称 | 字段3 | 名称_2' || chr(10) || string_agg(chr(10) || {RECORD_TEXT['table']}, chr(10) ORDER BY k) FROM {SUPPLIERS} WHERE nk % 2 = 1 AND nk % 7 <> 3 GROUP BY nk
UNION ALL SELECT 'f' || nk % 3, nk::VARCHAR, '{layout.ROWS}', '记录1：' || chr(10) || '列1: 用户购车权益说明' || chr(10) || chr(10) || string_agg({RECORD_TEXT['plain']}, chr(10) ORDER BY k) FROM {SUPPLIERS} WHERE nk % 2 = 1 AND nk % 7 = 3 GROUP BY nk"""
)
def sheet_texts(spark, sf_dir):
    """Sheets of one vehicle, which are read as tables, are left to the tests: their header is a label row."""
    grid = E.grid(spark, sf_dir)
    lone = grid.where(F.col("sheet").cast("int") % 2 == 0).groupBy("file", "sheet").agg(F.max("col").alias("last")).where("last < 2")
    return layout.sheet_texts(grid.join(lone, ["file", "sheet"], "left_anti"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CASE WHEN o_custkey % 2 = 0 THEN '是' ELSE '否' END WHEN 1 THEN CAST(o_custkey AS VARCHAR) WHEN 2 THEN o_custkey || '.' || (1 + o_orderkey % 9) ELSE strftime(o_orderdate, '%Y-%m-%d') END AS text FROM orders""")
def cell_texts(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    value = F.when(k == 0, F.when(F.col("o_custkey") % 2 == 0, "true").otherwise("0")).when(k == 1, F.concat(F.col("o_custkey").cast("string"), F.lit(".0"))).when(k == 2, F.concat(F.col("o_custkey").cast("string"), F.lit("."), (1 + F.col("o_orderkey") % 9).cast("string"), F.lit("000000000"))).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd 00:00:00"))
    kind = F.when(k == 0, "b").when(k == 3, "d").otherwise("n")
    return read(spark, sf_dir, "orders").select("o_orderkey", layout.cell_text(value, kind).alias("text"))


@query("SELECT p_partkey % 7 AS sheet, p_partkey AS row, p_partkey % 3 AS col, CASE WHEN p_partkey % 21 < 7 THEN 'top' || p_partkey % 7 ELSE p_name END AS value FROM part WHERE p_partkey <= (SELECT max(p_partkey) FROM part)")
def merged_cells(spark, sf_dir):
    """Every sheet has one merged range, its first 7 cells of each 21 stand in it; all of it shows the top-left value."""
    part = read(spark, sf_dir, "part")
    inside = F.col("p_partkey") % 21 < 7
    cells = part.select(F.lit("f").alias("file"), (F.col("p_partkey") % 7).alias("sheet"), F.col("p_partkey").alias("row"), (F.col("p_partkey") % 3).alias("col"), F.col("p_name").alias("value"))
    tops = part.where(inside).select(F.lit("f").alias("file"), (F.col("p_partkey") % 7).alias("sheet"), F.col("p_partkey").alias("r1"), (F.col("p_partkey") % 3).alias("c1"), F.col("p_partkey").alias("r2"), (F.col("p_partkey") % 3).alias("c2"))
    shown = cells.withColumn("value", F.when(F.col("row") % 21 < 7, F.concat(F.lit("top"), F.col("sheet").cast("string"))).otherwise(F.col("value")))
    return sheets.merged_expanded(shown, tops).drop("file")


# ---- labels, kinds and spoken answers ----

LINES = "SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_linenumber % 5 WHEN 0 THEN 'ADDED' WHEN 1 THEN 'UPDATED' WHEN 2 THEN 'UNCHANGED' WHEN 3 THEN 'REVIEW_REQUIRED' ELSE 'OTHER' END AS change, CASE l_returnflag WHEN 'A' THEN 'PRICE_CHANGED' WHEN 'N' THEN 'LOW_CONFIDENCE' ELSE 'X' END AS code, l_partkey % 2 AS half FROM lineitem"


@query(
    f"""SELECT id, CASE change WHEN 'ADDED' THEN '新增' WHEN 'UPDATED' THEN '更新' WHEN 'UNCHANGED' THEN '未变化' WHEN 'REVIEW_REQUIRED' THEN '待确认' ELSE change END AS change, CASE code WHEN 'PRICE_CHANGED' THEN '{labels.REASONS['PRICE_CHANGED']}' ELSE code END AS reason, CASE code WHEN 'LOW_CONFIDENCE' THEN '匹配置信度不足' ELSE code END AS review,
CASE change WHEN 'ADDED' THEN '识别到一条新的' || CASE WHEN half = 0 THEN '知识' ELSE '价格' END || '。' WHEN 'UPDATED' THEN CASE WHEN half = 0 THEN '回答' ELSE 'answer、price' END || '发生变化，建议人工复核后更新。' WHEN 'UNCHANGED' THEN CASE WHEN half = 0 THEN '新旧知识内容一致。' ELSE '核心答案未变化，仅问法或格式存在差异。' END ELSE '' END AS summary FROM ({LINES})"""
)
def change_labels(spark, sf_dir):
    E.load(spark, sf_dir, "lineitem")
    half = F.col("half") == 0
    fields = F.when(half, F.array().cast("array<string>")).otherwise(F.array(F.lit("answer"), F.lit("price")))
    return spark.sql(LINES).select(
        "id", labels.labelled(F.col("change"), labels.CHANGES).alias("change"), labels.labelled(F.col("code"), labels.REASONS).alias("reason"), labels.labelled(F.col("code"), labels.REVIEW_REASONS).alias("review"), labels.change_summary(F.col("change"), fields, F.when(half, "").otherwise("价格")).alias("summary")
    )


KINDS = "SELECT ord, category, module, answer, qa, CASE ord % 5 WHEN 0 THEN 'static' WHEN 1 THEN 'Dynamic' WHEN 2 THEN 'store' ELSE '' END AS given FROM ({0}) t"


@query(
    f"""SELECT ord, CASE WHEN lower(given) IN {in_sql(labels.KNOWN_KINDS)} THEN lower(given) ELSE {case_sql('x', labels.KIND_WORDS, "CASE lower(given) WHEN 'dynamic' THEN 'policy' WHEN 'static' THEN 'product' ELSE 'general' END")} END AS kind, CASE WHEN ord % 3 = 0 AND category <> '' THEN category ELSE {case_sql('y', labels.CATEGORY_WORDS, "'通用'")} END AS category
FROM (SELECT *, category || ' ' || module AS x, qa || ' ' || answer AS y FROM ({KINDS.format(E.duck(E.ITEMS))}))"""
)
def inferred_kinds(spark, sf_dir):
    E.load(spark, sf_dir, "part")
    c = F.col
    given = F.when(c("ord") % 3 == 0, c("category")).otherwise("")
    return spark.sql(KINDS.format(E.ITEMS)).select("ord", labels.internal_kind(c("given"), c("category"), c("module")).alias("kind"), labels.inferred_category(c("qa"), c("answer"), given).alias("category"))


@query(
    """SELECT p_partkey, regexp_replace(printf('%.2f', (10000 + p_partkey % 900 * 100) / 10000.0), '\\.?0+$', '') || '万元，功率' || p_size || '千瓦，' || p_size || '伏，优惠百分之' || CASE WHEN p_partkey % 9 + 1 < 10 THEN substr('零一二三四五六七八九', (p_partkey % 9 + 2)::BIGINT, 1) END || '，' || p_size || 'GB流量，4K高清，智能驾驶辅助系统' AS said FROM part"""
)
def answers_aloud(spark, sf_dir):
    s = lambda x: x.cast("string")
    amount, k = F.lit(10000) + F.col("p_partkey") % 900 * 100, F.col("p_size")
    answer = F.concat(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("￥"), s(amount))).otherwise(F.concat(F.format_number(amount, 0), F.lit("元"))), F.lit("，功率"), s(k), F.lit("kW，"), s(k), F.lit(" V，优惠"), s(F.col("p_partkey") % 9 + 1), F.lit("%，"), s(k), F.when(F.col("p_partkey") % 3 == 0, "G").otherwise("GB"), F.lit("，4K，ADS智能驾驶辅助系统"))
    return read(spark, sf_dir, "part").select("p_partkey", speech.answer_aloud(answer).alias("said"))


# ---- export and adapters ----


@query(
    f"""SELECT kind, model, "trim", asked, answer, category FROM (SELECT CASE WHEN knowledge_type IN ('static', 'dynamic') THEN knowledge_type WHEN {any_sql("category || ' ' || module || ' ' || answer", export.DYNAMIC_WORDS)} THEN 'dynamic' ELSE 'static' END AS kind, model, "trim", concat_ws(chr(10), nullif(qa, ''), nullif(qb, '')) AS asked,
CASE WHEN category <> '' THEN category ELSE module END AS category, CASE WHEN starts_with(answer, '售价') THEN '售价' || regexp_replace(printf('%.2f', (1000 + ord % 90 * 10) / 100.0), '\\.?0+$', '') || '万元，' || split_part(answer, '，', 2) ELSE answer END AS answer FROM ({JUDGED}) WHERE live)"""
)
def export_rows(spark, sf_dir):
    return export.rows(E.items(spark, sf_dir)).select("kind", "model", "trim", F.col("question").alias("asked"), "answer", "category")


@query(f"SELECT kind AS sheet, count(*) AS items, count(DISTINCT model) AS models FROM (SELECT *, CASE WHEN knowledge_type IN ('static', 'dynamic') THEN knowledge_type WHEN {any_sql('''category || ' ' || module || ' ' || answer''', export.DYNAMIC_WORDS)} THEN 'dynamic' ELSE 'static' END AS kind FROM ({JUDGED}) WHERE live) GROUP BY 1")
def exportable_split(spark, sf_dir):
    return export.rows(E.items(spark, sf_dir)).groupBy(F.col("kind").alias("sheet")).agg(F.count(F.lit(1)).alias("items"), F.count_distinct("model").alias("models"))


@query("SELECT s_nationkey, CASE WHEN count(DISTINCT s_nationkey % 2) = 1 AND count(DISTINCT s_suppkey) = 1 THEN CASE WHEN s_nationkey % 2 = 0 THEN '牌' ELSE '号' END || min(s_name) WHEN true THEN CASE WHEN s_nationkey % 2 = 0 THEN '牌' ELSE '号' END END AS project FROM supplier GROUP BY 1")
def project_names(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").select("s_nationkey", F.when(F.col("s_nationkey") % 2 == 0, "牌").otherwise("号").alias("brand"), F.col("s_name").alias("model"))
    return export.project_name(rows, ["s_nationkey"], F.lit("x")).withColumnRenamed("name", "project")


@query(f"SELECT rag_id AS knowledge_id, CASE WHEN qa <> '' THEN qa ELSE qb END AS question, lower(replace(CASE WHEN qa <> '' THEN qa ELSE qb END, ' ', '')) AS normalized_question, {case_sql('x', labels.KIND_WORDS, '''CASE WHEN knowledge_type = 'dynamic' THEN 'policy' ELSE 'product' END''')} AS kind, need_confirm IN {in_sql(labels.YES)} AS need_confirm FROM (SELECT *, category || ' ' || module AS x FROM ({E.duck(E.ITEMS)})) WHERE knowledge_type <> 'finance' UNION ALL SELECT rag_id, CASE WHEN qa <> '' THEN qa ELSE qb END, lower(replace(CASE WHEN qa <> '' THEN qa ELSE qb END, ' ', '')), 'finance', need_confirm IN {in_sql(labels.YES)} FROM ({E.duck(E.ITEMS)}) WHERE knowledge_type = 'finance'")
def rag_to_knowledge(spark, sf_dir):
    return export.knowledge_items(E.items(spark, sf_dir)).select("knowledge_id", "question", "normalized_question", F.col("knowledge_type").alias("kind"), "need_confirm")


SHEET = "SELECT 'f' || p_partkey % 3 AS file, p_partkey AS index, p_type AS model, '全系' AS ver, CASE WHEN p_partkey % 9 = 0 THEN ' ' ELSE p_name || '多少钱' END AS q, CASE WHEN p_partkey % 18 = 0 THEN '' ELSE CAST(p_size AS STRING) || '万元' END AS a, CASE p_partkey % 3 WHEN 0 THEN '价格' WHEN 1 THEN '' ELSE '配置' END AS cat FROM part"


@query(f"SELECT 'XLSX-' || left(sha1(file || '|' || index || '|' || q || '|' || a || '|' || cat), 12) AS knowledge_id, lower(replace(q, ' ', '')) AS normalized_question, CASE cat WHEN '价格' THEN 'price' WHEN '配置' THEN 'product' ELSE 'general' END AS knowledge_type FROM ({E.duck(SHEET)}) WHERE trim(q) <> '' OR trim(a) <> ''")
def restored_sheets(spark, sf_dir):
    E.load(spark, sf_dir, "part")
    rows = spark.sql(SHEET).toDF("file", "index", "车型", "版本", "问题", "回答", "分类")
    return restore.excel_items(rows).select("knowledge_id", "normalized_question", "knowledge_type")


# ---- restoring documents ----

STANDARD = """SELECT s_nationkey AS doc_id, s_suppkey * 10 + l.r AS line, CASE l.r WHEN 0 THEN CASE WHEN s_suppkey % 13 = 0 THEN '备注' ELSE '{' END WHEN 1 THEN '"车系":"' || s_name || '",' WHEN 2 THEN '"问题":"价格多少' || s_suppkey % 4 || '",'
 WHEN 3 THEN '"答案":' || CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE '"' END || '约' || s_suppkey % 4 || '万"' WHEN 4 THEN CASE WHEN s_suppkey % 13 = 0 THEN '完' ELSE '}' END END AS text FROM supplier CROSS JOIN (SELECT 0 AS r UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) l"""


@query("SELECT s_nationkey::BIGINT AS doc_id, s_suppkey * 10 AS first, CASE WHEN s_suppkey % 5 = 0 THEN 'repaired' ELSE 'strict' END AS mode, 'qa_v1' AS state, '价格多少' || s_suppkey % 4 AS question, '约' || s_suppkey % 4 || '万' AS answer, s_name AS model FROM supplier WHERE s_suppkey % 13 <> 0")
def standard_records(spark, sf_dir):
    ship(spark)
    E.load(spark, sf_dir, "supplier")
    lines = spark.sql(STANDARD).withColumn("doc_id", F.col("doc_id").cast("long"))
    return restore.standard_records(lines).select("doc_id", "first", "mode", "state", "question", "answer", "model")


@query("SELECT s_nationkey::BIGINT AS doc_id, count(*) AS candidates, count(*) FILTER (s_suppkey % 5 <> 0) AS strict, count(*) FILTER (s_suppkey % 5 = 0) AS repaired, 0 AS failed, count(*) >= 3 AS standard, 0 AS duplicate_exact FROM supplier WHERE s_suppkey % 13 <> 0 GROUP BY 1")
def standard_report(spark, sf_dir):
    ship(spark)
    E.load(spark, sf_dir, "supplier")
    lines = spark.sql(STANDARD).withColumn("doc_id", F.col("doc_id").cast("long"))
    return restore.standard_report(restore.standard_records(lines)).select("doc_id", "candidates", "strict", "repaired", F.col("failed").cast("int").alias("failed"), "standard", F.col("duplicate_exact").cast("int").alias("duplicate_exact"))


PARAGRAPHS = """SELECT s_nationkey AS doc_id, s_suppkey * 10 + l.r AS line, CASE l.r WHEN 0 THEN CASE s_suppkey % 3 WHEN 0 THEN '1、' || s_name || '多少钱？' WHEN 1 THEN 'Q：' || s_name || '续航 A：' || s_suppkey || '公里' ELSE s_name || '政策说明' END
 WHEN 1 THEN CASE s_suppkey % 3 WHEN 0 THEN '答：约' || s_suppkey || '万元' WHEN 1 THEN '问：配置如何' ELSE '本条为正文内容共若干字' || s_suppkey END ELSE CASE s_suppkey % 3 WHEN 0 THEN '以门店为准' WHEN 1 THEN '回答：齐全' ELSE '补充' END END AS text FROM supplier CROSS JOIN (SELECT 0 AS r UNION ALL SELECT 1 UNION ALL SELECT 2) l"""


@query(
    """SELECT s_nationkey::BIGINT AS doc_id, CASE s_suppkey % 3 WHEN 0 THEN 'paragraph' WHEN 1 THEN 'inline' ELSE 'heading' END AS source, s_name || CASE s_suppkey % 3 WHEN 0 THEN '多少钱？' WHEN 1 THEN '续航' ELSE '政策说明' END AS question,
CASE s_suppkey % 3 WHEN 0 THEN '约' || s_suppkey || '万元 以门店为准' WHEN 1 THEN s_suppkey || '公里' ELSE '本条为正文内容共若干字' || s_suppkey || ' 补充' END AS answer, CASE s_suppkey % 3 WHEN 0 THEN '价格' WHEN 1 THEN '续航' ELSE '通用' END AS category FROM supplier
UNION ALL SELECT s_nationkey::BIGINT, 'paragraph', '配置如何', '齐全', '配置' FROM supplier WHERE s_suppkey % 3 = 1"""
)
def fast_items(spark, sf_dir):
    """One document a supplier, so that each form's lines stand alone; doc_id is the nation again in the result."""
    ship(spark)
    E.load(spark, sf_dir, "supplier")
    lines = spark.sql(PARAGRAPHS).select(F.floor(F.col("line") / 10).alias("doc_id"), "line", "text", F.col("doc_id").cast("long").alias("nation"))
    nations = lines.select("doc_id", "nation").distinct()
    return restore.fast_items(lines.drop("nation")).join(nations, "doc_id").select(F.col("nation").alias("doc_id"), "source", "question", "answer", "category")


@query("SELECT l_orderkey * 10 + l_linenumber AS id, l_linenumber % 2 = 0 OR l_linenumber % 7 = 1 AS question, CASE WHEN l_linenumber % 2 = 0 THEN '价格' || l_partkey || '？' WHEN l_linenumber % 7 = 1 THEN '配置' || l_partkey ELSE '答：有' || l_partkey END AS asked, l_linenumber % 2 = 1 AND l_linenumber % 7 <> 1 AS answer, '有' || l_partkey AS said FROM lineitem")
def line_kinds(spark, sf_dir):
    n, k = F.col("l_linenumber"), F.col("l_partkey").cast("string")
    line = F.when(n % 2 == 0, F.concat(F.lit("（3）价格"), k, F.lit("？"))).when(n % 7 == 1, F.concat(F.lit("二、问： 配置"), k)).otherwise(F.concat(F.lit("答：有"), k))
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + n).alias("id"), line.alias("line"), k.alias("k"))
    c = F.col("line")
    return rows.select("id", restore.is_question(c).alias("question"), restore.question_of(c).alias("asked"), restore.is_answer(c).alias("answer"), restore.answer_of(F.concat(F.lit("回答:有"), "k")).alias("said"))


@query("SELECT p_partkey, p_partkey % 5 > 1 AS valid FROM part")
def valid_pairs(spark, sf_dir):
    k = F.col("p_partkey") % 5
    question = F.when(k == 0, '{"问题": 1}').when(k == 1, F.concat(F.repeat(F.lit("长"), 121), F.col("p_name"))).otherwise(F.concat(F.col("p_name"), F.lit("？")))
    return read(spark, sf_dir, "part").select("p_partkey", restore.valid_pair(question, F.lit("有的")).alias("valid"))


# ---- batches, coverage, decisions, audits ----


@query(
    """WITH RECURSIVE r AS (SELECT s_nationkey AS doc_id, s_suppkey, 30 + 5 * (s_suppkey % 7) AS n, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier),
b AS (SELECT doc_id, k, 0 AS batch, CASE WHEN 12 + n > 60 THEN 0 ELSE 1 END AS held, CASE WHEN 12 + n > 60 THEN 0 ELSE 12 + n END AS size FROM r WHERE k = 1
UNION ALL SELECT r.doc_id, r.k, CASE WHEN 12 + n > 60 THEN batch + 1 WHEN held = 0 OR held >= 3 OR size + 2 + n > 60 THEN batch + 1 ELSE batch END, CASE WHEN 12 + n > 60 THEN 0 WHEN held = 0 OR held >= 3 OR size + 2 + n > 60 THEN 1 ELSE held + 1 END, CASE WHEN 12 + n > 60 THEN 0 WHEN held = 0 OR held >= 3 OR size + 2 + n > 60 THEN 12 + n ELSE size + 2 + n END FROM b JOIN r ON r.doc_id = b.doc_id AND r.k = b.k + 1)
SELECT doc_id::BIGINT AS doc_id, k::INT AS record, batch::INT AS batch FROM b"""
)
def record_batches(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("doc_id"), F.col("s_suppkey").alias("place"), (30 + 5 * (F.col("s_suppkey") % 7)).cast("int").alias("chars"))
    return batches.record_batches(rows, F.lit(10), size=3, max_chars=60).select("doc_id", "record", "batch")


GROUPS = "SELECT 'G' || o_custkey AS group_id, o_custkey AS group_ord, 'D' || o_orderkey AS diff_id, o_orderkey % 2 = 0 AS is_new, CASE o_orderkey % 3 WHEN 0 THEN 'UNCHANGED' WHEN 1 THEN 'REVIEW_REQUIRED' ELSE 'UPDATED' END AS change_type, 'K' || o_orderkey AS item_id FROM orders"
CHOICES = "SELECT 'G' || c_custkey AS group_id, CASE c_custkey % 5 WHEN 0 THEN 'KEEP_OLD_ONLY' WHEN 1 THEN 'REPLACE_OLD_WITH_NEW' WHEN 2 THEN 'CUSTOM' ELSE 'ADD_NEW_KEEP_OLD' END AS choice, c_custkey % 10 = 1 AS confirmed FROM customer WHERE c_custkey % 7 > 0"


@query(
    f"""SELECT diff_id, CASE WHEN is_new THEN CASE choice WHEN 'KEEP_OLD_ONLY' THEN 'SKIP' WHEN 'CUSTOM' THEN CASE WHEN picked THEN 'ACCEPT_NEW' ELSE 'SKIP' END ELSE 'ACCEPT_NEW' END ELSE CASE choice WHEN 'REPLACE_OLD_WITH_NEW' THEN 'REMOVE' WHEN 'CUSTOM' THEN CASE WHEN picked THEN 'KEEP_OLD' ELSE 'REMOVE' END ELSE 'KEEP_OLD' END END AS decision,
is_new AND (choice = 'ADD_NEW_KEEP_OLD' OR (choice = 'CUSTOM' AND picked)) AS keep_old, NOT is_new AND confirmed AND (choice = 'REPLACE_OLD_WITH_NEW' OR (choice = 'CUSTOM' AND NOT picked)) AS confirmed
FROM (SELECT g.*, coalesce(choice, 'ADD_NEW_KEEP_OLD') AS choice, coalesce(confirmed, false) AS confirmed, ends_with(item_id, '1') OR ends_with(item_id, '2') AS picked FROM ({GROUPS}) g LEFT JOIN ({CHOICES}) c USING (group_id)) WHERE is_new OR change_type <> 'UPDATED'"""
)
def relation_decisions(spark, sf_dir):
    E.load(spark, sf_dir, "orders", "customer")
    groups = spark.sql(GROUPS)
    picked = groups.where(F.col("item_id").endswith("1") | F.col("item_id").endswith("2")).groupBy("group_id").agg(F.collect_list("item_id").alias("selected"))
    return review.relation_decisions(groups, spark.sql(CHOICES).join(picked, "group_id", "left"))


RECORD_FACTS = "SELECT l_partkey AS record, l_returnflag AS category, CASE l_linenumber % 5 WHEN 0 THEN '现金直降' WHEN 1 THEN '旧车置换' WHEN 2 THEN '贷款免息' WHEN 3 THEN '保养权益' ELSE '限时活动' END AS content, l_orderkey * 10 + l_linenumber AS ord FROM lineitem"
RECORD_SOURCE = "SELECT p_partkey AS record, p_type AS series, CASE WHEN p_partkey % 3 = 0 THEN '暂无' ELSE '有' END AS cash, CASE WHEN p_partkey % 4 = 0 THEN '-' ELSE '有' END AS trade_in, CASE WHEN p_size % 2 = 0 THEN '有' ELSE 'None' END AS finance, '有' AS benefit, CASE WHEN p_size % 5 = 0 THEN '有' ELSE ' 无 ' END AS activity FROM part"


@query(f"SELECT record, category, content, min(ord) AS ord FROM ({RECORD_FACTS}) GROUP BY 1, 2, 3")
def mapping_union(spark, sf_dir):
    E.load(spark, sf_dir, "lineitem")
    rows = spark.sql(RECORD_FACTS)
    return gate.distinct_issues(rows.where("ord % 2 = 0").unionByName(rows.where("ord % 2 = 1")), ("record", "category", "content"))


@query(
    f"""WITH s AS (SELECT record, series, unnest(['cash', 'trade_in', 'finance', 'benefit', 'activity']) AS intent, unnest([cash, trade_in, finance, benefit, activity]) AS value FROM ({RECORD_SOURCE})), f AS (SELECT DISTINCT record, CASE content WHEN '现金直降' THEN 'cash' WHEN '旧车置换' THEN 'trade_in' WHEN '贷款免息' THEN 'finance' WHEN '保养权益' THEN 'benefit' ELSE 'activity' END AS intent FROM ({RECORD_FACTS}))
SELECT intent AS measure, count(f.record) AS covered, count(*) AS total FROM s LEFT JOIN f USING (record, intent) WHERE lower(trim(value)) NOT IN ('', '-', '无', '暂无', 'none', 'null') GROUP BY 1
UNION ALL SELECT 'vehicle', count(*) FILTER (record IN (SELECT record FROM f)), count(*) FROM ({RECORD_SOURCE}) UNION ALL SELECT 'series', count(DISTINCT CASE WHEN record IN (SELECT record FROM f) THEN series END), count(DISTINCT series) FROM ({RECORD_SOURCE})"""
)
def record_coverage(spark, sf_dir):
    E.load(spark, sf_dir, "part", "lineitem")
    return batches.record_coverage(spark.sql(RECORD_SOURCE), spark.sql(RECORD_FACTS))


@query("SELECT event_type AS stratum, count(*) AS n FROM (SELECT CASE WHEN rank_value <= 10 THEN 'suspicious' END AS event_type FROM (SELECT row_number() OVER (ORDER BY value DESC, event_id) AS rank_value FROM events)) WHERE event_type IS NOT NULL GROUP BY 1 UNION ALL SELECT 'risky', 10 UNION ALL SELECT 'random', 10")
def stratified_sample(spark, sf_dir):
    """Ten of each stratum, which is the feature: the report shows thirty rows."""
    rows = read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return review.stratified(rows, "value", F.col("event_type") == "error", "event_id", 10).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT count(*) AS restored, count(DISTINCT nullif(model, '')) AS models, count(*) FILTER (need_confirm IN {in_sql(labels.YES)}) AS need_confirm FROM ({E.duck(E.ITEMS)})")
def restore_counters(spark, sf_dir):
    items = E.items(spark, sf_dir).withColumn("need_confirm", labels.says_yes(F.col("need_confirm")))
    return restore.restore_counters(items)


@query("SELECT doc_id, lower(regexp_replace(text, '\\s+', '', 'g')) = '' AS blank FROM documents")
def blank_texts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", (T.question_key(F.col("text")) == "").alias("blank"))


# ---- prices, scopes, reports, the review centre, audits ----

SAID = "SELECT p_partkey, CAST(round(p_retailprice) AS BIGINT) * 100 AS yuan, CASE p_partkey % 3 WHEN 0 THEN '售价' || CAST(p_size AS STRING) || '.5 万，顶配' || CAST(CAST(round(p_retailprice) AS BIGINT) * 100 AS STRING) || '元' WHEN 1 THEN '优惠' || CAST(CAST(round(p_retailprice) AS BIGINT) * 100 AS STRING) || ' 元，原价' || CAST(CAST(round(p_retailprice) AS BIGINT) * 100 AS STRING) || '元' ELSE '约' || CAST(p_size AS STRING) || '万' END AS t FROM part"


@query(
    f"""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_size + 0.5 = yuan / 10000.0 THEN printf('%.2f', p_size + 0.5) ELSE printf('%.2f,%.2f', p_size + 0.5, yuan / 10000.0) END WHEN 1 THEN printf('%.2f', yuan / 10000.0) ELSE printf('%.2f', p_size::DOUBLE) END AS prices, p_partkey % 3 < 2 OR contains(t, regexp_replace(printf('%.2f', yuan / 10000.0), '\\.?0+$', '')) AS named FROM ({E.duck(SAID)}) JOIN (SELECT p_partkey, p_size FROM part) USING (p_partkey)"""
)
def price_lists(spark, sf_dir):
    E.load(spark, sf_dir, "part")
    return spark.sql(SAID).select("p_partkey", F.array_join(F.transform(prices.price_list(F.col("t")), lambda v: F.format_string("%.2f", v)), ",").alias("prices"), prices.names_price(F.col("t"), F.col("yuan").cast("string")).alias("named"))


@query(f"SELECT ord, CASE WHEN \"trim\" NOT IN ('', '需确认', '全系') AND len({NAMED}) >= 2 AND len(list_filter({NAMED}, lambda w: NOT contains(\"trim\", w))) > 0 THEN '不同版本' ELSE \"trim\" END AS scope FROM ({E.duck(E.ITEMS)})")
def trim_scopes(spark, sf_dir):
    return E.items(spark, sf_dir).select("ord", gate.scoped_trim().alias("scope"))


COVERED = "SELECT event_type AS measure, count(*) AS total, count(CASE WHEN value > 10 THEN 1 END) AS covered FROM events GROUP BY event_type UNION ALL SELECT 'price', count(*), count(CASE WHEN p_size > 2 THEN 1 END) FROM part"


@query(f"SELECT measure, covered, total, round(covered / total::DOUBLE, 4) AS coverage, total - covered AS missing, greatest(0, covered - CASE WHEN measure = 'price' THEN 5 ELSE 0 END) AS fixed, round(covered / total::DOUBLE, 4) >= CASE WHEN measure = 'price' THEN 0.95 ELSE 0.9 END AS passes FROM ({COVERED})")
def coverage_report(spark, sf_dir):
    E.load(spark, sf_dir, "events", "part")
    legacy = spark.createDataFrame([("price", 5)], "measure string, covered long")
    return coverage.coverage_report(spark.sql(COVERED), legacy)


GAPS = "SELECT 'm' || CAST(c_custkey % 5 AS STRING) AS vehicle, CASE c_custkey % 4 WHEN 0 THEN 'conflict' WHEN 1 THEN 'dynamic' ELSE '' END AS review_type, c_name AS question, CASE c_custkey % 3 WHEN 0 THEN '前后矛盾' WHEN 1 THEN '无法判断' ELSE '' END AS reason, CASE WHEN c_custkey % 2 = 0 THEN '补' ELSE '' END AS confirm_content FROM customer"
CONFIRMS = "SELECT s_name AS item, 'inference' AS review_type, 'M' AS model FROM supplier"
CENTER = f"""SELECT CASE WHEN review_type = 'conflict' THEN 'conflict' WHEN review_type = '' THEN 'missing' WHEN contains(reason, '矛盾') THEN 'conflict' WHEN contains(reason, '无法判断') THEN 'inference' ELSE 'missing' END AS kind, vehicle AS model, question AS item, CASE WHEN reason = '' THEN '{center.NOT_FOUND}' ELSE reason END AS reason, CASE WHEN confirm_content = '' THEN '{center.CHECK}' ELSE confirm_content END AS action FROM ({E.duck(GAPS)})
UNION ALL SELECT 'inference', model, item, '{center.NOT_FOUND}', '{center.CHECK}' FROM ({CONFIRMS})
UNION ALL SELECT CASE WHEN review_type IN {in_sql(gate.BLOCKING_REVIEW)} THEN review_type ELSE 'missing' END, CASE WHEN model = '' THEN '{center.ALL_MODELS}' ELSE model END, CASE WHEN asked <> '' THEN asked WHEN category <> '' THEN category ELSE '{center.PENDING}' END, CASE WHEN (brand, model_key, topic) IN (SELECT (brand, model_key, topic) FROM ({JUDGED}) WHERE effective) THEN '{gate.COVERED_REASON}' ELSE '{gate.DEFAULT_REASON}' END, '{center.CHECK}' FROM ({JUDGED}) WHERE NOT live
UNION ALL SELECT 'dynamic_notice', model, asked, '{center.NOTICE}', '{center.NOTICE_ACTION}' FROM ({JUDGED}) WHERE live AND knowledge_type = 'dynamic'"""


def _center(spark, sf_dir):
    E.load(spark, sf_dir, "customer", "supplier")
    return center.review_rows(spark.sql(GAPS), spark.sql(CONFIRMS), E.items(spark, sf_dir))


@query(CENTER)
def review_center(spark, sf_dir):
    return _center(spark, sf_dir)


@query(
    f"""SELECT CASE kind WHEN 'dynamic_notice' THEN {case_sql("(item || ' ' || reason)", center.NOTICE_WORDS, "'购车权益'")} WHEN 'conflict' THEN '信息冲突' WHEN 'inference' THEN 'AI推断' WHEN 'range_issue' THEN '范围异常' ELSE '信息缺失' END AS measure, count(*) AS n FROM ({CENTER}) GROUP BY 1"""
)
def review_counts(spark, sf_dir):
    return center.review_counts(_center(spark, sf_dir))


@query("SELECT coalesce(nullif(arg_min(s_name, s_suppkey), ''), '未识别') AS brand, '未识别' AS model FROM supplier")
def project_info(spark, sf_dir):
    return center.project_info(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ord"), F.col("s_name").alias("brand"), F.lit("").alias("model")))


OLD, NEW = E.duck(E.knowledge_sql("old")), E.duck(E.knowledge_sql("new"))
SHOWN = "CASE p_partkey % 4 WHEN 0 THEN 'ADDED' WHEN 1 THEN 'UPDATED' WHEN 2 THEN 'UNCHANGED' ELSE 'REVIEW_REQUIRED' END"


@query(
    f"""SELECT ord AS diff_id, kind AS change_type, model, question, CASE kind WHEN 'ADDED' THEN '' ELSE before END AS before, CASE kind WHEN 'UNCHANGED' THEN '' ELSE after END AS after, category FROM (SELECT coalesce(n.ord, o.ord) AS ord, {SHOWN.replace('p_partkey', 'coalesce(n.ord, o.ord)')} AS kind, CASE WHEN n.ord IS NULL THEN o.model ELSE n.model END AS model, CASE WHEN n.ord IS NULL THEN o.question ELSE n.question END AS question, CASE WHEN n.ord IS NULL THEN o.category ELSE n.category END AS category,
CASE WHEN o.ord IS NULL AND {SHOWN.replace('p_partkey', 'n.ord')} = 'UNCHANGED' THEN n.answer ELSE coalesce(o.answer, '') END AS before, coalesce(n.answer, '') AS after FROM ({OLD}) o FULL JOIN ({NEW}) n ON o.ord = n.ord)"""
)
def change_rows(spark, sf_dir):
    old, new = E.knowledge(spark, sf_dir)
    joined = old.select(F.col("ord"), F.struct("*").alias("o")).join(new.select("ord", F.struct("*").alias("n")), "ord", "full")
    kind = F.expr(SHOWN.replace("p_partkey", "ord"))
    return center.change_rows(joined.withColumn("change_type", kind).withColumnRenamed("ord", "diff_id"))


TAGGED = "list_filter([" + ", ".join(f"CASE WHEN {any_sql('@', w)} THEN '{name}' END" for name, w in audit.TAG_WORDS.items()) + "], lambda x: x IS NOT NULL)"
NAMES = "list_filter(list_distinct([replace(@, ' ', ''), regexp_replace(replace(@, ' ', ''), '^哈弗', '')]), lambda m: m <> '')"


@query(
    f"""SELECT new_id, old_id, mm AS model_match, cm AS category_match, nc AS number_change, round(least(CASE WHEN mm THEN 0.45 ELSE 0 END + CASE WHEN nt = ot THEN 0.10 ELSE 0 END + CASE WHEN ncat = ocat THEN 0.20 ELSE 0 END + CASE WHEN nk = ok THEN 0.10 ELSE 0 END + CASE WHEN len(list_intersect(ni, oi)) > 0 THEN 0.15 ELSE 0 END, 1.0), 6) AS entity_score,
CASE WHEN len(ni) = 0 OR len(oi) = 0 THEN 0.0 ELSE round(len(list_intersect(ni, oi)) / (len(ni) + len(oi) - len(list_intersect(ni, oi)))::DOUBLE, 6) END AS intent_overlap
FROM (SELECT *, nm <> '' AND len(list_intersect({NAMES.replace('@', 'nm')}, {NAMES.replace('@', 'om')})) > 0 AS mm, ncat = ocat OR len(list_filter(list_intersect({TAGGED.replace('@', '(nq || ncat)')}, {TAGGED.replace('@', '(oq || ocat)')}), lambda t: t <> '权益')) > 0 AS cm, len(na) > 0 AND len(oa) > 0 AND list_sort(list_distinct(na)) <> list_sort(list_distinct(oa)) AS nc,
 {TAGGED.replace('@', '(nq || ncat || nans)')} AS ni, {TAGGED.replace('@', '(oq || ocat || oans)')} AS oi FROM (SELECT n.knowledge_id AS new_id, o.knowledge_id AS old_id, n.model AS nm, o.model AS om, n.trim AS nt, o.trim AS ot, n.category AS ncat, o.category AS ocat, n.knowledge_type AS nk, o.knowledge_type AS ok, n.question AS nq, o.question AS oq, n.answer AS nans, o.answer AS oans,
 regexp_extract_all(n.answer, '[0-9]+(\\.[0-9]+)?') AS na, regexp_extract_all(o.answer, '[0-9]+(\\.[0-9]+)?') AS oa FROM ({OLD}) o JOIN ({NEW}) n ON n.ord = o.ord + 1))"""
)
def audit_scores(spark, sf_dir):
    """Each new item against the old one before it in order: everything but the score that needs the texts' ratio."""
    old, new = E.knowledge(spark, sf_dir)
    pairs = old.select((F.col("ord") + 1).alias("k"), F.struct("*").alias("o")).join(new.select(F.col("ord").alias("k"), F.struct("*").alias("n")), "k")
    found = audit.scored(pairs, F.lit(0.0))
    return found.select(F.col("n.knowledge_id").alias("new_id"), F.col("o.knowledge_id").alias("old_id"), "model_match", "category_match", "number_change", F.round("entity_score", 6).alias("entity_score"), F.round("intent_overlap", 6).alias("intent_overlap"))


# ---- modes and extraction ----

TEXTS = "SELECT s_suppkey AS doc_id, CASE WHEN s_suppkey % 2 = 0 THEN '总则' || chr(10) || '【车型记录1】' || s_name ELSE s_name END AS text FROM supplier"


@query("SELECT s_suppkey AS doc_id, CASE WHEN s_suppkey % 2 = 0 THEN 'record_aware' ELSE 'single' END AS route FROM supplier")
def fact_routes(spark, sf_dir):
    E.load(spark, sf_dir, "supplier")
    return spark.sql(TEXTS).select("doc_id", modes.fact_route(F.col("text")).alias("route"))


@query(f"""SELECT rag_id FROM (SELECT *, {SIGNALS} AS signals FROM (SELECT *, concat_ws(' ', brand, model, "trim", category, knowledge_type, module, intent, answer, asked) AS said FROM ({JUDGED}))) WHERE live AND signals <> '' AND rag_id NOT IN (SELECT rag_id FROM ({ISSUES}))""")
def model_checks(spark, sf_dir):
    return modes.for_model(E.items(spark, sf_dir)).select("rag_id")


@query("SELECT doc_id, count(*) AS facts, max(place) AS last FROM (SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS place FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[。.!?！？\\n]'), lambda x: trim(x, ' \t')), lambda x: x <> '') AS parts FROM documents)) GROUP BY 1")
def extracted_facts(spark, sf_dir):
    ship(spark)
    chunks = read(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("chunk"), "text")
    return modes.all_or_nothing(modes.extracted(chunks)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("facts"), F.max("place").cast("long").alias("last"))
