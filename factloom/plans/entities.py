"""Knowledge-base entities made from the driver's tables by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MODEL = "CASE p_partkey % 4 WHEN 0 THEN '哈弗X' || b WHEN 2 THEN 'X' || b || 'PHEV' ELSE 'X' || b END"


def knowledge_sql(side: str, part: str = "part") -> str:
    """Items of the old or new snapshot: ord, knowledge_id, question, answer, category, brand, model, trim, knowledge_type, need_confirm, source_file."""
    new = side == "new"
    model = f"CASE WHEN p_partkey % 89 = 0 THEN '' ELSE {MODEL} END" if new else MODEL
    amount = "a + CASE WHEN p_partkey % 7 = 0 THEN 100 ELSE 0 END" if new else "a"
    written = f"CASE WHEN p_partkey % 7 = 1 AND a >= 1000 THEN CAST(a DIV 1000 AS STRING) || ',' || lpad(CAST(a % 1000 AS STRING), 3, '0') ELSE CAST({amount} AS STRING) END" if new else f"CAST({amount} AS STRING)"
    lead = "CASE WHEN p_partkey % 7 = 2 THEN '想问一下' ELSE '' END" if new else "''"
    ended = "CASE WHEN p_partkey % 97 = 0 THEN '活动结束' ELSE '' END" if new else "CASE WHEN p_partkey % 103 = 0 THEN '已停售' ELSE '' END"
    blank = 101 if new else 107
    return f"""
SELECT p_partkey AS ord, '{side.upper()}-' || p_partkey AS knowledge_id,
  {lead} || model || CASE kind WHEN 0 THEN '官方指导价是多少？' WHEN 1 THEN '现金优惠有多少' WHEN 2 THEN '置换补贴怎么样' WHEN 3 THEN '金融政策是什么' ELSE '质保多久' END AS question,
  CASE WHEN p_partkey % {blank} = 0 THEN '' ELSE CASE kind WHEN 0 THEN '官方指导价' WHEN 1 THEN '现金优惠' WHEN 2 THEN '置换补贴' WHEN 3 THEN '贷款贴息' ELSE '整车质保' END || {written} || CASE WHEN kind = 4 THEN '公里' ELSE '元' END || '。' || {ended} END AS answer,
  CASE kind WHEN 0 THEN '价格' WHEN 1 THEN '优惠' WHEN 2 THEN '置换' WHEN 3 THEN '金融' ELSE '售后' END AS category,
  p_brand AS brand, model, '版本' || CAST(p_size % 3 AS STRING) AS trim,
  CASE kind WHEN 0 THEN 'price' WHEN 1 THEN 'policy' WHEN 2 THEN 'policy' WHEN 3 THEN 'finance' ELSE 'static' END AS knowledge_type,
  false AS need_confirm, 'file' || CAST(p_partkey % 3 AS STRING) || '.xlsx' AS source_file
FROM (SELECT *, {model} AS model, p_partkey % 5 AS kind, CAST(round(p_retailprice) AS BIGINT) AS a FROM (SELECT *, CAST(floor(p_partkey / 10) AS BIGINT) AS b FROM {part}) t) u
WHERE p_partkey % 10 <> {0 if new else 9}"""


def duck(sql: str) -> str:
    """The few words that DuckDB spells otherwise."""
    return sql.replace(" DIV ", " // ").replace("AS STRING", "AS VARCHAR")


FACTS = """
SELECT row_number() OVER (PARTITION BY p_brand ORDER BY l_orderkey, l_linenumber) AS pos, l_orderkey * 10 + l_linenumber AS ord, p_brand AS brand,
  p_type AS model, '版本' || CAST(p_size % 4 AS STRING) AS trim, CASE l_returnflag WHEN 'A' THEN '价格' WHEN 'N' THEN '优惠' ELSE '配置' END AS category,
  p_brand || CASE l_returnflag WHEN 'A' THEN '指导价 ' ELSE '优惠,' END || CAST(CAST(round(p_retailprice) AS BIGINT) % 50 AS STRING) || '元。' AS content,
  CASE l_linestatus WHEN 'O' THEN 'dynamic' ELSE 'static' END AS knowledge_type
FROM lineitem JOIN part ON l_partkey = p_partkey"""

RAG = """
SELECT p_partkey AS ord, 'RAG-' || p_partkey AS rag_id, p_brand AS brand, p_type AS model, CASE WHEN p_partkey % 3 = 0 THEN '全系' ELSE '版本' || CAST(p_size % 4 AS STRING) END AS trim,
  CASE p_partkey % 4 WHEN 0 THEN '价格' WHEN 1 THEN '优惠' WHEN 2 THEN '配置' ELSE '质保' END AS category,
  CASE WHEN p_partkey % 23 = 0 THEN '' ELSE p_type || '的指导价和配置' END AS question,
  CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 13 = 0 THEN '暂无' ELSE '售价' || CAST(CAST(round(p_retailprice) AS BIGINT) * 100 AS STRING) || '元，' || CAST(p_size AS STRING) || '个月免息' || CASE WHEN p_partkey % 17 = 0 THEN repeat('活动优惠', 50) ELSE '' END END AS answer,
  CASE WHEN p_partkey % 19 = 0 THEN 'need_confirm' ELSE 'fact' END AS answer_type,
  CASE WHEN p_partkey % 29 = 0 THEN '是' ELSE '否' END AS need_confirm,
  CASE WHEN p_partkey % 31 = 0 THEN 'conflict' WHEN p_partkey % 37 = 0 THEN 'missing' ELSE '' END AS review_type,
  CASE WHEN p_partkey % 2 = 0 THEN 'dynamic' ELSE 'static' END AS knowledge_type, p_partkey % 3 AS n_refs,
  CAST(round(p_retailprice) AS BIGINT) * 100 AS price
FROM part"""


def load(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def knowledge(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    load(spark, sf_dir, "part")
    return spark.sql(knowledge_sql("old")), spark.sql(knowledge_sql("new"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "lineitem", "part")
    return spark.sql(FACTS)


def rag_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "part")
    return spark.sql(RAG)


ITEMS = """
SELECT p_partkey AS ord, 'R' || p_partkey AS rag_id, p_brand AS brand, CASE WHEN p_partkey % 41 = 0 THEN '' ELSE p_type || p_brand END AS model,
  CASE p_partkey % 5 WHEN 0 THEN '全系' WHEN 1 THEN 'Pro' WHEN 2 THEN '需确认' WHEN 3 THEN '' ELSE '旗舰版' END AS trim,
  CASE p_partkey % 6 WHEN 0 THEN '价格' WHEN 1 THEN '金融政策' WHEN 2 THEN '配置' WHEN 3 THEN '' WHEN 4 THEN '座椅' ELSE '空间' END AS category,
  CASE WHEN p_partkey % 3 = 0 THEN '产品' ELSE '' END AS module, '' AS intent,
  CASE p_partkey % 13 WHEN 0 THEN 'need_confirm' WHEN 1 THEN 'fact_answer' WHEN 2 THEN 'Need_Confirm' ELSE 'general' END AS answer_type,
  CASE p_partkey % 20 WHEN 0 THEN '' WHEN 1 THEN '资料未提供相关内容' WHEN 2 THEN '没有数据，建议咨询门店' WHEN 3 THEN '建议您咨询当地门店了解' WHEN 4 THEN '整车质保三年'
    WHEN 5 THEN '价格为12.5万元，不同版本价格会有差异' WHEN 6 THEN '高级皮质座椅很舒适' WHEN 7 THEN '自动驾驶解放双手' WHEN 8 THEN '标配倒车影像' WHEN 9 THEN '除180系列外Max可选'
    WHEN 11 THEN '2024年3月5日至2024/4/1限时补贴' || CAST(p_size AS STRING) || '元' WHEN 12 THEN '道路救援服务，见活动政策' WHEN 13 THEN repeat('活动说明', 50) WHEN 14 THEN '标配倒车影像'
    WHEN 15 THEN '见营销政策说明' WHEN 16 THEN 'Pro和Max都有' WHEN 17 THEN '活动时间' || CAST(2023 + p_size % 2 AS STRING) || '年' || CAST(1 + p_size % 12 AS STRING) || '月5日起'
    ELSE '售价' || CAST((1000 + p_partkey % 90 * 10) * 100 AS STRING) || '元，配' || CAST(p_size AS STRING) || '英寸屏' END AS answer,
  CASE p_partkey % 31 WHEN 0 THEN 'conflict' WHEN 1 THEN 'missing' WHEN 2 THEN 'range_issue' WHEN 3 THEN 'inference' WHEN 4 THEN 'scope_conflict' ELSE '' END AS review_type,
  CASE p_partkey % 37 WHEN 0 THEN 'Invalid' WHEN 1 THEN 'unconfirmed' ELSE 'ok' END AS knowledge_status,
  CASE p_partkey % 43 WHEN 0 THEN '是' WHEN 1 THEN 'true' WHEN 2 THEN 'True' ELSE '否' END AS need_confirm, p_partkey % 47 <> 0 AS exportable,
  CASE p_partkey % 4 WHEN 1 THEN 'dynamic' WHEN 2 THEN 'finance' ELSE 'static' END AS knowledge_type,
  CASE WHEN p_partkey % 19 = 0 THEN '' ELSE p_type || CASE p_partkey % 7 WHEN 0 THEN '多少钱' WHEN 1 THEN '屏幕多大' WHEN 2 THEN '怎么样，芯片好吗' ELSE '有什么' END END AS qa,
  CASE WHEN p_partkey % 4 = 3 THEN '还有贷款吗' ELSE '' END AS qb,
  CASE WHEN p_partkey % 11 = 0 THEN '' ELSE 'F' || p_partkey END AS ra, CASE p_partkey % 10 WHEN 1 THEN ' ' WHEN 2 THEN 'F2' ELSE '' END AS rb
FROM part"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question-and-answer items that reach every branch of the gate, the checks and the router."""
    load(spark, sf_dir, "part")
    return spark.sql(f"SELECT *, array(qa, qb) AS questions, filter(array(ra, rb), x -> x <> '') AS fact_refs FROM ({ITEMS})").drop("qa", "qb", "ra", "rb")


# Sheets of every kind, one a nation: a matrix of vehicles (even nations), a table below a title (odd), or single cells.
GRID = """
WITH s AS (SELECT s_suppkey, s_name, s_nationkey AS nk, CAST(round(abs(s_acctbal)) AS BIGINT) AS amount, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INT) AS k FROM supplier),
l AS (SELECT 0 AS r, '品牌' AS name UNION ALL SELECT 1, '车系 名称' UNION ALL SELECT 2, '车型名称' UNION ALL SELECT 3, '厂商指导价' UNION ALL SELECT 4, '能源类型' UNION ALL SELECT 5, '备注' UNION ALL SELECT 6, '备注'),
g AS (
SELECT DISTINCT nk, r AS row, 0 AS col, name AS value FROM s CROSS JOIN l WHERE nk % 2 = 0
UNION ALL SELECT nk, r, k, CASE r WHEN 0 THEN '牌' || nk WHEN 1 THEN '系' || k WHEN 2 THEN s_name WHEN 3 THEN CAST(amount AS STRING) WHEN 4 THEN CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '电动' END WHEN 5 THEN CASE WHEN s_suppkey % 2 = 0 THEN ' ' ELSE '注' || s_suppkey END ELSE '另' || s_suppkey END FROM s CROSS JOIN l WHERE nk % 2 = 0
UNION ALL SELECT DISTINCT nk, 0, 0, '用户购车权益说明' FROM s WHERE nk % 2 = 1
UNION ALL SELECT DISTINCT nk, 2, c.c, CASE c.c WHEN 0 THEN '序号' WHEN 1 THEN '名称' WHEN 2 THEN '' ELSE '名称' END FROM s CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) c WHERE nk % 2 = 1 AND nk % 7 <> 3
UNION ALL SELECT nk, k + 2, c.c, CASE c.c WHEN 0 THEN CAST(k AS STRING) WHEN 1 THEN s_name WHEN 2 THEN CAST(amount AS STRING) ELSE CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE '说' || k END END FROM s CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) c WHERE nk % 2 = 1 AND nk % 7 <> 3
UNION ALL SELECT nk, k + 2, 1, s_name FROM s WHERE nk % 2 = 1 AND nk % 7 = 3)
SELECT 'f' || nk % 3 AS file, CAST(nk AS STRING) AS sheet, row, col, value FROM g"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "supplier")
    return spark.sql(GRID)
