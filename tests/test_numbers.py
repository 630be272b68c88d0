"""Numbers of answers: the registered query keeps to its twin, matching to the reference's rule."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.plans import catalogue


def test_numbers_extract_equals_its_twin_over_every_kind_of_answer(spark, tmp_path):
    prices = [900.0, 999.4, 999.5, 1000.0, 1234.0, 20005.0, 1234567.0, -1500.0, None]
    rows = [(i * 70 + key, prices[i]) for i in range(len(prices)) for key in range(70)]
    part = spark.createDataFrame(rows, "p_partkey long, p_retailprice double")
    part.selectExpr("*", "'part' AS p_name", "'b' AS p_brand", "'t' AS p_type", "1 AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    twin = duck.sql(catalogue.ORACLE_SQL["numbers_extract"]).select("knowledge_id, numbers").fetchall()
    got = [tuple(r) for r in catalogue.numbers_extract(spark, str(tmp_path)).select("knowledge_id", "numbers").collect()]
    order = lambda r: (r[0], r[1] is None, r[1] or "")
    assert sorted(got, key=order) == sorted(twin, key=order)
    assert {"1,000", "1000", "1,234", "1234,567", "", None} <= {n for _, n in got}


def test_only_with_marks_does_punctuation_part_numbers(spark):
    rows = [("整车质保1,000公里。", ["1000"], ["1", "000"]), ("官方指导价1,000元。", ["1000"], ["1000"]), ("费率3.8%", ["38%"], ["3.8%"]), ("1.2万元", ["12000"], ["12000"]), (None, [], [])]
    frame = spark.createDataFrame([(r[0],) for r in rows], "answer string")
    found = frame.select(T.numbers(F.col("answer")), T.numbers(F.col("answer"), marks=True)).collect()
    assert [tuple(r) for r in found] == [r[1:] for r in rows]
