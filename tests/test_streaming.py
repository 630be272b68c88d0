"""Incremental updates and windowed counts."""

from __future__ import annotations

from factloom.streaming import updates

COLUMNS = "ord long, knowledge_id string, question string, answer string, category string, brand string, model string, trim string, knowledge_type string, need_confirm boolean, source_file string"


def item(k, answer, model="H6"):
    return (k, f"K{k}", f"{model}官方指导价是多少？", answer, "价格", "", model, "全系", "price", False, "f")


def test_batches_update_the_snapshot(spark, tmp_path):
    base = str(tmp_path / "base")
    spark.createDataFrame([item(1, "100元"), item(2, "200元", "猛龙")], COLUMNS).write.parquet(f"{base}/000000000")
    spark.createDataFrame([item(11, "150元"), item(12, "300元", "坦克500")], COLUMNS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(COLUMNS).parquet(str(tmp_path / "in"))
    query = updates.keep_updated(stream, base, str(tmp_path / "check"))
    query.awaitTermination(240)
    assert query.exception() is None
    got = {r["knowledge_id"] for r in spark.read.parquet(f"{base}/000000001").collect()}
    assert got == {"K11", "K2", "K12"}


def test_windowed_counts(spark):
    rows = spark.sql("SELECT TIMESTAMP '2024-01-01 00:10:00' AS ts, 'view' AS event_type, 1.0D AS value UNION ALL SELECT TIMESTAMP '2024-01-01 00:50:00', 'view', 2.0D UNION ALL SELECT TIMESTAMP '2024-01-01 01:05:00', 'view', 4.0D")
    assert sorted((str(r["start"]), r["events"], r["total"]) for r in updates.windowed_counts(rows).collect()) == [("2024-01-01 00:00:00", 2, 3.0), ("2024-01-01 01:00:00", 1, 4.0)]
