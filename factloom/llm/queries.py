"""The ten registered queries: thin digests of the operators' results over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.shipping import ship


def ranks_path() -> str:
    """The ranks that the queries encode by; the operators take any file of this format."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.pii import BASE_KINDS, find_spans, written

    found = find_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in BASE_KINDS), F.sha2(written(F.col("spans"), lambda s: s["base"]), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.html import extract

    return extract(table(spark, sf_dir, "pages"), keep=("url",)).withColumn("n_chars", F.length("text").cast("long"))


#: Documents score at least this to be kept.
KEEP = 0.3


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.quality import held_out, score_documents, train

    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))


def token_digest(docs: DataFrame) -> DataFrame:
    from factloom.llm.bpe import round_trip

    return round_trip(docs, ranks_path()).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        F.coalesce(F.get("ends", F.size("ends") - 1), F.lit(0)).cast("long").alias("n_bytes"),
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.winnow import compare_edited, written

    found = compare_edited(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", "edited_sha256", written(F.col("hashes")).alias("fingerprint"), written(F.col("edited_hashes")).alias("edited_fingerprint"), "near_edited", "near_next")


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.dedup import find_repeats

    found = find_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.secrets import BASE_KINDS, find_secrets, written

    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in BASE_KINDS), F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.arrow import fresh
    from factloom.llm.tokencount import count_tokens, separator_for, vocabulary, write_flat

    path, ranks = fresh(spark, "flat"), ranks_path()
    names = write_flat(table(spark, sf_dir, "documents"), ranks, path)
    counts = count_tokens(spark, path, *separator_for(vocabulary(ranks))).withColumn("file", F.regexp_extract("file", "part-([0-9]+)-", 1).cast("int"))
    missing = F.raise_error(F.lit("a document is not in its file")).cast("long")
    return names.join(counts, ["file", "ordinal"], "left").select("doc_id", F.coalesce("n_tokens", missing).alias("n_tokens"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.decontaminate import find_items

    found = find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("shared").cast("long").alias("n_shared"), F.col("size").cast("long").alias("n_shingles"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_pii": op1_pii, "op2_html": op2_html, "op3_quality": op3_quality, "op4_bpe": op4_bpe, "op5_fingerprints": op5_fingerprints, "op6_repeats": op6_repeats, "op7_secrets": op7_secrets, "op8_simhash": op8_simhash, "op9_token_counts": op9_token_counts, "op10_decontaminate": op10_decontaminate}
#: Words as decontaminate.words_of has them.
WORDS_SQL = "string_split(trim(regexp_replace(lower(coalesce(text, '')), '[\\p{Z}\\p{Cc}\\p{P}\\p{S}]+', ' ', 'g')), ' ')"

ORACLE_SQL: dict[str, str] = {
    "op10_decontaminate": f"""WITH i AS (SELECT item_id, ws, least(len(ws), 5) AS n FROM (SELECT item_id, {WORDS_SQL} AS ws FROM benchmark) WHERE ws[1] <> ''),
s AS (SELECT DISTINCT item_id, n, array_to_string(ws[k:k + n - 1], ' ') AS g FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM i)),
d AS (SELECT DISTINCT doc_id, n, array_to_string(ws[k:k + n - 1], ' ') AS g FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM (SELECT doc_id, {WORDS_SQL} AS ws FROM documents), (SELECT DISTINCT n FROM s) WHERE len(ws) >= n))
SELECT doc_id, item_id, count(*) AS n_shared, any_value(size) AS n_shingles FROM s JOIN d USING (n, g) JOIN (SELECT item_id, count(*) AS size FROM s GROUP BY 1) USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(size) - 1e-9"""
}
