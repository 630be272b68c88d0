"""Corpus preparation in five stages, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the
last return the columns of documents; the last returns one row a document with
its token count and the digests of its ids and of their decoding.

Defined results, for every stage: an empty table stays empty; a null text counts
as empty; ids may be null or repeat, and other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.arrow import stored
from factloom.llm.decontaminate import without_items
from factloom.llm.pii import redact
from factloom.llm.quality import train, without_rejected
from factloom.llm.queries import KEEP, table, token_digest
from factloom.llm.simhash import one_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; an empty text is scored like any other, and equal texts go or stay together."""
    return without_rejected(docs, train(docs, table(spark, sf_dir, "labels")), KEEP)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of the least id. All texts without words are one group."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; empty texts and empty items meet nothing."""
    return without_items(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to their kinds in brackets, and n_chars follows; a null text stays null, and its n_chars is null."""
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(clean.schema["n_chars"].dataType)) if "n_chars" in clean.columns else clean


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token ids, and ids are decoded again; an empty text has none."""
    return token_digest(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: The first two stages and the last have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage's rows are stored, so that the next one, which may read them several times,
    does not compute them anew."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
