"""Settings, modes, and stages whose work is a callable (a language model, or the rule-based stand-in here)."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import gate

# The mark of a vehicle record in a text.
RECORD_MARK = "【车型记录"
FACT_MODES, QC_MODES = ("auto", "single", "chunked", "record_aware"), ("full", "rule_first")


def setting(spark: SparkSession, name: str, default: str = "") -> str:
    """A setting from the session (spark.factloom.NAME), else the environment, else the default."""
    return spark.conf.get(f"spark.factloom.{name}", None) or os.environ.get(name) or default


def fact_route(text: Column, mode: str = "auto") -> Column:
    """How a text's facts are extracted: with auto by its records where it has any, else in one piece; unknown modes too."""
    if mode == "auto":
        return F.when(F.coalesce(text, F.lit("")).contains(RECORD_MARK), "record_aware").otherwise("single")
    return F.lit(mode if mode in FACT_MODES else "single")


def for_model(items: DataFrame, mode: str = "rule_first") -> DataFrame:
    """The items that a language model is to check: all of them (full), or those that the router sends (rule_first)."""
    if mode == "full":
        return items
    routed = gate.routes(items, gate.rule_issues(items)).where("route = 'llm'").select("rag_id")
    return items.join(routed, "rag_id", "left_semi")


def sentences(text: str) -> list[str]:
    """The stand-in extractor: a fact is a sentence."""
    return [s.strip() for s in re.split(r"[。.!?！？\n]", text) if s.strip()]


def extracted(chunks: DataFrame, extract: Callable[[str], list[str]] = sentences) -> DataFrame:
    """Facts of chunks (doc_id, chunk, text): doc_id, chunk, place, content, and error, the reason where a chunk failed.

    Chunks run on their own, wherever they lie; order comes from chunk and place, not from arrival."""
    kind = chunks.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, chunk, text in zip(batch["doc_id"], batch["chunk"], batch["text"]):
                try:
                    out += [(doc, chunk, k, fact, None) for k, fact in enumerate(extract(text or ""))]
                except Exception as error:  # the caller decides what a failed chunk means
                    out.append((doc, chunk, -1, None, str(error) or type(error).__name__))
            yield pd.DataFrame(out, columns=["doc_id", "chunk", "place", "content", "error"])

    return chunks.select("doc_id", "chunk", "text").mapInPandas(run, f"doc_id {kind}, chunk int, place int, content string, error string")


def all_or_nothing(facts: DataFrame) -> DataFrame:
    """The facts; a failed chunk among them is an error."""
    failed = F.concat(F.lit("chunk "), F.col("chunk").cast("string"), F.lit(": "), "error")
    return facts.withColumn("content", F.when(F.col("error").isNotNull(), F.raise_error(failed).cast("string")).otherwise(F.col("content"))).drop("error")
