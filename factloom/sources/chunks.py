"""Cutting documents into chunks at natural boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

TARGET, MOST = 4500, 6000
SENTENCE = re.compile(r"(?<=[。！？!?；;.])")
HEADING = re.compile(r"^(?:#{1,6} |第[一二三四五六七八九十0-9]+[章节]|[一二三四五六七八九十]+、|\d+(?:\.\d+)*[、. ])")


def units(block: str, most: int = MOST) -> Iterator[str]:
    """A block whole, or its lines, sentences, and at last stretches of at most ``most`` characters."""
    if len(block) <= most:
        yield block
        return
    for line in block.split("\n"):
        if len(line) <= most:
            yield line
            continue
        held = ""
        for part in SENTENCE.split(line):
            if held and len(held) + len(part) > most:
                yield held
                held = ""
            held += part
            while len(held) > most:
                yield held[:most]
                held = held[most:]
        if held:
            yield held


def chunks(text: str, target: int = TARGET, most: int = MOST) -> list[tuple[str, str]]:
    """(heading context, chunk): units packed up to the target; the context is the last three distinct headings before a chunk."""
    out, held, headings, context = [], "", [], ""
    for block in re.split(r"\n\s*\n", text):
        for unit in units(block.strip("\n"), most):
            if not unit.strip():
                continue
            if held and len(held) + 1 + len(unit) > target:
                out.append((context, held))
                held, context = "", " > ".join(headings[-3:])
            held = f"{held}\n{unit}" if held else unit
            first = unit.split("\n", 1)[0].strip()
            if len(first) <= 40 and HEADING.match(first) and first not in headings[-3:]:
                headings.append(first)
    return [*out, (context, held)] if held else out


def chunked(docs: DataFrame, target: int = TARGET, most: int = MOST) -> DataFrame:
    """Columns doc_id, chunk (from 0), context, text; each document on its own."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, k, c, t) for i, text in zip(frame["doc_id"], frame["text"]) for k, (c, t) in enumerate(chunks(text or "", target, most))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "context", "text"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, chunk int, context string, text string")
