"""Business files as rows: workbooks, documents, plain texts and archives, read as binaries by Spark."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Limits on archives.
MAX_ENTRIES, MAX_TOTAL, MAX_ENTRY, MAX_RATIO, MAX_DEPTH = 500, 768 << 20, 120 << 20, 100, 2
IMAGES = (".png", ".jpg", ".jpeg", ".webp", ".bmp", ".gif")


def _number(column: str) -> int:
    n = 0
    for c in column:
        n = n * 26 + ord(c) - 64
    return n - 1


def workbook_cells(data: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, col, value) of the filled cells of an xlsx file; merged ranges repeat their top-left value."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{MAIN}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
            path = targets[sheet.get(RELATION)]
            root = ElementTree.fromstring(z.read(path.lstrip("/") if path.startswith("/") else posixpath.join("xl", path)))
            cells = {}
            for c in root.iter(f"{MAIN}c"):
                letters, row = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
                raw = "".join(t.text or "" for t in c.iter(f"{MAIN}t")) if c.get("t") == "inlineStr" else c.findtext(f"{MAIN}v") or ""
                kind = c.get("t")
                value = shared[int(raw)] if kind == "s" and raw else ("是" if raw == "1" else "否") if kind == "b" else raw
                if kind in (None, "n") and re.fullmatch(r"-?\d+\.0+", value):
                    value = value.split(".")[0]
                value = value.replace(" ", " ").replace("　", " ").strip()
                if value:
                    cells[int(row) - 1, _number(letters)] = value
            for m in root.iter(f"{MAIN}mergeCell"):
                a, b = (re.fullmatch(r"([A-Z]+)(\d+)", x).groups() for x in m.get("ref").split(":"))
                r1, c1, r2, c2 = int(a[1]) - 1, _number(a[0]), int(b[1]) - 1, _number(b[0])
                if (r1, c1) in cells:
                    cells |= {(r, c): cells[r1, c1] for r in range(r1, r2 + 1) for c in range(c1, c2 + 1)}
            for (row, col), value in sorted(cells.items()):
                yield sheet.get("name"), row, col, value


def document_lines(data: bytes) -> list[str]:
    """Paragraphs of a docx file, then its tables' rows with cells joined by a bar."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{WORD}t")).strip()
    out = [text(p) for p in body.findall(f"{WORD}p")]
    for row in body.iter(f"{WORD}tr"):
        out.append(" | ".join(text(c) for c in row.findall(f"{WORD}tc")))
    return [line for line in out if line]


def archive_images(data: bytes, prefix: str = "", depth: int = 0, budget: dict | None = None) -> Iterator[tuple[str, int]]:
    """(path, bytes) of the images in a zip file and the zip files in it, sorted by name; unsafe or oversized archives are errors."""
    budget = budget if budget is not None else {"entries": 0, "total": 0}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in sorted(z.infolist(), key=lambda i: i.filename):
            name = info.filename.replace("\\", "/")
            if info.is_dir():
                continue
            if name.startswith("/") or ":" in name.split("/")[0] or ".." in name.split("/"):
                raise ValueError(f"unsafe path in archive: {name}")
            if info.flag_bits & 1 or (info.external_attr >> 16) & 0o170000 == 0o120000:
                raise ValueError(f"encrypted or linked entry in archive: {name}")
            budget["entries"] += 1
            budget["total"] += info.file_size
            if budget["entries"] > MAX_ENTRIES or budget["total"] > MAX_TOTAL or info.file_size > MAX_ENTRY or info.file_size > MAX_RATIO * max(1, info.compress_size):
                raise ValueError(f"archive over its limits at {name}")
            if name.lower().endswith(IMAGES):
                yield prefix + name, info.file_size
            elif name.lower().endswith(".zip") and depth < MAX_DEPTH - 1:
                yield from archive_images(z.read(info), f"{prefix}{name}!", depth + 1, budget)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all files under a path that Spark reads: path, part (sheet or blank), line, text, error. A file that fails
    gives one row with its error; the others are read."""

    def lines(name: str, data: bytes) -> Iterator[tuple[str, int, str]]:
        low = name.lower()
        if low.endswith((".xlsx", ".xlsm")):
            rows: dict[tuple[str, int], list[str]] = {}
            for sheet, row, _, value in workbook_cells(data):
                rows.setdefault((sheet, row), []).append(value)
            yield from ((sheet, row, " | ".join(v)) for (sheet, row), v in rows.items())
        elif low.endswith(".docx"):
            yield from (("", k, t) for k, t in enumerate(document_lines(data)))
        elif low.endswith((".txt", ".md", ".csv")):
            yield from (("", k, t) for k, t in enumerate(data.decode("utf-8", "replace").split("\n")) if t.strip())
        elif low.endswith(".zip"):
            yield from (("", k, p) for k, (p, _) in enumerate(archive_images(data)))
        else:
            raise ValueError(f"no reader for {name}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name, data in zip(frame["path"], frame["content"]):
                try:
                    out += [(name, part, line, text, None) for part, line, text in lines(name, bytes(data))]
                except (ValueError, KeyError, AttributeError, zipfile.BadZipFile, ElementTree.ParseError) as error:
                    out.append((name, None, None, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(out, columns=["path", "part", "line", "text", "error"]).astype({"line": "Int64"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, part string, line long, text string, error string")
