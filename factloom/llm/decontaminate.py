"""Benchmark items inside documents: MinHash containment search by size classes, verified exactly.

Words are runs of anything but blanks, punctuation and symbols, in lower case; an
item's shingles are the distinct runs of WORDS words (a shorter item is one
shingle of all its words). A document contains an item if at least THRESHOLD of
the item's shingles occur in it, wherever they stand.

A document is far larger than an item, so their Jaccard similarity is tiny and
equal-length signatures would miss it. Here items are partitioned by shingle
count, and each class keeps the k smallest hashes of each item, k fixed by the
class's upper bound so that no document at the threshold can miss too many of
them: of an item's n shingles at most n - ceil(THRESHOLD n) may be missing, so at
least k minus that of the sketch occur in the document. The documents' side is
every shingle hash, looked up in the sketches; candidates are then verified on
the shingles' bytes. Nothing is missed and nothing false is reported.

Defined results: null or empty documents contain nothing; items without words
are contained nowhere; repeated items or documents give repeated rows; an empty
benchmark gives an empty result; null ids are kept. Equal item texts are looked up
once. Benchmarks over MAX_BYTES go through in several passes, each within about
that bound and stored before the next one is fetched.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.arrow import pieces, stored

WORDS = 5
THRESHOLD = 0.8
#: Benchmark text held by a worker at a time.
MAX_BYTES = 32 << 20
MASK_BITS = 20

PUNCTUATION = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


@cache
def _byte_values() -> np.ndarray:
    return np.random.default_rng(3).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (BASE, INVERSE))


POWERS = Powers()


#: Blanks, controls, punctuation and symbols beyond ASCII part words too.
MARKS = regex.compile(r"[\p{Z}\p{Cc}\p{P}\p{S}]+")


def words_of(text: str) -> bytes:
    """The words, each pair parted by one space."""
    text = text.lower()
    return b" ".join((text if text.isascii() else MARKS.sub(" ", text)).encode().translate(PUNCTUATION).split())


def hashed_runs(lines: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, line, start and end (in its line) of every run of length words; none where a line has fewer."""
    whole = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    POWERS.need(len(whole) + 1)
    sums = np.zeros(len(whole) + 1, np.uint64)
    np.cumsum(_byte_values()[whole] * POWERS.up[: len(whole)], out=sums[1:])
    ends = np.flatnonzero((whole == 32) | (whole == 10))
    starts = np.concatenate([[0], ends[:-1] + 1])
    sizes = np.fromiter(map(len, lines), np.int64, len(lines)) + 1
    offsets = np.cumsum(sizes) - sizes
    line = np.repeat(np.arange(len(lines)), sizes)[starts] if len(lines) else np.zeros(0, np.int64)
    n = max(0, len(starts) - length + 1)
    first, last = starts[:n], ends[length - 1 :][:n]
    ok = (line[:n] == line[length - 1 :][:n]) & (first < ends[:n])
    first, last, line = first[ok], last[ok], line[:n][ok]
    value = (sums[last] - sums[first]) * POWERS.down[first]
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(32)
    return value, line, first - offsets[line], last - offsets[line]


class Sketches:
    """The items' sketches, by shingle length."""

    def __init__(self, items: list[tuple[object, str]]):
        self.ids = [i for i, _ in items]
        self.shingles: list[set[bytes]] = []
        self.allowed: list[int] = []
        self.need: list[int] = []
        entries = defaultdict(list)
        for row, (_, text) in enumerate(items):
            line = words_of(text or "")
            n = line.count(b" ") + 1 if line else 0
            length = min(n, WORDS)
            hashes, _, a, b = hashed_runs([line], length) if n else (np.zeros(0, np.uint64), None, np.zeros(0, int), np.zeros(0, int))
            own = {line[x:y] for x, y in zip(a.tolist(), b.tolist())}
            hashes = np.unique(hashes)
            self.shingles.append(own)
            self.allowed.append(len(own) - math.ceil(THRESHOLD * len(own) - 1e-9))
            if own:
                upper = 1 << len(own).bit_length()  # the class holds sizes below this
                k = min(len(hashes), upper - math.ceil(THRESHOLD * upper - 1e-9) + 1)
                self.need.append(max(1, k - self.allowed[-1]))
                entries[length] += [(int(h), row) for h in hashes[:k]]
            else:
                self.need.append(1)
        self.needed = np.array(self.need, np.int64)
        self.tables = {}
        for length, found in entries.items():
            found.sort()
            hashes = np.array([h for h, _ in found], np.uint64)
            mask = np.zeros(1 << MASK_BITS, bool)
            mask[(hashes >> np.uint64(64 - MASK_BITS)).astype(np.int64)] = True
            self.tables[length] = hashes, np.array([r for _, r in found]), mask

    def search(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """For each text the items it contains: (row, shingles shared)."""
        lines = [words_of(t) for t in texts]
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        for length, (hashes, rows, mask) in self.tables.items():
            value, line, start, end = hashed_runs(lines, length)
            at = np.flatnonzero(mask[(value >> np.uint64(64 - MASK_BITS)).astype(np.int64)])
            if not len(at):
                continue
            low, high = np.searchsorted(hashes, value[at], "left"), np.searchsorted(hashes, value[at], "right")
            count = high - low
            entry = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            # Each shingle of a document counts once for an item, however often it occurs.
            hits = np.unique(np.stack([np.repeat(line[at], count), rows[entry], entry]), axis=1)
            first = np.flatnonzero((np.diff(hits[0], prepend=-1) != 0) | (np.diff(hits[1], prepend=-1) != 0))
            enough = np.diff(np.append(first, hits.shape[1])) >= self.needed[hits[1][first]]
            near = defaultdict(list)
            for k in first[enough]:
                near[int(hits[0][k])].append(int(hits[1][k]))
            for doc, found in near.items():
                a, b = np.searchsorted(line, [doc, doc + 1])
                own = {lines[doc][x:y] for x, y in zip(start[a:b].tolist(), end[a:b].tolist())}
                for row in sorted(found):
                    shared = len(self.shingles[row] & own)
                    if shared >= len(self.shingles[row]) - self.allowed[row]:
                        out[doc].append((row, shared))
        return out


def passes(items: DataFrame, text_col: str, max_bytes: int = MAX_BYTES) -> Iterator[list[tuple[bytes, str]]]:
    """The distinct item texts with their digests, in parts of about max_bytes of text, each fetched when its turn comes."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = items.select(F.unhex(F.md5(text.cast("binary"))).alias("key"), text.alias("text")).groupBy("key").agg(F.min("text").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 if size <= max_bytes else math.ceil(2 * size / max_bytes)
    for k in range(parts):
        part = rows.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == k) if parts > 1 else rows
        yield [(bytes(r["key"]), r["text"]) for r in part.collect()]


BUILT: dict[str, Sketches] = {}


def _sketches(name: str, items: list[tuple[bytes, str]]) -> Sketches:
    """The sketches of a part, built once a worker; those of the part before give way."""
    if name not in BUILT:
        BUILT.clear()
        BUILT[name] = Sketches(items)
    return BUILT[name]


def _each_pass(items: DataFrame, text_col: str, look: Callable[[Callable[[], Sketches]], DataFrame], max_bytes: int) -> DataFrame:
    """The rows that ``look`` finds with the sketches of each part. Of several parts the results are stored one by one, so
    that the driver holds one part at a time."""
    spark, out, held, now = items.sparkSession, None, None, None
    for part in passes(items, text_col, max_bytes):
        if held is not None:
            out = stored(now if out is None else out.unionAll(now), "found")
            held.destroy()
        held, name = spark.sparkContext.broadcast(part), uuid.uuid4().hex
        now = look(lambda held=held, name=name: _sketches(name, held.value))
    return now if out is None else out.unionAll(now)


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """Columns: the document's id, item_id, shared and size (shingles), for each item that a document contains."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    doc_kind = source.schema[0].dataType.simpleString()

    def look(sketches):
        def run(batches):
            known = sketches()
            for batch in batches:
                for piece in pieces(batch):
                    got = known.search(piece.column(1).to_pylist())
                    take = [i for i, g in enumerate(got) for _ in g]
                    flat = [x for g in got for x in g]
                    columns = [
                        piece.column(0).take(pa.array(take, pa.int64())),
                        pa.array([known.ids[r] for r, _ in flat], pa.binary()),
                        pa.array([s for _, s in flat], pa.int32()),
                        pa.array([len(known.shingles[r]) for r, _ in flat], pa.int32()),
                    ]
                    if flat:
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "shared", "size"])

        return source.mapInArrow(run, f"doc_id {doc_kind}, key binary, shared int, size int")

    found = _each_pass(items, item_text_col, look, max_bytes)
    text = F.coalesce(F.col(item_text_col).cast("string"), F.lit(""))
    names = items.select(F.unhex(F.md5(text.cast("binary"))).alias("key"), F.col(item_col).alias("item_id"))
    return found.join(names, "key").select(F.col("doc_id").alias(id_col), "item_id", "shared", "size")


def without_items(docs: DataFrame, items: DataFrame, text_col: str = "text", item_text_col: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """The documents, all columns, that contain no item."""
    parts = passes(items, item_text_col, max_bytes)
    at, spark, held = docs.columns.index(text_col), docs.sparkSession, None
    for part in parts:
        if held is not None:
            docs = stored(docs, "clean")
            held.destroy()
        held, name = spark.sparkContext.broadcast(part), uuid.uuid4().hex

        def run(batches, held=held, name=name):
            known = _sketches(name, held.value)
            for batch in batches:
                for piece in pieces(batch, at):
                    got = known.search([t or "" for t in piece.column(at).to_pylist()])
                    yield piece.filter(pa.array([not g for g in got], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
