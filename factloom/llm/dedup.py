"""Removal of repeated byte strings: every byte that lies in a LENGTH-byte string which also starts anywhere else.

1. Equal texts, by SHA-256, collapse to one row with its number of copies, in a table bucketed by that key.
2. Each window of LENGTH bytes belongs to its minimizer, the least hash of its GRAM-byte substrings, so equal windows
   meet wherever they stand. Neighbouring windows with one minimizer form a segment, known by a 128-bit digest.
3. A minimizer that occurs once has no repeats. One whose segments are all the same bytes is repeated throughout. Only
   the distinct segments of other minimizers need their bytes.
4. These are dealt out by minimizer into shards of about SHARD_BYTES. A shard is written to a file and suffix-sorted by
   external induced sorting, whatever its size; windows whose common prefix with a neighbour is LENGTH bytes are
   repeated. A minimizer with over HOT different segments or over HOT_BYTES of them (a passage that very many texts
   share in different surroundings, or long runs of a short period, which are one segment each) would put one key's
   rows into one task, and suffix order cannot be split by rows: its windows are counted by 128-bit hashes, which any
   number of tasks share, and those that agree are compared byte by byte.
5. The spans of each distinct text unite, and every document takes its text's result.

No step gathers the members of a group: hot minimizers and hot texts are counted before they are shuffled, and the joins
that lead back to texts are ones that can be split.

Defined results: null texts are empty; texts under LENGTH bytes keep every byte; a text with copies of LENGTH bytes or
more loses all of them; strings are judged on the input; nothing depends on ids, which may be null or repeat.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import suffixes
from factloom.llm.arrow import label, pieces, stored, trim
from factloom.llm.decontaminate import POWERS, _byte_values
from factloom.llm.suffixes import Scratch

LENGTH = 200
GRAM = 24
SHARD_BYTES = 2 << 20
#: Different segments of one minimizer that a shard takes, and their bytes.
HOT = 1 << 16
HOT_BYTES = 4 * SHARD_BYTES
#: Windows of a segment that are hashed, and gathered again, at a time.
SLICE = 1 << 18
MAX_HOT = 10_000
#: The low bits of a hash that give way to its place, to find the leftmost and rightmost least.
PLACE = np.uint64((1 << 24) - 1)


def _mixed(value: np.ndarray) -> np.ndarray:
    value = value ^ (value >> np.uint64(29))
    value *= np.uint64(0xBF58476D1CE4E5B9)
    return value ^ (value >> np.uint64(32))


def _window_least(value: np.ndarray, width: int) -> np.ndarray:
    """The least of each width values in a row."""
    have, n = 1, len(value) - width + 1
    while have * 2 <= width:
        value = np.minimum(value[:-have], value[have:])
        have *= 2
    return np.minimum(value[:n], value[width - have :][:n])


def segments(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Row, start and size of each segment, the hash of its minimizer, the digest of its bytes, and whether the minimizer
    stands in it more than once, as it must where windows of one segment are equal."""
    joined = b"".join(texts)
    whole = np.frombuffer(joined, np.uint8)
    none = np.zeros(0, np.int64)
    if len(whole) < length:
        return none, none, none, none, [], none.astype(bool)
    POWERS.need(len(whole) + 1)
    sums = np.zeros(len(whole) + 1, np.uint64)
    np.cumsum(_byte_values()[whole] * POWERS.up[: len(whole)], out=sums[1:])
    grams = _mixed((sums[gram:] - sums[:-gram]) * POWERS.down[: len(whole) - gram + 1])
    width, place = length - gram + 1, np.arange(len(grams), dtype=np.uint64)
    left = _window_least(grams & ~PLACE | place & PLACE, width)
    right = _window_least(grams & ~PLACE | ~place & PLACE, width)
    at = place[: len(left)]
    left, right = at + ((left - at) & PLACE), at + ((~right - at) & PLACE)
    least = grams[left]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    row = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
    inside = np.arange(len(least)) + length <= ends[row]
    begin = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (row[1:] != row[:-1])]))
    begin = begin[inside[begin]]
    # The last window of a segment comes before the next segment and ends inside its text.
    stop = np.minimum(np.append(begin[1:], len(least)), ends[row[begin]] - length + 1) + length - 1
    content = [xxhash.xxh3_128_digest(joined[a:b]) for a, b in zip(begin.tolist(), stop.tolist())]
    owner = row[begin]
    several = (left[begin] != right[stop - length]) | (stop - begin > 2 * length)
    return owner, begin - (ends - sizes)[owner], stop - begin, least[begin].view(np.int64), content, several


def _segment_rows(batches):
    for batch in batches:
        for piece in pieces(batch, 2):
            texts = [t.encode() for t in piece.column(2).to_pylist()]
            owner, start, size, least, content, several = segments(texts)
            take = pa.array(owner)
            columns = [piece.column(0).take(take), piece.column(1).take(take), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(least), pa.array(content, pa.binary()), pa.array(several)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "copies", "start", "size", "least", "content", "several"])
    trim()


def _cut(batches):
    """The bytes of the listed segments of each text."""
    for batch in batches:
        for piece in pieces(batch, 0):
            least, content, copies, cut = [], [], [], []
            for text, wanted in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                raw = text.encode()
                for w in wanted:
                    least.append(w["least"]), content.append(w["content"]), copies.append(w["copies"])
                    cut.append(raw[w["start"] : w["start"] + w["size"]])
            yield pa.RecordBatch.from_arrays([pa.array(least, pa.int64()), pa.array(content, pa.binary()), pa.array(copies, pa.int64()), pa.array(cut, pa.binary())], names=["least", "content", "copies", "bytes"])


SPANS = "array<struct<start:int,end:int>>"
SPANS_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _covered(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of bytes covered by windows at a mask of starts."""
    a, b = _runs(starts)
    if len(a):
        b = b + length - 1
        new = np.concatenate([[True], a[1:] > b[:-1]])
        first = np.flatnonzero(new)
        a, b = a[first], b[np.append(first[1:], len(a)) - 1]
    return a, b


def _squeezed(raw: bytes) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes with runs of one byte cut down to LENGTH, and the cuts: where a run begins, and how much of it is gone.

    All windows inside such a run are equal, and no other window sees more than LENGTH - 1 bytes of it."""
    text = np.frombuffer(raw, np.uint8)
    edges = np.concatenate([[0], np.flatnonzero(text[1:] != text[:-1]) + 1, [len(text)]])
    size = np.diff(edges)
    long = np.flatnonzero(size > LENGTH)
    if not len(long):
        return raw, []
    out, cuts, at = [], [], 0
    for a, n in zip(edges[long].tolist(), size[long].tolist()):
        out.append(raw[at : a + LENGTH])
        at = a + n
        cuts.append((a, n - LENGTH))
    return b"".join([*out, raw[at:]]), cuts


def _widened(again: np.ndarray, cuts: list[tuple[int, int]]) -> np.ndarray:
    """The mask of a squeezed segment's windows in the whole one."""
    parts, at, gone = [], 0, 0
    for a, n in cuts:
        parts += [again[at : a - gone], np.ones(n + 1, bool)]
        at, gone = a - gone + 1, gone + n
    return np.concatenate([*parts, again[at:]])


def _repeated(text: np.ndarray, fits: np.ndarray, again: np.ndarray, scratch: Scratch, held: int, base: int) -> None:
    """Mark, among the windows that fit, those whose common prefix with a neighbour in suffix order is LENGTH bytes."""
    last, low = None, LENGTH
    for position, prefix in suffixes.suffixes(text, 255, LENGTH, scratch, held, base):
        at = np.flatnonzero(fits[position])
        if not len(at):
            low = min(low, int(prefix.min()))
            continue
        least = np.minimum.reduceat(prefix[: at[-1] + 1], np.concatenate([[0], at[:-1] + 1]))
        least[0] = min(int(least[0]), low) if last is not None else 0
        here, same = position[at], least >= LENGTH
        again[here[same]] = True
        again[np.concatenate([here[:1] if last is None else last, here[:-1]])[same]] = True
        last, low = here[-1:], int(prefix[at[-1] + 1 :].min(initial=LENGTH))


def _shard(batches, held: int = suffixes.HELD, base: int = suffixes.BASE):
    """Repeated spans of the segments of one shard; a segment with copies is repeated throughout. Bytes, and all that the
    sort keeps of them, lie in files."""
    with Scratch() as scratch:
        rows, sizes, cuts, at = [], [], {}, 0
        with open(scratch.name(), "wb") as out:
            path = out.name
            for batch in batches:
                for raw in batch.column(3).to_pylist():
                    raw, gone = _squeezed(raw)
                    if gone:
                        cuts[len(sizes)] = gone
                    sizes.append(len(raw))
                    out.write(raw)
                rows.append(batch.select([0, 1, 2]))
        sizes = np.array(sizes, np.int64)
        ends = np.cumsum(sizes)
        if not len(sizes):
            return
        text = np.memmap(path, np.uint8, "r", shape=(int(ends[-1]),))
        again, fits = scratch.array(np.bool_, len(text)), scratch.array(np.bool_, len(text))
        # Windows that run over a segment's end stand for no string of the input.
        for e, n in zip(ends.tolist(), sizes.tolist()):
            fits[e - n : max(e - n, e - LENGTH + 1)] = True
        _repeated(text, fits, again, scratch, held, base)
        k = 0
        for batch in rows:
            spans = []
            for copies in batch.column(2).to_pylist():
                mask = np.asarray(again[ends[k] - sizes[k] : ends[k]])
                mask = _widened(mask, cuts[k]) if k in cuts else mask
                a, b = (np.array([0]), np.array([len(mask)])) if copies > 1 else _covered(mask, LENGTH)
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(a, b)])
                k += 1
            keep = pa.array(np.flatnonzero([bool(x) for x in spans]))
            if len(keep):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array([spans[i] for i in keep.to_pylist()], SPANS_TYPE)], names=["least", "content", "spans"])
        del text, again, fits
    trim()


@cache
def _other_values() -> np.ndarray:
    return np.random.default_rng(17).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _slices(batches):
    """Segments (least, content, copies, bytes) in small batches, long ones cut, with each slice's offset."""
    for batch in batches:
        for piece in pieces(batch, 3, SLICE):
            parts = piece.column(3).to_pylist()
            if len(parts) > 1:
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(np.zeros(len(parts), np.int64))], names=["least", "content", "copies", "bytes", "offset"])
                continue
            for at in range(0, max(len(parts[0]) - LENGTH + 1, 1), SLICE):
                yield pa.RecordBatch.from_arrays([*piece.columns[:3], pa.array([parts[0][at : at + SLICE + LENGTH - 1]], pa.binary()), pa.array([at], pa.int64())], names=["least", "content", "copies", "bytes", "offset"])


def _window_rows(batches):
    """Two hashes of each window of the given segments; long segments go by slices that overlap by LENGTH - 1 bytes."""
    for piece in _slices(batches):
        parts = piece.column(3).to_pylist()
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        text = np.frombuffer(b"".join(parts), np.uint8)
        POWERS.need(len(text) + 1)
        ends = np.cumsum(sizes)
        count = np.maximum(sizes - LENGTH + 1, 0)
        owner = np.repeat(np.arange(len(parts)), count)
        start = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        place = (ends - sizes)[owner] + start
        hashes = []
        for values in (_byte_values(), _other_values()):
            sums = np.zeros(len(text) + 1, np.uint64)
            np.cumsum(values[text] * POWERS.up[: len(text)], out=sums[1:])
            hashes.append(pa.array(_mixed((sums[place + LENGTH] - sums[place]) * POWERS.down[place]).view(np.int64)))
        take = pa.array(owner)
        start += piece.column(4).to_numpy()[owner]
        yield pa.RecordBatch.from_arrays([*(piece.column(k).take(take) for k in range(3)), pa.array(start.astype(np.int32)), *hashes], names=["least", "content", "copies", "start", "h1", "h2"])
    trim()


def _window_bytes(batches):
    """The bytes of the windows of listed places: least, content, copies, start, bytes."""
    for batch in batches:
        for piece in pieces(batch, 3, SLICE // LENGTH):
            least, content, copies, start, window = [], [], [], [], []
            for row in piece.to_pylist():
                for s in row["starts"]:
                    least.append(row["least"]), content.append(row["content"]), copies.append(row["copies"]), start.append(s)
                    window.append(row["bytes"][s : s + LENGTH])
            yield pa.RecordBatch.from_arrays([pa.array(least, pa.int64()), pa.array(content, pa.binary()), pa.array(copies, pa.int64()), pa.array(start, pa.int32()), pa.array(window, pa.binary())], names=["least", "content", "copies", "start", "window"])


def _joined(batches):
    """Spans of the windows that start at the listed places: touching ones become one."""
    for batch in batches:
        spans = []
        for starts in batch.column(2):
            x = np.sort(starts.values.to_numpy())
            first = np.flatnonzero(np.concatenate([[True], x[1:] > x[:-1] + LENGTH]))
            ends = x[np.append(first[1:], len(x)) - 1] + LENGTH
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(x[first], ends)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, SPANS_TYPE)], names=["least", "content", "spans"])


def _results(batches):
    for batch in batches:
        for piece in pieces(batch, 2):
            out = []
            for copies, text, found in zip(piece.column(1).to_pylist(), piece.column(2).to_pylist(), piece.column(3).to_pylist()):
                raw = text.encode()
                if copies > 1 and len(raw) >= LENGTH:
                    spans = [(0, len(raw))]
                else:
                    spans = []
                    for a, b in sorted((s["start"], s["end"]) for s in found or ()):
                        if spans and a <= spans[-1][1]:
                            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
                        else:
                            spans.append((a, b))
                kept, at = [], 0
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                out.append((len(raw), spans, hashlib.sha256(b"".join(kept)).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array([n for n, _, _ in out], pa.int64()), pa.array([[{"start": a, "end": b} for a, b in s] for _, s, _ in out], SPANS_TYPE), pa.array([h for _, _, h in out])],
                names=["key", "n_bytes", "spans", "kept_sha256"],
            )


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, hot: int = HOT, hot_bytes: int = HOT_BYTES, held: int = suffixes.HELD, base: int = suffixes.BASE) -> DataFrame:
    """Columns: the id, n_bytes, spans (removed byte runs: start, end), kept_sha256."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col), F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"), text.alias("text"))
    name = f"{label(spark)}_texts_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.any_value("text").alias("text"))
    distinct.write.bucketBy(buckets, "key").saveAsTable(name)
    texts = spark.table(name)

    found = stored(texts.select("key", "copies", "text").where(F.octet_length("text") >= LENGTH).mapInArrow(_segment_rows, "key binary, copies long, start int, size int, least long, content binary, several boolean"), "segments")
    # Minimizers that occur more than once, and whether they do in the same segment over and over.
    counted = found.groupBy("least").agg(F.sum("copies").alias("n"), (F.min("content") == F.max("content")).alias("same"), F.bool_or("several").alias("several"))
    shared = counted.where("n > 1 or several").select("least", F.expr("n > 1 and same").alias("alike"))
    hits = stored(found.join(shared, "least").select("key", "copies", "start", "size", "least", "content", "alike"), "hits")
    whole = hits.where("alike").select("key", "start", (F.col("start") + F.col("size")).alias("end"))
    mixed = hits.where("not alike")
    chosen = stored(mixed.groupBy("least", "content").agg(F.sum("copies").alias("copies"), F.min(F.struct("key", "start", "size")).alias("at")), "chosen")
    crowded = stored(chosen.groupBy("least").agg(F.count(F.lit(1)).alias("n"), F.sum("at.size").alias("bytes")).where((F.col("n") > hot) | (F.col("bytes") > hot_bytes)).select("least"), "crowded")
    crowds = crowded.limit(MAX_HOT + 1).count()
    crowded = F.broadcast(crowded) if crowds <= MAX_HOT else crowded
    calm = chosen.join(crowded, "least", "left_anti") if crowds else chosen

    def cut(rows: DataFrame) -> DataFrame:
        wanted = rows.select("at.key", F.struct("least", "content", "copies", "at.start", "at.size").alias("w")).groupBy("key").agg(F.collect_list("w").alias("wanted"))  # at most a text's own segments
        return texts.select("key", "text").join(wanted, "key").select("text", "wanted").mapInArrow(_cut, "least long, content binary, copies long, bytes binary")

    size = calm.agg(F.sum("at.size")).first()[0] or 0
    spans = cut(calm).repartition(max(1, math.ceil(size / shard_bytes)), "least").mapInArrow(lambda batches: _shard(batches, held, base), f"least long, content binary, spans {SPANS}")
    if crowds:
        bytes_of = cut(chosen.join(crowded, "least", "left_semi"))
        windows = stored(bytes_of.mapInArrow(_window_rows, "least long, content binary, copies long, start int, h1 long, h2 long"), "windows")
        alike = windows.groupBy("least", "h1", "h2").agg(F.sum("copies").alias("n")).where("n > 1").select("least", "h1", "h2")
        offered = windows.join(alike, ["least", "h1", "h2"], "left_semi").groupBy("least", "content", F.floor(F.col("start") / SLICE).alias("slice")).agg(F.collect_list("start").alias("starts"))
        # Hashes only offer: windows are repeated whose bytes are. Each is counted before it is shuffled.
        seen = stored(bytes_of.join(offered, ["least", "content"]).select("least", "content", "copies", "bytes", "starts").mapInArrow(_window_bytes, "least long, content binary, copies long, start int, window binary"), "seen")
        again = seen.groupBy("window").agg(F.sum("copies").alias("n")).where("n > 1").select("window")
        starts = seen.join(again, "window", "left_semi").groupBy("least", "content", F.floor(F.col("start") / SLICE)).agg(F.collect_list("start").alias("starts"))
        spans = spans.unionAll(starts.select("least", "content", "starts").mapInArrow(_joined, f"least long, content binary, spans {SPANS}"))
    part = mixed.join(spans, ["least", "content"]).select("key", "start", F.explode("spans").alias("s")).select("key", (F.col("start") + F.col("s.start")).alias("start"), (F.col("start") + F.col("s.end")).alias("end"))
    removed = whole.unionAll(part).groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    results = texts.select("key", "copies", "text").join(removed, "key", "left").select("key", "copies", "text", "found").mapInArrow(_results, f"key binary, n_bytes long, spans {SPANS}, kept_sha256 string")
    return keyed.select(id_col, "key").join(results, "key").drop("key")
