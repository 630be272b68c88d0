"""SimHash near-duplicates: fingerprints, links at a small Hamming distance, and their components.

The 64 bits are cut into 32 segments of two bits; a fingerprint's embedding is
the vector of its segments' popcounts. The Manhattan distance of two embeddings
is a lower bound of the Hamming distance. The coordinates form three blocks, so
that a distance of at most 4 leaves one block at most 1 apart: each fingerprint
stands in one grid cell a block and visits the cells one step up, and the pairs
that meet are verified on all bits. Only links that join two parts of a cell
leave it, so a dense cell of n fingerprints gives at most n - 1 rows once it is
large. Cells with more than TILE members are dealt out in slices.

Candidates grow with the square of the number of distinct fingerprints at a
selectivity of about 1/900 a block, that of the popcounts; a cell of n members
costs n * n / 2 comparisons, which TILE spreads over tasks.

Defined results: a text without words has fingerprint zero and is linked like
any other; null texts are empty; rows that repeat share a fingerprint; a null id
never names a component; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.arrow import map_texts, stored
from factloom.llm.components import components

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: Segments of each block; three blocks and distances up to 5 leave one block at most 1 apart.
BLOCKS = ((0, 11), (11, 22), (22, 32))
TILE = 4096
SMALL = 64
PAIRS = 1 << 20
MAX_HOT = 10_000
SALT = 32


def fingerprint(text: str) -> int:
    """Bit by bit the majority over all shingles' hashes; ties give 0."""
    return int(fingerprints([text])[0])


def fingerprints(texts: list[str]) -> np.ndarray:
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for row, text in enumerate(texts):
        words = text.encode().lower().split()
        if not words:
            continue
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        n = max(1, len(words) - SHINGLE + 1)
        stops = ends[SHINGLE - 1 :] if len(words) >= SHINGLE else ends[-1:]
        starts = np.concatenate([[0], ends[: n - 1] + 1])
        hashes += map(xxhash.xxh64_intdigest, [line[a:b] for a, b in zip(starts.tolist(), stops.tolist())], repeat(SEED))
        counts[row] = n
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        raw = np.array(hashes, np.uint64).byteswap().view(np.uint8).reshape(-1, 8)
        step, lists = 1 << 16, np.zeros((len(full), 64), np.int64)
        owner = np.repeat(np.arange(len(full)), counts[full])
        for at in range(0, len(raw), step):
            bits = np.unpackbits(raw[at : at + step], axis=1)
            own = owner[at : at + step]
            cut = np.flatnonzero(np.diff(own, prepend=-1))
            lists[own[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
        major = 2 * lists > counts[full][:, None]
        out[full] = np.packbits(major, axis=1).view(np.uint64).ravel().byteswap()
    return out


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns: the id, and fp, the fingerprint's 64 bits as a long."""

    def make():
        return lambda _, texts: [pa.array(fingerprints(texts).view(np.int64))]

    return map_texts(docs, id_col, text_col, make, "fp long")


def embedding(fps: np.ndarray) -> np.ndarray:
    """Popcounts of the 32 two-bit segments, highest first."""
    shifts = np.arange(62, -1, -2, dtype=np.uint64)
    pair = (fps.view(np.uint64)[:, None] >> shifts) & np.uint64(3)
    return ((pair >> np.uint64(1)) + (pair & np.uint64(1))).astype(np.int64)


def _cells(batches):
    """Each fingerprint's own cells (visit false) and the cells one step up (visit true)."""
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        vectors = embedding(fps)
        fp, key, visit = [], [], []
        for b, (low, high) in enumerate(BLOCKS):
            place = 4 ** np.arange(high - low, dtype=np.int64)
            own = vectors[:, low:high] @ place + (b << 24)
            fp.append(fps), key.append(own), visit.append(np.zeros(len(fps), bool))
            for k in range(high - low):
                can = vectors[:, low + k] < 2
                fp.append(fps[can]), key.append(own[can] + place[k]), visit.append(np.ones(int(can.sum()), bool))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (key, fp, visit)], names=["cell", "fp", "visit"])


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= DISTANCE  # of a signed number it would count the magnitude's bits


def _small_links(fp: np.ndarray, inner: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    """All links of small cells: each inner member against the members after it (inner come first in their cell)."""
    first = np.flatnonzero(inner)
    group = np.searchsorted(starts, first, side="right") - 1
    rest = starts[group] + sizes[group] - first - 1
    for at in _runs(rest):
        f, n = first[at], rest[at]
        upto = np.cumsum(n)
        total = int(upto[-1]) if len(upto) else 0
        if total:
            left = np.repeat(f, n)
            right = left + 1 + np.arange(total) - np.repeat(upto - n, n)
            ok = _close(fp[left], fp[right]) & (fp[left] != fp[right])
            yield fp[left[ok]], fp[right[ok]]


def _runs(sizes: np.ndarray):
    """Slices whose sizes sum to about PAIRS."""
    at = 0
    total = np.cumsum(sizes)
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")))
        yield slice(at, stop)
        at = stop


def _large_links(fp: np.ndarray, inner: np.ndarray):
    """A spanning forest of one large cell's links."""
    part = np.arange(len(fp))
    left, right = [], []
    for i in np.flatnonzero(inner):
        other = np.flatnonzero(_close(fp, fp[i]) & (part != part[i]))
        if len(other):
            parts, at = np.unique(part[other], return_index=True)
            left.append(np.full(len(parts), fp[i])), right.append(fp[other[at]])
            part[np.isin(part, parts)] = part[i]
    if left:
        yield np.concatenate(left), np.concatenate(right)


def _links(batches):
    """Links of the cells of a partition sorted by (cell, slice, visit)."""
    held: list[pa.RecordBatch] = []

    def work(table: pa.Table):
        cell, piece, fp, visit = (table.column(i).to_numpy() for i in range(4))
        starts = np.flatnonzero((np.diff(cell, prepend=cell[0] - 1) != 0) | (np.diff(piece, prepend=-1) != 0))
        sizes = np.diff(np.append(starts, len(cell)))
        inner = ~visit
        homes = np.add.reduceat(inner, starts, dtype=np.int64)
        live = (sizes > 1) & (homes > 0)
        small = live & (sizes <= SMALL)
        of = np.repeat(small, sizes)
        if small.any():
            s = sizes[small]
            yield from _small_links(fp[of], inner[of], np.cumsum(s) - s, s)
        for k in np.flatnonzero(live & ~small):
            at = slice(starts[k], starts[k] + sizes[k])
            yield from _large_links(fp[at], inner[at])

    def out(pairs):
        for a, b in pairs:
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cell, piece = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        same = (cell == cell[-1]) & (piece == piece[-1])
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            held.append(batch.slice(0, cut))
            yield from out(work(pa.Table.from_batches(held)))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from out(work(pa.Table.from_batches(held)))


def links(fps: DataFrame, tile: int = TILE) -> DataFrame:
    """From distinct fingerprints (fp): links (a, b) at DISTANCE or fewer bits, enough to join all that are linked."""
    cells = fps.select("fp").mapInArrow(_cells, "cell long, fp long, visit boolean")
    hot = cells.where("not visit").groupBy("cell").count().where(F.col("count") > tile).select("cell", F.ceil(F.col("count") / tile).cast("int").alias("slices"))
    hot = stored(hot, "hot")
    if hot.limit(MAX_HOT + 1).count() <= MAX_HOT:
        hot = F.broadcast(hot)
    cells = cells.join(hot, "cell", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    home = F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int")
    # In its own slice a member is compared with all; in the other slices of a hot cell it only meets that slice's members.
    cells = cells.select("cell", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("piece"), "fp", (F.col("visit") | (home != F.col("piece"))).alias("visit")) if tile else cells
    return cells.repartition("cell", "piece").sortWithinPartitions("cell", "piece", "visit").mapInArrow(_links, "a long, b long")


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, fp, key) of documents, key the digest of their text, with their component's least (id, key); ids that
    are null come last."""
    key = F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), key.alias("key"))

    def make():
        return lambda _, texts: [pa.array(fingerprints(texts).view(np.int64))]

    found = stored(map_texts(rows, "id", "text", make, "fp long", keep=("key",)), "fingerprints")
    least = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "key"))
    distinct = stored(found.groupBy("fp").agg(least.alias("least")), "distinct")
    roots = components(links(distinct)).withColumnRenamed("node", "fp")
    own = distinct.join(roots, "fp", "left")
    single = own.where("root is null").select("fp", "least")
    # A component may hold most fingerprints, so its rows are spread over SALT copies of its least.
    linked = own.where("root is not null").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALT)).cast("int"))
    leasts = linked.groupBy("root").agg(F.min("least").alias("of_all")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    named = linked.join(leasts, ["root", "salt"]).select("fp", F.col("of_all").alias("least"))
    return found.join(single.unionAll(named), "fp").select("id", "fp", "key", "least")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns: the id, fp, and component_id, the least id among all documents reachable over links."""
    found = _named(docs, id_col, text_col)
    return found.select(F.col("id").alias(id_col), "fp", F.col("least.id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, one of each group of near-duplicates: of those with the least id the one whose text has
    the least digest. Of rows that repeat an id and a text any one stays; a row without id stays where no row with an id
    is near it."""
    found = stored(_named(docs, id_col, text_col).where(F.col("id").eqNullSafe(F.col("least.id")) & (F.col("key") == F.col("least.key"))).select("id", "key"), "kept")
    kept = found.distinct().select(F.col("id").alias("kept_id"), F.col("key").alias("kept_key"))
    key = F.unhex(F.md5(F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary")))
    chosen = docs.join(kept, docs[id_col].eqNullSafe(kept["kept_id"]) & (key == kept["kept_key"]), "left_semi")
    return chosen.dropDuplicates([id_col, text_col]) if found.count() > kept.count() else chosen
