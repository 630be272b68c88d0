"""Document lengths from flat token files: ids of fixed width, each document closed by a separator id, and no index.

Files are searched in blocks that ignore document boundaries. Each block is searched for separators on its own; one
small row a block (separators, tokens after the last) goes through a prefix scan by file, which stitches documents that
cross blocks, however many they cross; the lengths inside blocks join the scan's result and pass through no window.

Files are written by Spark's own text writer, which commits them on any file system: a row is a document's ids, high
byte first, and the line separator is the separator id. So that id must be free in the vocabulary and its bytes must be
text; separator_for() finds the least such id and the width.

Defined results: an empty file has no documents; an empty document counts 0 tokens; tokens after the last separator
make a document with complete = false; separators in a row close empty documents; a file whose size is no multiple of
the width is an error, as is one over 2 GB, which Spark does not read whole. A null text is written as empty; null and
repeated ids are kept.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.arrow import map_texts, stored
from factloom.llm.bpe import encoder

BLOCK_TOKENS = 1 << 19
FIELDS = "block long, gaps array<long>, tail long"


@cache
def separator_for(vocabulary: int) -> tuple[int, str]:
    """The least id from ``vocabulary`` on whose bytes are text, and the type of ids: two bytes where that is enough."""
    for width in (2, 4):
        for i in range(vocabulary, min(256**width, vocabulary + (1 << 24))):
            try:
                i.to_bytes(width).decode()
            except UnicodeDecodeError:
                continue
            return i, f">u{width}"
    raise ValueError(f"no separator for a vocabulary of {vocabulary} ids")


def vocabulary(ranks: str) -> int:
    """One more than the greatest id of a file of ranks."""
    return len(encoder(ranks).token)


def write_flat(rows: DataFrame, ranks: str, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode texts into flat files under a new path, one a partition; columns of the result: the id, file (the number in
    the file's name) and ordinal, the document's place in it.

    The rows must come alike each time they are computed, as those of files do; store others first.
    """
    separator, kind = separator_for(vocabulary(ranks))
    where = F.monotonically_increasing_id()
    names = rows.select(F.col(id_col), F.shiftright(where, 33).cast("int").alias("file"), where.bitwiseAND((1 << 33) - 1).alias("ordinal"))

    def make():
        coder = encoder(ranks)

        def work(_, texts):
            ids, stops = coder.encode(texts)
            raw = pa.py_buffer(ids.astype(kind).tobytes())
            at = np.concatenate([[0], stops]).astype(np.int32) * np.dtype(kind).itemsize
            return [pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(at.astype(np.int32).tobytes()), raw])]

        return work

    flat = map_texts(rows, id_col, text_col, make, "data binary").select(F.col("data").cast("string"))
    flat.write.option("lineSep", separator.to_bytes(np.dtype(kind).itemsize).decode()).text(path)
    return names


def _searched(flat: np.ndarray, separator: int) -> tuple[np.ndarray, int]:
    """Tokens before each separator since the one before, and tokens after the last."""
    at = np.flatnonzero(flat == separator)
    return np.diff(at, prepend=-1) - 1, len(flat) - 1 - (int(at[-1]) if len(at) else -1)


def searched_files(spark: SparkSession, path: str, separator: int, kind: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Columns file (its path), block, gaps and tail of the flat files under a path that Spark reads."""
    width = np.dtype(kind).itemsize

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = memoryview(data.as_buffer())
                if len(raw) % width:
                    raise ValueError(f"{name} holds no whole number of tokens")
                for block, at in enumerate(range(0, len(raw), width * block_tokens)):
                    gaps, tail = _searched(np.frombuffer(raw[at : at + width * block_tokens], kind), separator)
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int64()), pa.array([gaps], pa.list_(pa.int64())), pa.array([tail], pa.int64())], names=["file", "block", "gaps", "tail"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, f"file string, {FIELDS}")


def searched_blocks(blocks: DataFrame, separator: int, kind: str) -> DataFrame:
    """The same of blocks (file, block, data) that are rows already."""
    file = blocks.schema["file"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [_searched(np.frombuffer(d.as_buffer() if d.is_valid else b"", kind), separator) for d in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g for g, _ in found], pa.list_(pa.int64())), pa.array([t for _, t in found], pa.int64())], names=["file", "block", "gaps", "tail"])

    return blocks.select("file", "block", "data").mapInArrow(run, f"file {file}, {FIELDS}")


def stitched(found: DataFrame) -> DataFrame:
    """From searched blocks: file, ordinal (of the document in its file), n_tokens (without the separator), complete."""
    found = stored(found, "searched")
    order = Window.partitionBy("file").orderBy("block")
    small = found.select("file", "block", F.size("gaps").cast("long").alias("n"), "tail")
    small = (
        small.withColumn("before", F.sum("n").over(order) - F.col("n"))
        .withColumn("stretch", F.sum((F.col("n") > 0).cast("long")).over(order))
        .withColumn("open", F.sum("tail").over(Window.partitionBy("file", "stretch").orderBy("block")))
        .withColumn("carried", F.coalesce(F.lag("open").over(order), F.lit(0)))
        .withColumn("last", F.lead("block").over(order).isNull())
    )
    inside = found.where("size(gaps) > 0").select("file", "block", "gaps").join(small.select("file", "block", "before", "carried"), ["file", "block"])
    closed = inside.select("file", "before", "carried", F.posexplode("gaps").alias("k", "gap")).select(
        "file", (F.col("before") + F.col("k")).alias("ordinal"), (F.col("gap") + F.when(F.col("k") == 0, F.col("carried")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("complete")
    )
    rest = small.where("last and open > 0").select("file", (F.col("before") + F.col("n")).alias("ordinal"), F.col("open").alias("n_tokens"), F.lit(False).alias("complete"))
    return closed.unionAll(rest)


def count_tokens(spark: SparkSession, path: str, separator: int, kind: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Lengths of all documents in the flat files under a path: file, ordinal, n_tokens, complete."""
    return stitched(searched_files(spark, path, separator, kind, block_tokens))
