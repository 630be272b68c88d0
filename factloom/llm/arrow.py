"""Small helpers shared by the Arrow-batched operators of this subpackage."""

from __future__ import annotations

import contextlib
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at a time inside a worker; a longer text is a piece of its own.
PIECE_BYTES = 1 << 20


def pieces(batch: pa.RecordBatch, column: int = 1, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold about ``limit`` bytes, so that memory stays bounded."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start = held = 0
    for row, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def trim() -> None:
    """Give freed memory back to the system: workers live on between tasks, often beside those of other operators."""
    import ctypes
    import gc

    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries can
        ctypes.CDLL(None).malloc_trim(0)


def map_texts(
    rows: DataFrame,
    id_col: str,
    text_col: str,
    make: Callable[[], Callable[[pa.Array, list[str]], list[pa.Array]]],
    fields: str,
    limit: int = PIECE_BYTES,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Apply a batch function to (id, text) rows; a null text counts as empty.

    ``make`` runs once per task and returns the function, so models load once.
    The result has the id column, the columns named in ``keep``, and ``fields`` (a DDL list).
    """
    source = rows.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *(F.col(k) for k in keep))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        names = None
        for batch in batches:
            for part in pieces(batch, 1, limit):
                out = work(part.column(0), part.column(1).to_pylist())
                names = names or [id_col, *keep, *(f.split()[0] for f in _split_fields(fields))]
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], *out], names=names)
        del work
        trim()

    return source.mapInArrow(run, f"{kept}, {fields}")


def _split_fields(fields: str) -> list[str]:
    depth, out, now = 0, [], ""
    for c in fields:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()]


def shared_folder(spark: SparkSession) -> str:
    """The folder of this application in spark.checkpoint.dir, which driver and executors share. Where the session names
    none, one is made beside a local master; on a cluster that is an error, as executors would not see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{label(spark)}"


def label(spark: SparkSession) -> str:
    """A name for what this application leaves in shared places."""
    return "factloom_" + re.sub(r"\W", "_", spark.sparkContext.applicationId)


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """Write rows to a fresh table in the shared folder and read them back: lineage ends there. release() deletes it."""
    spark = rows.sparkSession
    path = fresh(spark, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete all folders and tables that operators of this application have written. Call it once results are saved:
    what has not been computed yet would miss them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    for t in spark.catalog.listTables(pattern=f"{label(spark)}_*"):
        spark.sql(f"DROP TABLE IF EXISTS `{t.name}`")
