"""Cutting lineage in the shared checkpoint folder."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def settled(rows: DataFrame) -> DataFrame:
    """The rows, written once to the folder in spark.checkpoint.dir. Where none is set one is made beside a local master; on a
    cluster that is an error, as executors would not see it."""
    spark = rows.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(folder)
    return rows.checkpoint()
