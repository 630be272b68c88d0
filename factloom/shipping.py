"""Send this package to the executors, which need not share the driver's folders."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application: a zip of the package, fetched by executors from the driver."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="package-")
    staged = os.path.join(folder, "files", os.path.basename(here))
    shutil.copytree(here, staged, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(os.path.join(folder, "factloom"), "zip", os.path.join(folder, "files")))
    _SENT.add(context.applicationId)
