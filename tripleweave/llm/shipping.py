"""Sends this package to the Python workers, so that a cluster needs nothing installed but the libraries."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_tripleweave_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="tripleweave-")  # executors fetch the file from the driver whenever they start
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "tripleweave-package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    context.addPyFile(archive)
    context._tripleweave_shipped = True
