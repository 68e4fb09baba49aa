"""Give the executors' Python workers this package."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_HERE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once per Spark context.

    Arrow kernels are pickled by reference, so a worker must be able to import
    them; Spark's own file server carries the archive to every executor.
    """
    context = spark.sparkContext
    if getattr(context, "_logweave_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="logweave-"), "logweave_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(_HERE.rglob("*.py")):
            out.write(path, path.relative_to(_HERE.parent))
    context.addPyFile(archive)
    context._logweave_shipped = True
