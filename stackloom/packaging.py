"""Bring the package to the executors where it isn't installed there."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send a zip of the package's sources to every executor, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="stackloom-ship-"), "stackloom_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, names, files in os.walk(_ROOT):
            names[:] = sorted(n for n in names if n != "__pycache__")
            for name in sorted(f for f in files if f.endswith(".py")):
                full = os.path.join(folder, name)
                out.write(full, os.path.join("stackloom", os.path.relpath(full, _ROOT)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
