"""Getting this package to where Python workers run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to Python workers whose path lacks it (once per application)."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    fd, target = tempfile.mkstemp(prefix="versewright-", suffix=".zip")
    with os.fdopen(fd, "wb") as raw, zipfile.ZipFile(raw, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(target)  # the driver serves it; executors fetch it
    _shipped.add(app)
