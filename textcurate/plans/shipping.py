"""Send the package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent.parent

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's code to the application, once. The archive is served by the driver; it holds no data."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="textcurate-"), "textcurate.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(PACKAGE.rglob("*.py")):
            out.write(path, path.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
