"""Make this package importable in the Python workers of any cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the application once (a zip of its sources that the
    driver serves to every executor)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    parent = os.path.dirname(top)
    name = os.path.join(tempfile.mkdtemp(prefix="package-"), f"{os.path.basename(top)}-sources.zip")
    with zipfile.ZipFile(name, "w") as z:
        for folder, _, files in os.walk(top):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, parent))
    sc.addPyFile(name)
    _SHIPPED.add(sc.applicationId)
