"""Sends this package to the executors, for functions that run in their Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Once a Spark context. What the driver finds on its own path says nothing of the workers'."""
    root = Path(__file__).resolve().parents[2]
    sc = spark.sparkContext
    if getattr(sc, "_lorekeep_shipped", False):
        return
    to = Path(tempfile.mkdtemp(prefix="spark-")) / "lorekeep.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((root / "lorekeep").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(to))
    sc._lorekeep_shipped = True
