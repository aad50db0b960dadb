"""Making the package known to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_quillrank_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    to = os.path.join(tempfile.mkdtemp(prefix="quillrank-ship-"), "quillrank_src.zip")
    with zipfile.ZipFile(to, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(to)
    sc._quillrank_shipped = True
