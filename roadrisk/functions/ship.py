"""Python workers find this package whatever folder or path they start with."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session. The driver builds the
    archive in a scratch folder of its own; Spark serves it to the executors."""
    sc = spark.sparkContext
    if getattr(sc, "_roadrisk_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(tempfile.mkdtemp(prefix="roadrisk-ship-"), "roadrisk.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    p = os.path.join(folder, n)
                    z.write(p, os.path.join("roadrisk", os.path.relpath(p, top)))
    sc.addPyFile(out)
    sc._roadrisk_shipped = True
