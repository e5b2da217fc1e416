"""The package's code on the workers, wherever the driver was started."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to all present and later executors of the session, once per application.

    Not needed where the package is installed on every machine; harmless there.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _DONE:
        root = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="sparkwarden-"), "sparkwarden.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for folder, _, files in os.walk(root):
                for name in sorted(f for f in files if f.endswith(".py")):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("sparkwarden", os.path.relpath(full, root)))
        sc.addPyFile(path)
        _DONE.add(sc.applicationId)
    return spark
