"""Sends the package to the executors, as --py-files would."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def to_executors(spark: SparkSession) -> None:
    """Once per application: a zip of this package's modules goes through the driver's file server."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    _sent.add(app)
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(), "convlake_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    spark.sparkContext.addPyFile(path)
