"""Make the package importable in the Python workers of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[tuple[str, str]] = set()


def ship(spark: SparkSession, *packages: str) -> None:
    """Send this package, and others named by folder, to every executor, each once per
    application. Not needed where the package is installed on the cluster."""
    context = spark.sparkContext
    for package in (os.path.dirname(os.path.abspath(__file__)), *packages):
        if (context.applicationId, package) in _SHIPPED:
            continue
        root, name = os.path.split(package)
        target = os.path.join(tempfile.mkdtemp(prefix="tabulon-"), f"{name}_modules.zip")
        with zipfile.ZipFile(target, "w") as archive:
            for folder, _, files in os.walk(package):
                for file in sorted(files):
                    if file.endswith(".py"):
                        full = os.path.join(folder, file)
                        archive.write(full, os.path.relpath(full, root))
        context.addPyFile(target)
        _SHIPPED.add((context.applicationId, package))
