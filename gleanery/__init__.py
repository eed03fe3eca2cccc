"""Hybrid retrieval over code and documents as Spark jobs: DataFrames in, DataFrames out."""

from __future__ import annotations

import os
import tempfile
import zipfile

_shipped: set[str] = set()


def ship(spark) -> None:
    """Sends this package to the executors, once per application: their Python workers need it and may not see this folder."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    home = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(home):  # it came as such a file itself
        return
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "gleanery.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(home):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("gleanery", os.path.relpath(full, home)))
    sc.addPyFile(path)
