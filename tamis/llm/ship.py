"""Makes this package importable on the Python workers of any cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile

import tamis


def ship(spark) -> None:
    """Send the package to the executors once per application (``addPyFile``).

    Workers then import the operators' helpers by name and keep their module-level
    caches between tasks. Sessions without a SparkContext need the package installed.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # remote sessions have no SparkContext
        return
    if getattr(sc, "_tamis_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(tamis.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tamis-ship-"), "tamis_workers.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith((".py", ".csv")):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("tamis", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._tamis_shipped = True
