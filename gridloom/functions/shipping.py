"""Makes this package importable in Python workers, wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Adds the package's sources, a few hundred kB, to the application once.

    Workers then import them from Spark's own file distribution, so nothing
    has to be installed on, or shared with, the executors.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    folder = tempfile.mkdtemp(prefix="gridloom-")
    target = os.path.join(folder, "gridloom_sources.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for top, _, names in os.walk(os.path.join(_ROOT, "gridloom")):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(top, name)
                    out.write(path, os.path.relpath(path, _ROOT))
        for name in sorted(os.listdir(_ROOT)):  # top-level modules, whose functions may be sent to workers by name
            if name.endswith(".py") and not name.startswith((".", "bench")):
                out.write(os.path.join(_ROOT, name), name)
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)
