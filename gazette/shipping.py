"""Make this package importable in the Python workers, whatever their working folder is."""

from __future__ import annotations

import tempfile
import threading
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()
_shipping = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """What ``--py-files`` does, once per application: Spark hands the package to its executors.

    Grids call it from several threads; a second archive of the same name would be refused.
    """
    context = spark.sparkContext
    with _shipping:
        if context.applicationId in _shipped:
            return
        path = Path(tempfile.mkdtemp(prefix="gazette-")) / f"{PACKAGE.name}.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
            for file in sorted(PACKAGE.rglob("*")):
                if file.suffix in (".py", ".txt"):
                    archive.write(file, file.relative_to(PACKAGE.parent))
        context.addPyFile(str(path))
        _shipped.add(context.applicationId)
