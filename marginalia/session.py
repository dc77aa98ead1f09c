"""Sessions: sending this package's code to the executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once a context, so that they need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_marginalia_shipped", False):
        return
    top = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="marginalia-code-")  # Spark serves the file from here to executors that start later
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/{top.name}_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(top.rglob("*.py")):
            z.write(path, path.relative_to(top.parent).as_posix())
    sc.addPyFile(archive)
    # whole texts and sets make large rows: fewer of them in a batch keep a Python worker's memory bounded
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    sc._marginalia_shipped = True
