"""Makes this package importable in Python workers, wherever the driver was started, and bounds what they are sent at a time."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to all workers, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="larkspur-"), "larkspur.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("larkspur", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


#: Rows and bytes that one Arrow batch may hold; the JVM keeps a batch as a whole, a Python worker up to two.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def prepare(spark: SparkSession) -> None:
    """Before Python workers are used: send them the package, and lower the session's Arrow batches to ``BATCH_ROWS`` rows and
    ``BATCH_BYTES`` bytes where they are larger (results don't depend on it)."""
    ship(spark)
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    number, unit = re.fullmatch(r"(\d+)([kmg]?)b?", spark.conf.get(size).lower()).groups()
    if not 0 < int(number) << {"": 0, "k": 10, "m": 20, "g": 30}[unit] <= BATCH_BYTES:
        spark.conf.set(size, str(BATCH_BYTES))
