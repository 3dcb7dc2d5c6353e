"""Makes the package importable in Python workers, wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent


#: Bytes of a batch that goes to Python at most (Spark's own setting, lowered where it is higher): rows may hold long texts.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ready(spark: SparkSession) -> SparkSession:
    """Ship this package to the executors once per application, and bound the bytes of Arrow batches."""
    context = spark.sparkContext
    if int(spark.conf.get(_BATCH).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    if getattr(context, "_millrace_shipped", False):
        return spark
    at = os.path.join(tempfile.mkdtemp(prefix="millrace-"), "millrace.zip")
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted((_ROOT / "millrace").rglob("*.py")):
            out.write(path, path.relative_to(_ROOT))
    context.addPyFile(at)
    context._millrace_shipped = True
    return spark
