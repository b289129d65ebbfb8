"""Makes this package importable in Python workers, wherever they run."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Bytes of an Arrow batch on its way to a Python worker: documents are long, and a batch is held several times over.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def ship(spark: SparkSession) -> None:
    """Bounds Arrow batches, and sends the package's sources to the executors once an application, over Spark's own file server."""
    context = spark.sparkContext
    spark.conf.set(*BATCH)
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as folder:
        shutil.copytree(root, Path(folder, "tree", root.name), ignore=shutil.ignore_patterns("__pycache__"))
        made = shutil.make_archive(str(Path(tempfile.mkdtemp(), root.name)), "zip", Path(folder, "tree"))
    context.addPyFile(made)
    _SHIPPED.add(context.applicationId)
