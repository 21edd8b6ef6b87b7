"""Sends this package to the executors, which need not have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_BYTES, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
#: Texts can be long; a worker and the JVM beside it hold a few copies of a batch each.
BATCH = "4m"


def ship(spark: SparkSession) -> None:
    """Add the package to the Python workers of this application, once, and bound the batches they get by ``BATCH`` unless the session says otherwise."""
    context = spark.sparkContext
    if spark.conf.get(_BYTES) == _DEFAULT:  # asked for without a default of our own, which would come back instead of Spark's
        spark.conf.set(_BYTES, BATCH)
    if context.applicationId in _shipped:
        return
    home = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tessera-")) / f"{home.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(home.rglob("*.py")):
            out.write(source, source.relative_to(home.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
