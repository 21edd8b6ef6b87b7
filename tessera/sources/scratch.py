"""Tables that cut lineage or fix an order, written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; one of our own where that is unset and driver and executors are one machine, else RuntimeError."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _own.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="tessera-")
        _own[app] = base
    return f"{base.rstrip('/')}/tessera/scratch-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df``, written and read again: what isn't deterministic in it stays as it is."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
