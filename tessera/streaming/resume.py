"""Streams that resume: each record is processed once over all runs, by file source and checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def processed(spark: SparkSession, source: str, schema: T.StructType, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, key: str = "id", files: int | None = None, time: str | None = None, late: str = "1 day") -> StreamingQuery:
    """Take what is new in a folder of Parquet files through ``work`` into a folder of JSON lines, then end.

    A key that came before, in this run or another, isn't worked on again. ``files``
    bounds how many files a step takes. With ``time``, a column of event times, keys are
    forgotten ``late`` behind the latest one, which bounds the state: repeats must come
    within that. Without it the state grows with the number of keys.
    """
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    rows = reader.parquet(source)
    fresh = rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if time else rows.dropDuplicates([key])
    return work(fresh).writeStream.format("json").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts of event types in tumbling windows, of a stream or a table; an extension beyond record streams."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of users: events with no longer gap between them."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
