"""A JSON-lines log that is appended to in order and exactly once.

A batch is written in two steps: its rows, numbered behind those of the batches before, into a
folder of its own, which a second try overwrites; then a commit file that names the batch, its
first number and its rows. The commit file is written beside and renamed to its place, which
fails if it is there. What has no commit file is no part of the log: a run that dies
between the steps leaves nothing to see, and a batch that is handed over again after its
commit is passed over. Readers get the rows in the order in which they came.

Batches are named by whole numbers from 0, as a stream names them (:func:`follow`); a folder has one
writer at a time. A commit reads the last commit file, not the log.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.filters import row_numbers

PLACE = "_place"


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def commits(spark: SparkSession, path: str) -> list[dict]:
    """What has been committed, batch by batch: ``batch``, ``first`` (number of its first row), ``rows``."""
    files, Path = _files(spark, f"{path}/_commits")  # noqa: N806
    if not files.exists(Path(f"{path}/_commits")):
        return []
    names = [s.getPath().getName() for s in files.listStatus(Path(f"{path}/_commits"))]
    found = []
    for name in names:
        if m := re.fullmatch(r"(\d+)-(\d+)-(\d+)\.json", name):
            found.append(dict(zip(("batch", "first", "rows"), map(int, m.groups()), strict=True)))
    return sorted(found, key=lambda c: c["batch"])


def commit_batch(df: DataFrame, path: str, batch: int, *order: str) -> bool:
    """Append the rows of a batch in the total order ``order``; False if it was committed before. Raises ValueError for a batch before the last one that isn't."""
    spark = df.sparkSession
    done = commits(spark, path)
    if any(c["batch"] == batch for c in done):
        return False
    if done and done[-1]["batch"] > batch:
        raise ValueError(f"batch {batch} comes behind batch {done[-1]['batch']}")
    first = done[-1]["first"] + done[-1]["rows"] if done else 0
    row_numbers(df, *order, name=PLACE).withColumn(PLACE, F.col(PLACE) + first).write.mode("overwrite").json(f"{path}/batch={batch}")
    rows = spark.read.schema(f"{PLACE} long").json(f"{path}/batch={batch}").count()
    _commit(spark, path, {"batch": batch, "first": first, "rows": rows})
    return True


def _commit(spark: SparkSession, path: str, said: dict) -> None:
    files, Path = _files(spark, path)  # noqa: N806
    beside = Path(f"{path}/_commits/.{said['batch']}.tmp")
    out = files.create(beside, True)
    out.write(bytearray(json.dumps(said).encode()))
    out.close()
    if not files.rename(beside, Path(f"{path}/_commits/{said['batch']}-{said['first']}-{said['rows']}.json")):
        raise RuntimeError(f"batch {said['batch']} can't be committed in {path}")


def log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The committed rows with ``_place``, their number; sort by it for the order in which they came."""
    folders = [f"{path}/batch={c['batch']}" for c in commits(spark, path) if c["rows"]]
    wide = f"{schema}, {PLACE} long"
    return spark.read.schema(wide).json(folders) if folders else spark.createDataFrame([], wide)


def follow(stream: DataFrame, path: str, checkpoint: str, *order: str) -> StreamingQuery:
    """Append what a stream brings, each of its batches once, until nothing new is there."""
    return stream.writeStream.foreachBatch(lambda df, number: commit_batch(df, path, number, *order) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
