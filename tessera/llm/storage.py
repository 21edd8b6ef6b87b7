"""Tables that cut lineage, written to the folder all executors share.

A written table survives lost executors: a later stage reads it again instead of
recomputing (or losing) it. The folder is the session's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_scope: ContextVar[list[DataFrame] | None] = ContextVar("tables written in the scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own where that is unset and driver and executors are one machine (tests), else RuntimeError."""
    setting = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if setting:
        return setting.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _own[app]


def unused(name: str, columns: Iterable[str]) -> str:
    """``name`` behind as many underscores as make it differ from all ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def written(df: DataFrame, label: str, hashes: bool = False) -> DataFrame:
    """Write ``df`` once and return the table that was written; ``hashes``: mostly hashes, which no dictionary shortens."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{label}-{uuid.uuid4().hex}"
    df.write.option("parquet.enable.dictionary", str(not hashes).lower()).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._tessera_path = path
    if (scope := _scope.get()) is not None:
        scope.append(table)
    return table


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is written inside goes at the end, but for tables that the function given was called with: what is returned reads them. Those belong to the scope around, if there is one."""
    mine: list[DataFrame] = []
    kept: list[DataFrame] = []
    token = _scope.set(mine)

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    try:
        yield keep
    finally:
        _scope.reset(token)
        stay = {getattr(t, "_tessera_path", None) for t in kept}
        dropped(*[t for t in mine if t._tessera_path not in stay])
        if (outer := _scope.get()) is not None:
            outer.extend(t for t in mine if t._tessera_path in stay)


def dropped(*tables: DataFrame) -> None:
    """Delete tables of :func:`written` that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_tessera_path", None)
        if path:
            jvm, hadoop = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(hadoop).delete(target, True)
