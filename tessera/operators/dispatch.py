"""How work is dealt to numbered workers: all get everything, each its own, or each a run of the rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.stats import planned_ranges


def one_to_all(df: DataFrame, workers: int) -> DataFrame:
    """Every row for every ``worker``."""
    return df.withColumn("worker", F.explode(F.sequence(F.lit(0), F.lit(workers - 1))))


def all_to_all(df: DataFrame, workers: int, order: str = "row_idx") -> DataFrame:
    """Row k for ``worker`` k; raises ValueError unless there is one for each."""
    if df.count() != workers:
        raise ValueError(f"{df.count()} rows for {workers} workers")
    return df.withColumn("worker", F.col(order).cast("int"))


def data_parallel(df: DataFrame, workers: int, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str, order: str = "row_idx") -> DataFrame:
    """``work`` on equal runs of the rows, one a worker, and the results together; raises ValueError if the rows don't divide.

    A run is one pandas table, so ``workers`` must grow with the rows.
    """
    count = df.count()
    if count % workers:
        raise ValueError(f"{count} rows don't divide into {workers}")
    return planned_ranges(df, workers, order).groupBy("part").applyInPandas(lambda run: work(run.drop(columns="part").sort_values(order, ignore_index=True)), schema)
