"""What operators in Arrow share: columns made in Python beside kept ones, and whole runs of equal keys from sorted batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import unused
from tessera.shipping import ship


def beside(df: DataFrame, keep: Sequence[str], value: str, make: Callable[[pa.Array], list[pa.Array]], fields: dict[str, str]) -> DataFrame:
    """The columns ``keep``, whatever their names, with the columns ``fields`` (name and type) that ``make`` gives for the column ``value``; underscores go before the name of one that ``keep`` has."""
    ship(df.sparkSession)
    rows = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{value}`").alias("value"))
    made = [f"v{i}" for i in range(len(fields))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *make(batch.columns[-1])], [*batch.schema.names[:-1], *made])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + [f"{name} {kind}" for name, kind in zip(made, fields.values(), strict=True)]
    names = [*keep, *[unused(c, keep) for c in fields]]
    return rows.mapInArrow(run, ", ".join(kinds)).toDF(*names)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 1 << 17) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of about ``rows`` rows that end where a run ends, with the run number of each row.

    ``batches`` must be sorted by ``keys`` (integers without nulls). What is held is bounded by ``rows`` and the longest run.
    """
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            table, run = _numbered(held, keys)
            cut = int(np.searchsorted(run, run[-1]))
            if cut:
                yield table.slice(0, cut).combine_chunks(), run[:cut]
            held = table.slice(cut).combine_chunks().to_batches()
            count = table.num_rows - cut
    if count:
        yield _numbered(held, keys)


def _numbered(held: list[pa.RecordBatch], keys: list[str]) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches(held).combine_chunks()
    columns = [table[k].to_numpy() for k in keys]
    return table, np.cumsum(np.r_[False, np.any([c[1:] != c[:-1] for c in columns], axis=0)])
