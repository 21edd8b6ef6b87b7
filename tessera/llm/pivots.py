"""Near-duplicates among vectors through a pivot-permutation index.

Equal vectors of equal label count once, as a class. Each class is described by its
``LONG`` nearest reference points (pivots: vectors drawn by a hash, none near another) in order, and enters
the inverted lists of the first ``SHORT`` of them, one list for each label, number of
dimensions and pivot. Within a list the pairs that share at least ``SHARED`` pivots are
candidates, counted by blocked matrix products over marks; only of candidates a cosine is
taken, in double precision. A pair counts only in the smallest list that both are in,
so the number of links adds up over the lists. A list returns per class the weight of
its links there and one link of a spanning forest, never its pairs.

The number of pivots grows with the square root of the classes up to ``MOST_PIVOTS`` (or
``DRAWN_BYTES``), which bounds what is broadcast; beyond about 270 million classes lists
grow with the table. A list of more than ``LIST`` classes is cut into groups,
each pair of groups being a cell of its own, so no task holds more and no pair is
missed.

Vectors that are null, zero or hold null or non-finite components, and rows with a null
label or a null id, link with nothing. Vectors of different length never link.
Rows are kept one to one; repeated rows are links of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.runs import whole_runs
from tessera.llm.simhash import joined
from tessera.llm.storage import scratch, written
from tessera.llm.vectors import matrix, units, usable
from tessera.shipping import ship

COSINE = 0.98
LONG = 12
SHORT = 4
SHARED = 4
LIST = 384
MOST_PIVOTS = 32768
#: Bytes of drawn vectors that go to the driver.
DRAWN_BYTES = 128 << 20
#: Vectors drawn for each pivot wanted, and the cosine from which two are too alike to be both pivots.
DRAWN = 4
PIVOT_COSINE = 0.8
_BLOCK = 256


def pivot_count(classes: int) -> int:
    """Twice the square root of the number of classes, from 32 to ``MOST_PIVOTS``."""
    return int(min(MOST_PIVOTS, max(32, 2 * classes**0.5)))


def apart(drawn: np.ndarray, most: int) -> np.ndarray:
    """The first ``most`` of the drawn unit vectors that aren't near one before: a dense group gives one pivot, so its members order the pivots alike."""
    kept = np.zeros((0, drawn.shape[1]))
    for start in range(0, len(drawn), _BLOCK):
        part = drawn[start : start + _BLOCK]
        part = part[~(part @ kept.T >= PIVOT_COSINE).any(1)]
        near = np.tril(part @ part.T >= PIVOT_COSINE, -1)
        good = np.ones(len(part), np.bool_)
        for k in range(len(part)):
            good[k] = not (near[k] & good).any()
        kept = np.vstack([kept, part[good]])
        if len(kept) >= most:
            break
    return kept[:most]


def nearest_pivots(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The places of each vector's ``LONG`` nearest pivots, nearest first."""
    near = unit @ pivots.T
    k = min(LONG, near.shape[1])
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1).astype(np.int32)


def _cell_links(pivot: int, perm: np.ndarray, unit: np.ndarray, weight: np.ndarray, side: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Of one cell: the weight of each member's links and the root of its local component."""
    n = len(unit)
    found, labels = np.zeros(n, np.int64), np.arange(n)
    known, at = np.unique(perm, return_inverse=True)
    marks = np.zeros((n, len(known)), np.float32)
    marks[np.arange(n)[:, None], at.reshape(perm.shape)] = 1
    least = min(SHARED, perm.shape[1])
    for start in range(0, n, _BLOCK):
        rows = slice(start, min(start + _BLOCK, n))
        near = marks[rows] @ marks.T >= least
        near &= (side[rows, None] == 1) & (side[None] == 2) if side.any() else np.arange(n)[None] > np.arange(n)[rows, None]
        a, b = np.nonzero(near)
        a += start
        for part in range(0, len(a), 1 << 16):
            x, y = a[part : part + (1 << 16)], b[part : part + (1 << 16)]
            short_x, short_y = perm[x, :SHORT], perm[y, :SHORT]
            both = np.where((short_x[:, :, None] == short_y[:, None, :]).any(2), short_x, np.iinfo(np.int32).max)
            here = both.min(1) == pivot
            x, y = x[here], y[here]
            good = (unit[x] * unit[y]).sum(1) >= cosine
            x, y = x[good], y[good]
            np.add.at(found, x, weight[y])
            np.add.at(found, y, weight[x])
            joined(labels, x, y)
    while (labels[labels] != labels).any():
        labels = labels[labels]
    return found, labels


def list_links(classes: DataFrame, count: int, width: int, cosine: float = COSINE, most: int = LIST) -> DataFrame:
    """For classes (``node``, ``label``, ``n``, ``vector``): rows ``a``, ``b``, ``w``: ``a`` has links of weight ``w`` in a list, and ``b`` is in its component."""
    spark = classes.sparkSession
    ship(spark)
    wanted = min(pivot_count(count), max(32, DRAWN_BYTES // (8 * width * DRAWN)))
    drawn = classes.orderBy("node").limit(DRAWN * wanted).select("vector").toArrow()
    shared = spark.sparkContext.broadcast(apart(units(matrix(drawn["vector"], width)), wanted))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("vector"), width)
            perm = nearest_pivots(units(x), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.FixedSizeListArray.from_arrays(pa.array(perm.ravel()), perm.shape[1]).cast(pa.list_(pa.int32()))], [*batch.schema.names, "perm"])

    kind = classes.schema["vector"].dataType.simpleString()
    label = classes.schema["label"].dataType.simpleString()
    described = written(classes.select("node", "label", "n", "vector").mapInArrow(describe, f"node long, label {label}, n long, vector {kind}, perm array<int>"), "described")
    keyed = described.select("node", "n", "vector", "perm", F.xxhash64("label", F.size("vector")).alias("kind"), F.explode(F.slice("perm", 1, SHORT)).alias("pivot"))
    sizes = keyed.groupBy("kind", "pivot").count()
    large = written(sizes.where(F.col("count") > most).select("kind", "pivot", F.ceil(F.col("count") / most).cast("int").alias("groups")), "large-lists")
    if large.isEmpty():
        cells = keyed.select("*", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"))
    else:
        sized = keyed.join(large, ["kind", "pivot"], "left").withColumn("groups", F.coalesce("groups", F.lit(1)))
        own = sized.withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("groups")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
        side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
        cells = own.select("node", "n", "vector", "perm", "kind", "pivot", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"))

    places = ["kind", "pivot", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, number in whole_runs(batches, places, 1 << 14):
            node, n, pivot, side = (table[c].to_numpy() for c in ("node", "n", "pivot", "side"))
            perm = table["perm"].combine_chunks().flatten().to_numpy().reshape(len(node), -1)
            unit = units(matrix(table["vector"], width))
            ends = np.flatnonzero(np.r_[number[1:] != number[:-1], True]) + 1
            for start, end in zip(np.r_[0, ends[:-1]], ends, strict=True):
                if end - start < 2:
                    continue
                s = slice(start, end)
                w, root = _cell_links(pivot[start], perm[s], unit[s], n[s], side[s], cosine)
                has = np.flatnonzero(w)
                if len(has):
                    yield pa.RecordBatch.from_arrays([pa.array(node[s][has]), pa.array(node[s][root[has]]), pa.array(w[has])], ["a", "b", "w"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count * SHORT // (1 << 17)))
    return cells.repartition(parts, *places).sortWithinPartitions(*places).mapInArrow(run, "a long, b long, w long")


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """Per row: ``key``, ``n_links``, ``component_id`` (smallest key reachable), ``kept`` (whether that is the row's own)."""
    v = F.col(vector)
    fit = usable(v) & F.col(label).isNotNull() & F.col(key).isNotNull()
    rows = df.select(F.col(key).alias(key), F.when(fit, F.xxhash64(F.col(label), F.size(v), v)).alias("node"), F.col(label).alias("label"), v.alias("vector"))
    whole = rows.where("node IS NOT NULL").groupBy("node", "label", "vector").agg(F.min(key).alias("least"), F.count("*").alias("n"))
    with scratch() as keep:
        classes = written(whole, "classes")
        found = classes.agg(F.count("*"), F.max(F.size("vector"))).first()
        if not found[0]:
            return df.select(key, F.lit(0).cast("long").alias("n_links"), F.col(key).alias("component_id"), F.col(key).isNotNull().alias("kept"))
        links = written(list_links(classes, found[0], found[1], cosine), "list-links")
        roots = components(links.select("a", "b"))
        weight = links.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("w"))
        rooted = classes.select("node", "least", "n").join(roots, "node", "left").join(weight, "node", "left")
        rooted = written(rooted.select("node", "least", (F.col("n") - 1 + F.coalesce("w", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root")), "roots")
        least = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
        named = keep(written(rooted.join(least, "root").select("node", "n_links", "component_id"), "named"))
    out = rows.select(key, "node").join(named, "node", "left")
    component = F.coalesce("component_id", key)
    return out.select(key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col(key) == component, F.lit(False)).alias("kept"))
