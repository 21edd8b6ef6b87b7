"""Joins on ids and the algebra of batches. A batch is a DataFrame with a row number ``row_idx`` where order counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def required(df: DataFrame, *columns: str) -> DataFrame:
    """``df``; raises KeyError if a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {', '.join(missing)}")
    return df


def remaining(df: DataFrame, done: DataFrame, key: str = "id", retry: str | None = None) -> DataFrame:
    """Rows whose key isn't done yet, one for each key; ``retry``: a condition on ``done`` for rows that count as not done."""
    done = done.where(~F.expr(retry)) if retry else done
    return df.join(done.select(key).distinct(), key, "left_anti").dropDuplicates([key])


def against_truth(truth: DataFrame, *predictions: tuple[DataFrame, str], key: str = "id") -> DataFrame:
    """Every row of ``truth`` with the predictions of its key and a flag ``has_<name>`` (0 or 1) for each."""
    out = truth
    for df, name in predictions:
        out = out.join(df.withColumn(f"has_{name}", F.lit(1)), key, "left").fillna(0, [f"has_{name}"])
    return out


def missing_keys(truth: DataFrame, prediction: DataFrame, key: str = "id") -> DataFrame:
    """The keys without a prediction, in order."""
    return truth.join(prediction, key, "left_anti").select(key).orderBy(key)


def zipped(a: DataFrame, b: DataFrame, key: str = "row_idx") -> DataFrame:
    """Both batches' columns by row; raises where a shared column differs or a row has no partner."""
    shared = [c for c in a.columns if c in b.columns and c != key]
    other = b.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}" if c in shared else c) for c in b.columns if c != key])
    both = a.join(other, a[key] == other["_key"], "full")
    alone = F.raise_error(F.lit("the batches differ in length")).cast(a.schema[key].dataType)
    both = both.withColumn(key, F.when(F.col(key).isNotNull() & F.col("_key").isNotNull(), F.col(key)).otherwise(alone))
    for c in shared:
        both = both.withColumn(c, F.when(F.col(c).eqNullSafe(F.col(f"_{c}")), F.col(c)).otherwise(F.raise_error(F.lit(f"values of {c} differ")).cast(a.schema[c].dataType)))
    return both.drop("_key", *[f"_{c}" for c in shared])


def scattered(full: DataFrame, part: DataFrame, column: str, key: str = "row_idx", default: str = "") -> DataFrame:
    """``full`` with the results of a part of its rows, and ``default`` elsewhere."""
    return full.join(part.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def repeated(df: DataFrame, times: int, interleave: bool = True, order: str = "row_idx") -> DataFrame:
    """Each row ``times`` times with ``copy`` and the new number ``new_idx``: copies together, or the whole batch again and again."""
    out = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    if interleave:
        return out.withColumn("new_idx", F.col(order) * times + F.col("copy"))
    return out.withColumn("new_idx", F.col("copy") * F.lit(df.count()) + F.col(order))


def first_existing(wanted: DataFrame, listing: DataFrame, bases: Sequence[str], key: str = "id", name: str = "path") -> DataFrame:
    """For each key the path under the first base folder that holds it; null if none does."""
    tries = wanted.select(key, F.posexplode(F.array(*[F.concat(F.lit(b + "/"), name) for b in bases])).alias("rank", "full"))
    hits = tries.join(listing.select(F.col("full").alias("_full")).distinct(), F.col("full") == F.col("_full")).groupBy(key).agg(F.min_by("full", "rank").alias("full"))
    return wanted.select(key).join(hits, key, "left")


def range_of(df: DataFrame, start: int, end: int, order: str = "row_idx") -> DataFrame:
    """Rows from ``start`` up to but without ``end``."""
    return df.where((F.col(order) >= start) & (F.col(order) < end))


def selected(df: DataFrame, columns: Sequence[str], pop: bool = False) -> DataFrame:
    """The columns that there are of those named, or with ``pop`` all others."""
    return df.drop(*columns) if pop else df.select(*[c for c in columns if c in df.columns])


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def merged_record(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Rows with new columns; the new ones win."""
    return df.withColumns(new)


def concatenated(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def padded(df: DataFrame, divisor: int, order: str = "row_idx") -> DataFrame:
    """``df`` with its first rows again, from the beginning in turn, until the count divides; ``is_pad`` marks them."""
    count = df.count()
    pad = -count % divisor if count else 0
    flagged = df.withColumn("is_pad", F.lit(False))
    if not pad:
        return flagged
    rounds = -(-pad // count)
    again = df.withColumn("_round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn(order, F.col(order) + F.col("_round") * count)
    return flagged.unionByName(again.where(F.col(order) < count + pad).drop("_round").withColumn("is_pad", F.lit(True)))


def inverse(order: DataFrame, old: str = "row_idx", new: str = "new_idx") -> DataFrame:
    """The order (``old`` place, ``new`` place) that takes ``order`` back."""
    return order.select(F.col(new).alias(old), F.col(old).alias(new))


def reordered(df: DataFrame, order: DataFrame, old: str = "row_idx", new: str = "new_idx") -> DataFrame:
    """``df`` with its rows at their new places."""
    return df.join(order.select(old, new), old).drop(old).withColumnRenamed(new, old)


def unpadded(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_pad")).drop("is_pad")


def chunked(df: DataFrame, chunks: int, order: str = "row_idx") -> DataFrame:
    """``df`` with ``chunk``, equal parts in order; raises ValueError if the count doesn't divide."""
    count = df.count()
    if chunks < 1 or count % chunks:
        raise ValueError(f"{count} rows don't divide into {chunks} chunks")
    return df.withColumn("chunk", F.floor(F.col(order) / max(1, count // chunks)).cast("int"))


def split(df: DataFrame, size: int, order: str = "row_idx") -> DataFrame:
    """``df`` with ``chunk``, parts of ``size`` rows in order; the last may be smaller."""
    return df.withColumn("chunk", F.floor(F.col(order) / size).cast("int"))


def folded(df: DataFrame, size: int, column: str, order: str = "row_idx") -> DataFrame:
    """Lists of ``size`` values in order."""
    pairs = F.sort_array(F.collect_list(F.struct(order, column)))
    return df.groupBy(F.floor(F.col(order) / size).cast("long").alias("fold")).agg(F.transform(pairs, lambda p: p[column]).alias(column))


def collated(df: DataFrame, size: int, order: str = "row_idx") -> DataFrame:
    """Batches of ``size`` rows as one row each, ``batch`` and every column an array in order."""
    rows = F.sort_array(F.collect_list(F.struct(order, *[c for c in df.columns if c != order])))
    grouped = df.groupBy(F.floor(F.col(order) / size).cast("long").alias("batch")).agg(rows.alias("_rows"))
    return grouped.select("batch", *[F.col("_rows").getField(c).alias(c) for c in df.columns])


def shuffled_key(key: Column, seed: int) -> Column:
    """A number that puts rows in an order that only the seed decides; the same in every run."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"/{seed}")).cast("binary"))


def minibatches(df: DataFrame, size: int, epochs: int, seed: int, key: str, numbered, done: int = 0) -> DataFrame:
    """Every row once an epoch, in an order of the epoch's own, with ``epoch``, ``place`` and ``batch``; an incomplete last batch goes. The first ``done`` batches over all epochs are left out: where an earlier run ended.

    ``numbered(df, *order, name=...)`` gives row numbers.
    """
    whole = df.count() // size
    out = []
    for epoch in range(done // whole if whole else 0, epochs):
        placed = numbered(df.withColumn("_order", shuffled_key(F.col(key), seed + epoch)), "_order", key, name="place").drop("_order")
        batch = F.floor(F.col("place") / size).cast("int")
        out.append(placed.withColumns({"epoch": F.lit(epoch), "batch": batch}).where((F.col("batch") < whole) & (F.col("batch") + epoch * whole >= done)))
    return concatenated(out) if out else df.where("false").withColumns({"place": F.lit(0).cast("bigint"), "epoch": F.lit(0), "batch": F.lit(0)})


def from_columns(spark: SparkSession, columns: dict[str, Sequence]) -> DataFrame:
    """A batch of equally long columns with row numbers; raises ValueError if they aren't."""
    sizes = {len(v) for v in columns.values()}
    if len(sizes) > 1:
        raise ValueError(f"columns of {sorted(sizes)} rows")
    return spark.createDataFrame([(k, *row) for k, row in enumerate(zip(*columns.values(), strict=True))], ["row_idx", *columns])


def equal_sizes(*arrays: Column) -> Column:
    """The first array; raises where the arrays of a row differ in length."""
    same = F.lit(True)
    for other in arrays[1:]:
        same &= F.size(arrays[0]) == F.size(other)
    return F.when(F.assert_true(same).isNull(), arrays[0])
