"""Curation filters. Each adds a flag or keeps rows; flags compose into one scan."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.arrays import window_hashes
from tessera.sources.scratch import kept


def max_repeats(tokens: Column, n: int) -> Column:
    """How often the commonest n-gram of an array of tokens occurs; 0 for fewer than n tokens.

    Stays inside the row: the sorted hashes of the n-grams are scanned for their longest run.
    """
    start = F.struct(F.lit(0).cast("bigint").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(state: Column, gram: Column) -> Column:
        run = F.when((state.run > 0) & (state.last == gram), state.run + 1).otherwise(1)
        return F.struct(gram.alias("last"), run.alias("run"), F.greatest(state.most, run).alias("most"))

    words = F.transform(tokens, lambda w: F.xxhash64(w))
    grams = F.sort_array(window_hashes(words, n))
    return F.aggregate(grams, start, step, lambda s: s.most)


def has_repetition(tokens: Column, n: int = 50, threshold: int = 5) -> Column:
    return max_repeats(tokens, n) >= threshold


def repetitive(df: DataFrame, key: str = "id", text: str = "text", fenced: bool = False, n: int = 50, threshold: int = 5, tokens: Callable[[Column], Column] = T.tokens) -> DataFrame:
    """``key`` and ``repeats`` of the rows whose commonest n-gram of ``tokens`` (words, or ids of :func:`tessera.operators.subwords.encoder`) comes ``threshold`` times or more; rows without a key are skipped, and with ``fenced`` only a fence's body counts."""
    code = T.extract_latex(F.col(text)) if fenced else F.col(text)
    counted = df.where(F.col(key).isNotNull()).select(key, tokens(code).alias("_tokens")).select(key, max_repeats(F.col("_tokens"), n).alias("repeats"))
    return counted.where(F.col("repeats") >= threshold)


def bad_geometry(width: Column, height: Column) -> Column:
    """Whether an image is unreadable (null), empty, too small, too large or too elongated."""
    long, short = F.greatest(width, height), F.least(width, height)
    ratio = long / F.when(short > 0, short)
    bad = (width * height == 0) | (short < 32) | (width.cast("long") * height >= 20_000_000) | (long >= 6000) | (ratio >= 15.0)
    return F.coalesce(width.isNull() | height.isNull() | bad, F.lit(True))


def depends_on_files(code: Column) -> Column:
    """Whether code without comments reads other files; empty code doesn't."""
    return (T.empty(code) != "") & T.strip_comments(code).rlike(T.EXTERNAL)


def too_long(text: Column, most: int = 8192, tokens: Callable[[Column], Column] = T.tokens) -> Column:
    return F.size(tokens(T.strip(T.empty(text)))) > most


def image_tokens(width: Column, height: Column, side: int = 28, least_pixels: int = 3136, most_pixels: int = 12_845_056) -> Column:
    """The tokens of an image: squares of ``side`` pixels, after its sides are brought to multiples of it and its area between ``least_pixels`` and ``most_pixels``; null without a size."""
    w, h = width.cast("double"), height.cast("double")
    near = lambda x: F.greatest(F.rint(x / side), F.lit(1.0))
    area = near(w) * near(h) * side * side
    down, up = F.sqrt(w * h / most_pixels), F.sqrt(F.lit(float(least_pixels)) / F.when(w * h > 0, w * h))
    less = F.greatest(F.floor(w / down / side), F.lit(1)) * F.greatest(F.floor(h / down / side), F.lit(1))
    more = F.ceil(w * up / side) * F.ceil(h * up / side)
    return F.when(w * h > 0, F.when(area > most_pixels, less).when(area < least_pixels, more).otherwise((area / (side * side)).cast("long"))).cast("long")


def overlong(text: Column, most: int, images: Column | None = None, videos: Column | None = None, tokens: Callable[[Column], Column] = T.tokens, **sizes: int) -> Column:
    """Whether a prompt has more than ``most`` tokens with its media: ``images`` an array of (width, height), ``videos`` one of (width, height, frames), of which two make one image. Media without a size count as too long."""
    count = F.size(tokens(T.empty(text))).cast("long")
    each = [(images, lambda m: image_tokens(m["width"], m["height"], **sizes)), (videos, lambda m: image_tokens(m["width"], m["height"], **sizes) * F.ceil(m["frames"] / 2))]
    for media, said in each:
        if media is not None:
            count = count + F.when(media.isNull(), F.lit(0).cast("long")).otherwise(F.aggregate(F.transform(media, said), F.lit(0).cast("long"), lambda a, b: a + b))
    return F.coalesce(count > most, F.lit(True))


def only_ok(df: DataFrame, status: str = "status") -> tuple[DataFrame, DataFrame]:
    """Rows whose status is null or ok in any case, and the others."""
    ok = F.coalesce(F.lower(status) == "ok", F.lit(True))
    return df.where(ok), df.where(~ok)


def informative_groups(df: DataFrame, group: str | Sequence[str], score: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows of groups (of one column or several) whose mean score lies strictly between the bounds."""
    names = [group] if isinstance(group, str) else list(group)
    mean = df.groupBy(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(names)]).agg(F.avg(score).alias("_mean")).where((F.col("_mean") > low) & (F.col("_mean") < high))
    return df.join(mean, [df[g] == mean[f"_g{k}"] for k, g in enumerate(names)], "left_semi")


def accumulated(batches: Iterable[DataFrame], keep: Callable[[DataFrame], DataFrame], wanted: int, order: str, most: int = 0, strict: bool = True) -> DataFrame:
    """The first ``wanted`` rows by ``order`` of what ``keep`` leaves of batch after batch, as many as it takes; each batch's rows stand behind those before.

    Raises RuntimeError if a batch leaves nothing, or ``most`` batches (0: any number) aren't enough. If not
    ``strict``, batches that leave nothing are passed over, and all rows are returned if there aren't enough.
    """
    out, count = None, 0
    for number, batch in enumerate(batches):
        if most and number >= most:
            break
        left = kept(keep(batch).withColumn("_batch", F.lit(number)))
        some = left.count()
        if strict and not some:
            raise RuntimeError("no row is kept of a batch")
        if some or out is None:
            out, count = left if not count else out.unionByName(left), count + some
        if count >= wanted:
            break
    if out is None or (strict and count < wanted):
        raise RuntimeError(f"{count} rows after all batches that may be taken; {wanted} are wanted")
    return out.orderBy("_batch", order).limit(wanted).drop("_batch")


def ranges_of_batches(df: DataFrame, order: str, size: int, growth: int = 4) -> Iterator[DataFrame]:
    """``df`` in ranges of its batches, one batch and then ``growth`` times as many a time, for :func:`accumulated`.

    A batch is ``size`` values of the whole number ``order``, named in ``batch``; so few batches are looked at where
    they give much, and few jobs run where they give little. Rows without a number are in none.
    """
    batch = F.call_function("div", F.col(order), F.lit(size).cast("bigint"))
    ends = df.agg(F.min(batch).alias("first"), F.max(batch).alias("last")).first()
    low, last, many = ends["first"] or 0, ends["last"] or 0, 1
    named = df.withColumn("batch", batch)
    while low <= last:
        high = low + many
        within = F.col(order).between((low - 1) * size + 1, high * size + size - 1)  # what files can be left out by
        yield named.where(within & (F.col("batch") >= low) & (F.col("batch") < high))
        low, many = high, many * growth


def ready_for_second_stage(rendered: Column, size: Column, width: Column, height: Column) -> Column:
    """Rendered, of at least 1024 bytes and with sides of at most 15 to 1."""
    ratio = F.greatest(width, height) / F.when(F.least(width, height) > 0, F.least(width, height))
    return F.coalesce(rendered & (size >= 1024) & (ratio <= 15.0), F.lit(False))


def usable_code(code: Column) -> Column:
    """The code if it has more than white space, else null."""
    return F.when(T.strip(T.empty(code)) != "", code)


def _ranged(df: DataFrame, order: tuple[str, ...], own: Column, size: Column, name: str) -> DataFrame:
    """``df`` with a running value: ``own`` within ranges of a total order that are dealt to tasks, and the sum of ``size`` over the ranges before."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = kept(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(size.alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    numbered = ranged.withColumn("_in", own.over(Window.partitionBy("_part").orderBy(*order))).join(F.broadcast(before), "_part")
    return numbered.withColumn(name, F.col("_in") + F.col("_before")).drop("_part", "_in", "_before", "_size")


def row_numbers(df: DataFrame, *order: str, name: str = "row_idx") -> DataFrame:
    """``df`` with its row numbers from 0 in a total order.

    Ranges of the order are counted first, so no task holds more than its range.
    """
    numbered = _ranged(df, order, F.row_number(), F.count("*"), "_number")
    return numbered.withColumn(name, F.col("_number") - 1).drop("_number")


def running_sums(df: DataFrame, value: str, *order: str, name: str = "upto") -> DataFrame:
    """``df`` with the sum of ``value`` up to and with each row in a total order, range by range."""
    return _ranged(df, order, F.sum(value), F.sum(value), name)
