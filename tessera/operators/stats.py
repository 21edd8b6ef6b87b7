"""Aggregations: length profiles, conditional means, evaluation reports, n-gram counts, data metrics."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.arrays import let, ngrams, total, window_hashes
from tessera.operators.filters import row_numbers
from tessera.sources.scratch import kept

PERCENTILES = (50, 75, 90, 95, 99)


#: Bins of one round of a selection; the counts of a round are collected, at most this many for each open interval.
_BINS = 4096


def at_ranks(numbers: DataFrame, column: str, ranks: Iterable[int]) -> dict[int, float]:
    """The values that stand at ``ranks`` (from 0) in ascending order; ``numbers`` is read once a round, so it should be a table.

    Every rank has an interval that holds it, at first all values. A round counts the
    values of each open interval in bins, with the least and the greatest one of each, and a
    rank goes on to the bin that it is in. Bins are of equal width, in every second round on a
    logarithmic scale. An interval's ends fall into different bins, so a round always leaves
    less; most selections take two or three. No task and no driver holds the values. Null
    and NaN don't count.
    """
    kind = numbers.schema[column].dataType.typeName()
    whole = kind in ("byte", "short", "integer", "long")
    x = F.col(column) if whole else F.col(column).cast("double")
    some = numbers.select(x.alias("x")).where(x.isNotNull() if whole else x.isNotNull() & ~F.isnan(x))
    low, high, count = some.agg(F.min("x"), F.max("x"), F.count("*")).first()
    open_ = {rank: (low, high, 0) for rank in set(ranks) if 0 <= rank < count}
    found, number = {}, 0
    while open_:
        found |= {rank: at[0] for rank, at in open_.items() if at[0] == at[1]}
        open_ = {rank: at for rank, at in open_.items() if at[0] != at[1]}
        if not open_:
            break
        intervals = sorted({at for at in open_.values()})
        pieces = [F.when(F.col("x").between(F.lit(lo), F.lit(hi)), _bin(F.col("x"), lo, hi, whole, bool(number % 2)) + place * _BINS) for place, (lo, hi, _) in enumerate(intervals)]
        counted = some.select(F.coalesce(*pieces).alias("bin"), "x").where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        inner: dict[int, list] = {}
        for r in sorted(counted.collect()):
            inner.setdefault(r["bin"] // _BINS, []).append(r)
        for rank, at in list(open_.items()):
            below = at[2]
            for r in inner[intervals.index(at)]:
                if rank < below + r["n"]:
                    open_[rank] = (r["low"], r["high"], below)
                    break
                below += r["n"]
        number += 1
    return found


def _bin(x: Column, low, high, whole: bool, log: bool) -> Column:
    """The bin of a value between ``low`` and ``high``, which lie in the first and the last one; the greater the value the higher."""
    scale = lambda v: math.copysign(min(math.log2(abs(v)), 1024) + 1100, v) if v else 0.0
    if whole:
        part = (x.cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")).cast("double") / float(high - low)
    elif log and scale(high) - scale(low) > 1e-6:
        scaled = F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.least(F.log2(F.abs(x)), F.lit(1024.0)) + 1100))
        part = (scaled - scale(low)) / (scale(high) - scale(low))
    else:  # halves, as the whole width may be no double
        part = (x / 2 - low / 2) / max(high / 2 - low / 2, 5e-324)
    inner = F.floor(F.least(F.greatest(F.nanvl(part, F.lit(0.5)), F.lit(0.0)), F.lit(1.0)) * (_BINS - 2)) + 1
    return F.when(x == F.lit(low), 0).when(x == F.lit(high), _BINS - 1).otherwise(F.least(inner, F.lit(_BINS - 2))).cast("int")


def percentiles(numbers: DataFrame, column: str, shares: Sequence[float]) -> dict[float, float | None]:
    """Exact percentiles, between two values in proportion, by selection; None without values."""
    x = F.col(column).cast("double")
    count = numbers.agg(F.count_if(x.isNotNull() & ~F.isnan(x))).first()[0]
    if not count:
        return dict.fromkeys(shares)
    places = {p: (count - 1) * p for p in shares}
    at = at_ranks(numbers, column, [r for p in places.values() for r in (math.floor(p), math.ceil(p))])
    between = lambda p: at[math.floor(p)] if p == math.floor(p) else (math.ceil(p) - p) * at[math.floor(p)] + (p - math.floor(p)) * at[math.ceil(p)]
    return {share: float(between(p)) for share, p in places.items()}


def length_profile(df: DataFrame, column: str) -> DataFrame:
    """One row: count, min, exact percentiles cut to integers, max and mean; zeros for no rows. The numbers are written once and selected from, so no task holds all different ones."""
    numbers = kept(df.select(F.col(column).alias("x")))
    cut = percentiles(numbers, "x", [p / 100 for p in PERCENTILES])
    zero = lambda c, kind: F.coalesce(c, F.lit(0)).cast(kind)
    said = [F.lit(int(cut[p / 100] or 0)).alias(f"p{p}") for p in PERCENTILES]
    return numbers.agg(F.count("x").alias("count"), zero(F.min("x"), "int").alias("min"), *said, zero(F.max("x"), "int").alias("max"), zero(F.avg("x"), "double").alias("mean"))


def known(x: Column) -> Column:
    """A number, or null for NaN and infinities and for what is no number."""
    x = x.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def mean_where(flag: Column, x: Column) -> Column:
    return F.avg(F.when(flag, known(x)))


def mean_or_worst(x: Column, worst: float) -> Column:
    """The mean with ``worst`` (0 of similarities, 1 of distances) for what is missing."""
    return F.avg(F.coalesce(known(x), F.lit(worst)))


def rate(flag: Column) -> Column:
    return F.sum(flag.cast("int")) / F.greatest(F.count(F.lit(1)), F.lit(1))


def counter(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).count()


def ngram_counts(df: DataFrame, tokens: Column, orders: int = 4) -> DataFrame:
    """Pooled counts of the n-grams of orders 1 to ``orders``: ``n``, ``gram`` (joined by unit separators), ``count``."""
    named = lambda g: F.struct(F.size(g).alias("n"), F.array_join(g, "\x1f").alias("gram"))
    grams = let(tokens, lambda t: F.concat(*[F.transform(ngrams(t, n), named) for n in range(1, orders + 1)]))
    return df.select(F.explode(grams).alias("g")).groupBy("g.n", "g.gram").count()


#: Classes of n-gram hashes that are counted instead of n-grams: a row of each, a task, is all that is shuffled.
_CLASSES = 1 << 18


def trivial_ngrams(df: DataFrame, tokens: Column, k: int = 500, orders: int = 4) -> DataFrame:
    """The ``k`` commonest n-grams; ties by order, then by n-gram.

    Classes of hashes are counted first; a class holds as many as each of its n-grams at least. N-grams
    are spelled, and counted as such, in classes half as common as the k-th. If the k-th n-gram isn't
    as common as that, those of all classes as common as it are spelled. So no n-gram is missed whatever the classes hold.
    """
    words = df.select(tokens.alias("_t"))
    hashes = F.transform("_t", lambda w: F.xxhash64(w))
    class_of = lambda h: h.bitwiseAND(F.lit(_CLASSES - 1)).cast("int")
    every = let(hashes, lambda h: F.concat(*[window_hashes(h, n) for n in range(1, orders + 1)]))
    classes = kept(words.select(F.explode(every).alias("h")).groupBy(class_of(F.col("h")).alias("class")).count())
    top = classes.orderBy(F.desc("count")).limit(k).agg(F.count("*"), F.min("count")).first()
    least = top[1] // 2 if top[0] == k and k else 0

    def common(least: int) -> DataFrame:
        """Counts of the n-grams in classes of ``least`` at least."""
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("class").bitwiseAND(F.lit(63)))
        bits = [0] * (_CLASSES // 64)
        for r in classes.where(F.col("count") >= least).groupBy(F.shiftright("class", 6).alias("at")).agg(F.bit_or(bit).alias("bits")).collect():  # at most as many as ``bits``
            bits[r["at"]] = r["bits"]
        marks = df.sparkSession.createDataFrame([(bits,)], "_marks array<bigint>")

        def spelled(h: Column, n: int) -> Column:
            marked = lambda c: F.getbit(F.get("_marks", F.shiftright(c, 6)), c.bitwiseAND(F.lit(63))) == 1
            placed = F.filter(F.transform(window_hashes(h, n), lambda g, k: F.when(marked(class_of(g)), k)), lambda k: k.isNotNull())
            return F.transform(placed, lambda k: F.struct(F.lit(n).alias("n"), F.array_join(F.slice("_t", k + 1, F.lit(n)), "\x1f").alias("gram")))

        each = let(hashes, lambda h: F.concat(*[spelled(h, n) for n in range(1, orders + 1)]))
        texts = words.crossJoin(F.broadcast(marks)).select(F.explode(each).alias("g"))
        return texts.groupBy("g.n", "g.gram").count().orderBy(F.desc("count"), "n", "gram").limit(k)

    found = kept(common(least))
    if least:
        last = found.agg(F.count("*"), F.min("count")).first()
        if last[0] < k or last[1] < least:
            found = kept(common(last[1] if last[0] == k else 0))
    return found.orderBy(F.desc("count"), "n", "gram")


def fingerprint(df: DataFrame, column: str) -> DataFrame:
    """One row that names the corpus whatever its order, repeats included: the number of rows and the sums of three parts of the texts' MD5."""
    digest = F.md5(F.col(column).cast("binary"))
    part = lambda at: F.coalesce(F.sum(F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint")), F.lit(0))
    return df.agg(F.count("*").alias("rows"), part(1).alias("high"), part(9).alias("low"), part(17).alias("third"))


#: Of the chained fingerprint: a prime modulus, and the number whose powers weigh the places.
CHAIN_PRIME, CHAIN_BASE = (1 << 61) - 1, 1_234_567_890_123_456_789
_RUN = 1024


def ordered_fingerprint(df: DataFrame, column: str, *order: str) -> DataFrame:
    """One row that names the corpus in a total order: the number of ``rows`` and a ``chain`` of 61 bits that any exchanged, changed or missing text changes.

    A text counts as 60 bits of its MD5 (null as another text). The chain is that of h -> h * base
    + text modulo a prime; runs of it are pairs (hash, power of the base), which combine
    in any grouping as long as they stay in order. So runs of rows are chained in tasks, then runs of runs.
    """
    digest = F.conv(F.substring(F.md5(F.coalesce(F.concat(F.lit("t"), F.col(column)), F.lit("n")).cast("binary")), 1, 15), 16, 10)
    wide = "decimal(38,0)"
    prime = F.lit(CHAIN_PRIME).cast("decimal(20,0)")
    rows = row_numbers(df.select(*order, digest.cast("decimal(20,0)").alias("_h")), *order, name="_place")
    live = rows.select(F.col("_place").cast("long").alias("place"), F.col("_h").alias("hash"), F.lit(CHAIN_BASE).cast("decimal(20,0)").alias("power"))
    count = rows.count()

    def chained(s: Column, x: Column) -> Column:
        hash_ = ((s["hash"].cast(wide) * x["power"]).cast(wide) + x["hash"]).cast(wide) % prime
        return F.struct(hash_.cast("decimal(20,0)").alias("hash"), ((s["power"].cast(wide) * x["power"]).cast(wide) % prime).cast("decimal(20,0)").alias("power"))

    start = F.struct(F.lit(0).cast("decimal(20,0)").alias("hash"), F.lit(1).cast("decimal(20,0)").alias("power"))
    left = count
    while left > 1:
        runs = live.groupBy(F.floor(F.col("place") / _RUN).cast("long").alias("place")).agg(F.sort_array(F.collect_list(F.struct("place", "hash", "power"))).alias("x"))
        live = runs.select("place", F.aggregate("x", start, chained).alias("x")).select("place", "x.hash", "x.power")
        left = -(-left // _RUN)
    return live.agg(F.lit(count).cast("long").alias("rows"), F.coalesce(F.max("hash"), F.lit(0)).cast("long").alias("chain"))


def length_metrics(df: DataFrame, column: str, most: float, prefix: str) -> DataFrame:
    x = F.col(column)
    return df.agg(F.avg(x).alias(f"{prefix}_mean"), F.max(x).alias(f"{prefix}_max"), F.min(x).alias(f"{prefix}_min"), F.avg((x == most).cast("int")).alias(f"{prefix}_clip_ratio"))


def explained_variance(returns: Column, values: Column) -> Column:
    return 1 - F.var_samp(returns - values) / (F.var_samp(returns) + 1e-5)


def data_metrics(df: DataFrame, critic: bool = False) -> DataFrame:
    """One row over responses: mean, max and min of the sums of ``scores`` and ``rewards``, and of the masked places of ``advantages`` and ``returns``; with ``critic`` also of ``values``, and the explained variance."""
    three = lambda x, name: [F.avg(x).alias(f"{name}_mean"), F.max(x).alias(f"{name}_max"), F.min(x).alias(f"{name}_min")]
    sums = df.select(total(F.col("scores")).alias("s"), total(F.col("rewards")).alias("r")).agg(*three(F.col("s"), "score"), *three(F.col("r"), "rewards"))
    names = ["advantages", "returns", *(["values"] if critic else [])]
    valid = df.select(F.explode(F.arrays_zip(*names, "mask")).alias("x")).where("x.mask = 1")
    more = [e for name in names for e in three(F.col(f"x.{name}"), name)]
    if critic:
        more.append(explained_variance(F.col("x.returns"), F.col("x.values")).alias("vf_explained_var"))
    return sums.crossJoin(F.broadcast(valid.agg(*more)))


def timing_metrics(df: DataFrame, responses: str, overall: str, seconds: dict[str, float], gpus: int) -> DataFrame:
    """One row: ``timing_s_*``, ``timing_per_token_ms_*`` of the sections that have tokens, and the throughput of the section ``step``."""
    sums = df.agg(F.sum(responses).alias("_r"), F.sum(overall).alias("_o"))
    tokens = dict.fromkeys(("gen", "reward"), F.col("_r")) | dict.fromkeys(("ref", "old", "values", "adv", "update_critic", "update_actor"), F.col("_o"))
    took = [F.lit(float(s)).alias(f"timing_s_{name}") for name, s in seconds.items()]
    each = [(F.lit(seconds[name] * 1000.0) / n).alias(f"timing_per_token_ms_{name}") for name, n in tokens.items() if name in seconds]
    whole = [F.col("_o").alias("total_num_tokens"), F.lit(float(seconds["step"])).alias("time_per_step"), (F.col("_o") / (seconds["step"] * gpus)).alias("throughput")] if "step" in seconds else []
    return sums.select(*took, *each, *whole)


@dataclass(frozen=True)
class Model:
    """The sizes of a model that its floating-point operations depend on; ``experts`` and ``top`` of a mixture."""

    kind: str
    hidden: int
    vocabulary: int
    layers: int
    heads: int
    kv_heads: int
    intermediate: int
    head: int | None = None
    experts: int = 0
    top: int = 0


#: Families whose operations are counted as dense models and as mixtures; peaks of devices in TFLOPS, the first name found counts.
DENSE = ("llama", "qwen2", "qwen2_vl", "qwen2_5_vl", "qwen3", "qwen3_vl")
MIXTURES = ("qwen2_moe", "qwen3_moe", "qwen3_vl_moe")
PEAKS = (("H100", 989.0), ("H800", 989.0), ("A100", 312.0), ("A800", 312.0), ("L40", 181.05), ("L20", 119.5), ("H20", 148.0), ("910B", 354.0))


def peak_tflops(device: str) -> float:
    """A device's peak; infinite for an unknown one."""
    return next((p for name, p in PEAKS if name in device), float("inf"))


def tflops(df: DataFrame, length: str, model: Model, seconds: float) -> DataFrame:
    """One row, ``tflops``: six operations a weight and token and twelve a pair of tokens, head place and layer, over the time; 0 for an unknown family."""
    head = model.head or model.hidden // model.heads
    sums = df.agg(F.coalesce(F.sum(F.col(length).cast("double")), F.lit(0.0)).alias("t"), F.coalesce(F.sum(F.col(length).cast("double") * F.col(length)), F.lit(0.0)).alias("q"))
    if model.kind not in DENSE + MIXTURES:
        return sums.select(F.lit(0.0).alias("tflops"))
    mlp = 3 * model.hidden * model.intermediate * (model.top if model.kind in MIXTURES else 1) + (model.hidden * model.experts if model.kind in MIXTURES else 0)
    attention = 2 * model.hidden * head * (model.heads + model.kv_heads)
    weights = model.layers * (mlp + attention) + 2 * model.vocabulary * model.hidden
    return sums.select(((6.0 * weights * F.col("t") + 12.0 * head * model.heads * model.layers * F.col("q")) / (seconds * 1e12)).alias("tflops"))


def histogram(df: DataFrame, column: str, bins: int, low: float, high: float) -> DataFrame:
    """Counts of equal bins from ``low`` to ``high``; the last one holds its end."""
    x = F.col(column)
    place = F.least(F.floor((x - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.where(x.between(low, high)).groupBy(place.alias("bin")).count()


def planned_ranges(df: DataFrame, parts: int, order: str = "row_idx") -> DataFrame:
    """``df`` with ``part``: ranges of ceil(n / parts) rows."""
    size = max(1, -(-df.count() // parts))
    return df.withColumn("part", F.floor(F.col(order) / size).cast("int"))
