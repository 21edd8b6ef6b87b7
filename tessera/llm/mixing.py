"""Mixing sources to target weights by weighted sampling without replacement; DataFrame functions only.

Every source gets a target in words: sources by code point, null last, weigh 1, 2, 3 in
turn and share all words; a target stops at ``MOST`` times its source's size, and the
excess is shared again by weight until none is above. A source gives as many complete
epochs as fit in its target. For the rest each document draws an exponential key over
its quality weight (Efraimidis and Spirakis), and documents in ascending order of key
are taken whole while the middle of their words is within the rest. The weight is any
positive column, such as a classifier's score; one that is null, no number or not
positive counts as ``LEAST``, so such documents come last.

Nothing is sorted but one small group of keys per source: keys are dealt to groups of
about ``GROUP`` documents by an approximate distribution function, ``KNOTS`` quantiles
with straight lines between, which keeps their order whatever it is worth, and
the running sums over ``SUPER`` groups at a time, then over the groups of one such run,
name the group in which the budget ends. Only that
group is put in order, to find the key at which the source's selection ends. Sources are
numbered range by range, and the level of the targets is found by sums over all sources
in a few rounds, so no task holds all sources.

Keys depend on the seed and the id alone (a null id: on the text), so reruns agree.
Rows of a source with equal keys, that is repeated ids, are taken together. A null text
has size 0; documents of size 0 take 0 words. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.storage import scratch, written
from tessera.operators.filters import row_numbers

MOST = 3
GROUP = 256
#: Key groups of a source that are summed before their running sums are taken.
SUPER = 4096
SEED = 2024
LEAST = 1e-9
KNOTS = 64
WORD = r"[^\x20\x09-\x0D]+"


def quality_weight(chars: Column, size: Column) -> Column:
    """Between 0 and 1, the less the further the characters a word, blanks counted, are from 6."""
    return F.coalesce(1 / (1 + F.abs(chars / F.when(size > 0, size) - 6)), F.lit(1.0))


def sized(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", seed: int = SEED, carry: tuple[Column, ...] = (), weight: Column | None = None) -> DataFrame:
    """Per row the columns ``carry``, then ``source``, ``size`` in words and the exponential ``draw``."""
    said = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    named = F.coalesce(F.col(f"`{key}`").cast("string"), F.concat(F.lit("text "), F.md5(said.cast("binary"))))
    uniform = (F.conv(F.substring(F.md5(F.concat(named, F.lit(f"|{seed}")).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    carried = [c.alias(f"_carry{k}") for k, c in enumerate(carry)]
    given = (weight if weight is not None else F.lit(None)).cast("double").alias("weight")
    rows = docs.select(*carried, F.col(f"`{source}`").alias("source"), F.regexp_count(said, F.lit(WORD)).cast("long").alias("size"), F.length(said).alias("chars"), uniform.alias("uniform"), given)
    usual = quality_weight(F.col("chars"), F.col("size")) if weight is None else F.when((F.col("weight") > 0) & ~F.isnan("weight"), F.greatest("weight", F.lit(LEAST))).otherwise(LEAST)
    return rows.select(*[f"_carry{k}" for k in range(len(carry))], "source", "size", (-F.log("uniform") / usual).alias("draw"))


def _level(sources: DataFrame) -> float:
    """The words a unit of weight at which sources that don't stop at ``most`` share what the others leave."""
    everything, weights = sources.agg(F.sum("source_size"), F.sum("w")).first()
    level = everything / weights
    while True:
        stops = F.col("most") / F.col("w") <= level
        before, left = sources.agg(F.sum(F.when(stops, F.col("most"))), F.sum(F.when(~stops, F.col("w")))).first()
        higher = (everything - (before or 0.0)) / left if left else level
        if not higher > level:
            return level
        level = higher


def targets(rows: DataFrame) -> DataFrame:
    """Per source: ``place``, ``source_size``, ``target``, ``epochs``, the words left ``rest``, the number ``groups`` of keys and the quantiles ``knots`` of its draws."""
    shares = F.array(*[F.lit(k / KNOTS) for k in range(1, KNOTS)])
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"), F.percentile_approx("draw", shares, 1000).alias("knots"))
    placed = row_numbers(sums.withColumn("none", F.col("source").isNull()), "none", "source", name="place")
    weighed = written(placed.withColumn("w", F.col("place") % 3 + 1).withColumn("most", (MOST * F.col("source_size")).cast("double")), "sources")
    level = 0.0 if weighed.isEmpty() else _level(weighed)
    capped = weighed.withColumn("target", F.when(F.col("most") / F.col("w") <= level, F.col("most")).otherwise(F.lit(level) * F.col("w")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    return capped.withColumn("epochs", epochs).select("source", "place", "source_size", "target", "epochs", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest"), F.greatest(F.ceil(F.col("n") / GROUP), F.lit(1)).alias("groups"), "knots")


def _group() -> Column:
    """The group of a key: by straight lines between the quantiles, and beyond the last one by an exponential tail."""
    draw, knots = F.col("draw"), F.col("knots")
    at = F.size(F.filter(knots, lambda q: q <= draw))
    low, last = F.coalesce(F.get(knots, at - 1), F.lit(0.0)), F.element_at(knots, -1)
    high = F.get(knots, at)
    tail = 1 - F.exp(-(draw - last) / F.greatest(last / 4, F.lit(1e-300)))
    inside = F.when(high.isNull(), tail).when(high > low, (draw - low) / (high - low)).otherwise(0.0)
    return F.least(F.floor((at + inside) / KNOTS * F.col("groups")), F.col("groups") - 1)


def _crossing(sums: DataFrame, part: str) -> DataFrame:
    """Of every source the part in whose running sum, from ``start`` on, the words that are left end, with the sum ``before`` it."""
    to_here = F.col("start") + F.sum("size").over(Window.partitionBy("place").orderBy(part))
    return sums.withColumn("before", to_here - F.col("size")).where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("size") >= F.col("rest")))


def selections(rows: DataFrame) -> DataFrame:
    """:func:`targets` with ``end``, the group in which the source's selection ends, and ``draw``, the last key it takes there; null if none."""
    plan = written(targets(rows), "targets")
    grouped = rows.join(plan, rows.source.eqNullSafe(plan.source)).where("rest > 0").select("place", "rest", "size", "draw", _group().alias("group"))
    run = F.floor(F.col("group") / SUPER).alias("run")
    sums = written(grouped.groupBy("place", "rest", "group").agg(F.sum("size").alias("size")).select("*", run), "group-sums")
    runs = _crossing(sums.groupBy("place", "rest", "run").agg(F.sum("size").alias("size")).withColumn("start", F.lit(0)), "run")
    inner = sums.join(runs.select("place", "run", F.col("before").alias("start")), ["place", "run"])
    crossing = written(_crossing(inner, "group").select("place", "group", "before"), "crossing")
    inside = grouped.join(crossing, ["place", "group"]).groupBy("place", "rest", "before", "draw").agg(F.sum("size").alias("size"))
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("place").orderBy("draw"))
    fits = inside.withColumn("upto", upto).where(2 * F.col("upto") - F.col("size") <= 2 * F.col("rest"))
    ends = fits.groupBy("place").agg(F.max("draw").alias("draw"))
    return written(plan.join(crossing.select("place", F.col("group").alias("end")), "place", "left").join(ends, "place", "left"), "selections")


def _times(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` of :func:`sized` with ``source_size``, ``target`` and ``times``: how often the mix takes the row."""
    named = plan.select(F.col("source").alias("_source"), "source_size", "target", "epochs", "groups", "knots", "end", F.col("draw").alias("last"))
    group = _group()
    partly = F.coalesce((group < F.col("end")) | ((group == F.col("end")) & (F.col("draw") <= F.col("last"))), F.lit(False))
    return rows.join(named, rows.source.eqNullSafe(named._source)).withColumn("times", (F.col("epochs") + partly.cast("int")).cast("int"))


def decided(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weight: Column | None = None) -> DataFrame:
    """Per row: ``key``, ``size``, ``source_size``, ``target`` and the words ``taken``."""
    with scratch() as keep:
        rows = keep(written(sized(docs, text, key, source, carry=(F.col(f"`{key}`"),), weight=weight), "sizes"))
        plan = keep(selections(rows))
    taken = (F.col("size") * F.col("times")).cast("long").alias("taken")
    return _times(rows, plan).select(F.col("_carry0").alias(key), "size", "source_size", "target", taken)


def mixed(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weight: Column | None = None) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; documents without words go."""
    with scratch() as keep:
        plan = keep(selections(written(sized(docs, text, key, source, weight=weight), "sizes")))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = _times(sized(docs, text, key, source, carry=(whole,), weight=weight), plan).where("size > 0 AND times > 0")
    return rows.select(F.explode(F.array_repeat("_carry0", F.col("times"))).alias("row")).select("row.*")
