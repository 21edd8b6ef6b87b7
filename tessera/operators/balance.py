"""Balanced partitions of items by their lengths.

The largest-differencing method merges whole candidate solutions and is sequential by
nature. :func:`balanced` runs it in two levels: the items of a group, longest first, are dealt
to blocks of about ``BLOCK``, each of which is solved by itself, and then solutions
are merged two by two, the heaviest set of one with the lightest of the other, on the sums of
the sets alone. A group of up to two blocks is one block, and solved as the method is
defined. Merging two solutions never makes the spread wider than that of the worse one, which
for a block is its longest item at most; so that bound holds at every size.

:func:`dealt` hands a whole group to a function, for rules that have no parts; a group
of more than ``MOST`` items is refused.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.filters import row_numbers, running_sums
from tessera.shipping import ship
from tessera.sources.scratch import kept

MOST = 1_000_000
BLOCK = 4096


class _Solution:
    """``k`` sets of items, each (sum, number, items as (place, length) in the order they came), the heaviest first."""

    def __init__(self, sets: list[tuple[int, int, list[tuple[int, int]]]]):
        self.sets = sorted(sets, reverse=True)
        self.spread = self.sets[0][0] - self.sets[-1][0]

    def __lt__(self, other: _Solution) -> bool:
        """Comes first: the wider spread, then the greater first set."""
        return (self.spread, self.sets[0]) > (other.spread, other.sets[0])

    def merged(self, other: _Solution) -> _Solution:
        """The heaviest set of one with the lightest of the other, and so on."""
        return _Solution([tuple(p + q for p, q in zip(x, y, strict=True)) for x, y in zip(self.sets, reversed(other.sets), strict=True)])


def differenced(lengths: list[int], k: int, equal: bool = False) -> list[list[int]]:
    """``k`` sets of places with sums as equal as the largest-differencing method makes them; ``equal``: as many places in each.

    Of two candidates of equal spread the one with the greater first set goes first; sets
    compare by sum, number and items.
    """
    n = len(lengths)
    if k < 1 or n < k or (equal and n % k):
        raise ValueError(f"{n} items don't go into {k} sets")
    order = sorted(range(n), key=lambda i: (lengths[i], i))
    groups = [order[i : i + k] for i in range(0, n, k)] if equal else [[i] for i in order]
    heap = [_Solution([(lengths[i], 1, [(i, lengths[i])]) for i in group] + [(0, 0, [])] * (k - len(group))) for group in groups]
    heapq.heapify(heap)
    while len(heap) > 1:
        first, second = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, first.merged(second))
    return checked([[i for i, _ in s[2]] for s in heap[0].sets], n, equal)


def greedy(lengths: list[int], k: int, equal: bool = False) -> list[list[int]]:
    """Each item in input order to the set of least sum, the first of equal ones; ``equal``: every item weighs so much more that the sets' numbers stay level. Raises if they aren't equal then."""
    more = sum(lengths) + 1 if equal else 0
    heap, sets = [(0, j) for j in range(k)], [[] for _ in range(k)]
    for i, length in enumerate(lengths):
        total, j = heapq.heappop(heap)
        sets[j].append(i)
        heapq.heappush(heap, (total + length + more, j))
    if equal and len({len(s) for s in sets}) > 1:
        raise AssertionError("sets of different numbers")
    return sets


def checked(sets: list[list[int]], n: int, equal: bool) -> list[list[int]]:
    """Sorted sets; raises if one is empty, a place is missing or twice, or equal sizes aren't."""
    flat = sorted(i for s in sets for i in s)
    if flat != list(range(n)) or not all(sets) or (equal and len({len(s) for s in sets}) > 1):
        raise AssertionError("not a partition")
    return [sorted(s) for s in sets]


def dealt(df: DataFrame, length: str, deal, group: str | None = None, order: str = "row_idx") -> DataFrame:
    """``df`` with ``part``, the number of the set that ``deal(lengths)`` puts each row in, within its group if there is one; the lengths come in ``order``."""
    ship(df.sparkSession)
    own = F.col(group) if group else F.lit(0)
    items = df.select(own.alias("g"), F.col(order).cast("long").alias("i"), F.col(length).cast("long").alias("n"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        if len(part) > MOST:
            raise ValueError(f"a batch of {len(part)} items; at most {MOST}, or give a group")
        part = part.sort_values("i", ignore_index=True)
        where = pd.Series(0, index=part.index)
        for j, places in enumerate(deal(part["n"].tolist())):
            where.iloc[places] = j
        return part.assign(part=where.astype("int32"))[["g", "i", "part"]]

    kind = items.schema["g"].dataType.simpleString()
    found = items.groupBy("g").applyInPandas(run, f"g {kind}, i long, part int").withColumnsRenamed({"g": "_g", "i": "_i"})
    match = F.col(order).cast("long") == F.col("_i")
    return df.join(found, match & F.col(group).eqNullSafe(F.col("_g")) if group else match).drop("_g", "_i")


def balanced(df: DataFrame, length: str, k: int, group: str | None = None, order: str = "row_idx", equal: bool = False, block: int = BLOCK) -> DataFrame:
    """``df`` with ``part``: the set of each row of its group, by differencing in blocks and merging the blocks' sets; a group has ``k`` items at least, and with ``equal`` a number that ``k`` divides."""
    ship(df.sparkSession)
    size = -(-block // k) * k
    own = F.col(group) if group else F.lit(0)
    items = df.select(own.alias("g"), F.col(order).cast("long").alias("i"), F.col(length).cast("long").alias("n")).withColumn("falling", -F.col("n")).withColumn("none", F.col("g").isNull())
    placed = kept(row_numbers(items, "none", "g", "falling", "i", name="at"))
    groups = kept(placed.groupBy("g").agg(F.min("at").alias("first"), F.greatest(F.floor(F.count("*") / size), F.lit(1)).cast("long").alias("blocks")))
    named = groups.withColumnRenamed("g", "_g")
    block_ = F.least(F.floor((F.col("at") - F.col("first")) / size).cast("long"), F.col("blocks") - 1)
    blocks = placed.join(named, F.col("g").eqNullSafe(F.col("_g"))).select("g", "i", "n", block_.alias("block"))
    kind = blocks.schema["g"].dataType.simpleString()

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("i", ignore_index=True)
        where = pd.Series(0, index=part.index)
        for j, places in enumerate(differenced(part["n"].tolist(), k, equal)):
            where.iloc[places] = j
        return part.assign(set=where.astype("int32"))[["g", "block", "i", "n", "set"]]

    solved = kept(blocks.groupBy("g", "block").applyInPandas(run, f"g {kind}, block long, i long, n long, set int"))
    sets = solved.groupBy("g", "block", "set").agg(F.sum("n").alias("s"))
    maps = []
    left = groups.agg(F.max("blocks")).first()[0] or 1
    while left > 1:  # the heavier sets of even blocks meet the lighter ones of odd blocks
        pair = Window.partitionBy("g", "block")
        falls = F.row_number().over(pair.orderBy(F.desc("s"), "set"))
        last = F.col("block") % 2 == 1
        met = F.when(last, k - falls).otherwise(falls - 1).cast("int")
        maps.append(kept(sets.select("g", "block", "set", "s", F.floor(F.col("block") / 2).cast("long").alias("to_block"), met.alias("to_set"))))
        sets = maps[-1].groupBy("g", F.col("to_block").alias("block"), F.col("to_set").alias("set")).agg(F.sum("s").alias("s"))
        left = -(-left // 2)
    found = solved.select("g", "i", "block", F.col("set").alias("part"))
    if maps:
        ends = maps[-1].select("g", "block", "set", F.col("to_set").alias("part"))
        for way in reversed(maps[:-1]):
            above = ends.withColumnsRenamed({"g": "_g", "block": "to_block", "set": "to_set"})
            ends = way.join(above, way.g.eqNullSafe(above["_g"]) & (way.to_block == above.to_block) & (way.to_set == above.to_set)).select("g", "block", "set", "part")
        ends = ends.withColumnsRenamed({"g": "_g", "block": "_b", "set": "_s"})
        found = solved.join(ends, solved.g.eqNullSafe(ends["_g"]) & (solved.block == ends["_b"]) & (solved.set == ends["_s"])).select("g", "i", "part")
    found = found.select(F.col("g").alias("_g"), F.col("i").alias("_i"), "part")
    match = F.col(order).cast("long") == F.col("_i")
    return df.join(found, match & F.col(group).eqNullSafe(F.col("_g")) if group else match).drop("_g", "_i")


def snaked(df: DataFrame, length: str, k: int, order: str = "row_idx") -> DataFrame:
    """``df`` with ``part``: rows from the longest to the shortest dealt to ``k`` sets forth and back, which any number of tasks can do."""
    falling = row_numbers(df.withColumn("_falling", -F.col(length)), "_falling", order, name="_at").drop("_falling")
    turn = F.col("_at") % (2 * k)
    return falling.withColumn("part", F.least(turn, 2 * k - 1 - turn).cast("int")).drop("_at")


def micro_batches(lengths: list[int], most: int) -> list[list[int]]:
    """min(n, ceil(sum / most)) sets, the heaviest by squared lengths first; no length may be above ``most``."""
    if lengths and max(lengths) > most:
        raise ValueError(f"a length of {max(lengths)} is above {most}")
    k = min(len(lengths), -(-sum(lengths) // most))
    sets = differenced(lengths, k)
    return sorted(sets, key=lambda s: (sum(lengths[i] ** 2 for i in s), min(s)), reverse=True)


def restored(values: list, sets: list[list[int]]) -> list:
    """Values in the order of the sets, back in the order of the places."""
    out = [None] * len(values)
    for value, place in zip(values, (i for s in sets for i in s), strict=True):
        out[place] = value
    return out


def ordered(df: DataFrame, order: str = "row_idx", part: str = "part") -> DataFrame:
    """Rows dealt to sets with ``new_idx``, their place when set stands behind set: what :func:`tessera.operators.relational.reordered` takes."""
    sizes = running_sums(df.groupBy(F.col(part).alias("_p")).count(), "count", "_p", name="_upto")
    inside = F.row_number().over(Window.partitionBy(part).orderBy(order)) - 1
    placed = df.withColumn("_in", inside).join(sizes.select("_p", (F.col("_upto") - F.col("count")).alias("_before")), F.col(part) == F.col("_p"))
    return placed.withColumn("new_idx", F.col("_before") + F.col("_in")).drop("_before", "_in", "_p")


def imbalance(df: DataFrame, length: str, k: int, order: str = "row_idx", part: str = "part") -> DataFrame:
    """One row: ``min``, ``max``, ``minmax_diff`` of the sums of runs of n // ``k`` rows as they come, ``balanced_min``, ``balanced_max`` of those of the sets in ``part``, and ``mean``."""
    size = max(1, df.count() // k)
    sums = df.groupBy(F.floor(F.col(order) / size).alias("_run")).agg(F.sum(length).alias("s"))
    plain = sums.agg(F.min("s").alias("min"), F.max("s").alias("max"), (F.max("s") - F.min("s")).alias("minmax_diff"), (F.sum("s") / k).alias("mean"))
    even = df.groupBy(part).agg(F.sum(length).alias("s")).agg(F.min("s").alias("balanced_min"), F.max("s").alias("balanced_max"))
    return plain.crossJoin(F.broadcast(even))
