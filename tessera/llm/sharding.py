"""Shards of equal bytes by histogram sort.

Rows have the key (MD5 of the text, MD5 of the id), so equal texts stand together, and
a shard is a range of keys. The splitters are found without sorting: the exact bytes
below evenly spaced probes of the key space are counted on all partitions, the interval
that holds each splitter's target gets new probes inside, and so on until an interval's
bytes are within the tolerance or it holds a single key, which its least and greatest key tell. A hot text is one value of the
first half of the key, so the search goes on in the second half. Then rows are
exchanged once, to their place in their shard.

Splitter j stands before the first key whose bytes' middle is at j shares of all bytes
or above (with tolerance 0, exactly there). Rows that agree in text and id are one key
and stay together. A null text has no bytes and the key of an empty text, a null id that
of an empty string. Slots number the rows of a shard from 0 without gaps, by a hash of
the id, then by key; they are counted in groups of about ``GROUP_ROWS`` rows, as many as the
table needs, never a whole shard in one task.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log2
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.lines import small
from tessera.llm.storage import scratch, written

#: Bits of each half of a key, and bits by which a round refines an interval.
BITS = 60
FIRST, NEXT = 12, 8
OVERHEAD = 8
#: Groups of slots in each shard, at least, and rows of a group if there are more.
SLOT_GROUPS, GROUP_ROWS = 64, 1 << 18


def _half(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def keyed(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row ``key``, ``size``, ``text_crc32`` and the halves ``k1``, ``k2`` of the sort key."""
    said = F.coalesce(F.col(text), F.lit(""))
    named = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return docs.select(
        F.col(key),
        (F.octet_length(said) + OVERHEAD).cast("long").alias("size"),
        F.crc32(said.cast("binary")).alias("text_crc32"),
        _half(said).alias("k1"),
        _half(named).alias("k2"),
    )


class Interval:
    """Keys that agree with ``k1`` above ``bits1`` free bits and, at 0 of those, with ``k2`` above ``bits2``; ``below``: bytes before it."""

    def __init__(self, k1: int, bits1: int, k2: int, bits2: int, below: int, size: int):
        self.k1, self.bits1, self.k2, self.bits2, self.below, self.size = k1, bits1, k2, bits2, below, size

    def refined(self, step: int) -> tuple[int, int, int]:
        """The half that the next probes are in, their number's bits, and the free bits they leave."""
        if self.bits1:
            take = min(step, self.bits1)
            return 1, take, self.bits1 - take
        take = min(step, self.bits2)
        return 2, take, self.bits2 - take

    @property
    def single(self) -> bool:
        return not (self.bits1 or self.bits2)


def _inside(at: Interval) -> Column:
    inside = F.shiftright("k1", at.bits1) == (at.k1 >> at.bits1)
    return inside if at.bits1 else inside & (F.shiftright("k2", at.bits2) == (at.k2 >> at.bits2))


def histogram(rows: DataFrame, intervals: list[Interval], step: int) -> dict[int, list[tuple[int, int, tuple[int, int] | None]]]:
    """For each interval by its place: the bytes in each of its 2**step parts that has rows, in order, with the part's key if it has but one."""
    pieces = []
    for place, at in enumerate(intervals):
        half, take, left = at.refined(step)
        inside = _inside(at)
        part = F.shiftright(f"k{half}", left).bitwiseAND(F.lit((1 << take) - 1))
        pieces.append(F.when(inside, part + (place << step)))
    counted = rows.select(F.coalesce(*pieces).alias("part"), "size", F.struct("k1", "k2").alias("key")).where("part IS NOT NULL").groupBy("part").agg(F.sum("size").alias("size"), F.min("key").alias("low"), F.max("key").alias("high"))
    found: dict[int, list[tuple[int, int, tuple[int, int] | None]]] = {}
    for r in sorted(counted.collect()):
        only = tuple(r["low"]) if r["low"] == r["high"] else None
        found.setdefault(r["part"] >> step, []).append((r["part"] & ((1 << step) - 1), r["size"], only))
    return found


def splitters(rows: DataFrame, shards: int, tolerance: int = 0) -> list[tuple[int, int]]:
    """The first key of shards 1 and on: a row belongs to the last shard whose splitter isn't above its key.

    Each round collects at most ``2**FIRST`` or ``shards * 2**NEXT`` counts. After two
    rounds only the rows in open intervals are read. A search ends where an interval's
    bytes are within ``tolerance``; with 0 it ends at single keys, and shards are exact.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    whole = Interval(0, BITS, 0, BITS, 0, total)
    open_, out = {j: whole for j in range(1, shards)}, {}
    step, rounds = FIRST, 0
    while open_:
        distinct = list({id(i): i for i in open_.values()}.values())
        parts = histogram(rows, distinct, step)
        nexts = {}
        for place, at in enumerate(distinct):
            half, _, left = at.refined(step)
            below, inner = at.below, []
            for part, size, only in parts.get(place, []):
                if only:
                    inner.append(Interval(only[0], 0, only[1], 0, below, size))
                elif half == 1:
                    inner.append(Interval(at.k1 | part << left, left, 0, BITS, below, size))
                else:
                    inner.append(Interval(at.k1, 0, at.k2 | part << left, left, below, size))
                below += size
            nexts[id(at)] = inner
        still = {}
        for j, at in open_.items():
            target = total * j  # shares are compared times the number of shards
            inner = nexts[id(at)]
            k = next((k for k, i in enumerate(inner) if (2 * i.below + i.size) * shards >= 2 * target), None)
            # the splitter is in the first part that reaches the target, unless its middle lies below
            hit = next((k for k, i in enumerate(inner) if (i.below + i.size) * shards >= target), None)
            if hit is None:
                out[j] = (at.k1 + (1 << at.bits1), 0) if at.bits1 else (at.k1, at.k2 + (1 << at.bits2))
            elif inner[hit].single or inner[hit].size <= tolerance:
                first = inner[hit] if k == hit else inner[hit + 1] if hit + 1 < len(inner) else None
                out[j] = (first.k1, first.k2) if first else _behind(at, inner[hit])
            else:
                still[j] = inner[hit]
        open_, step, rounds = still, NEXT, rounds + 1
        if rounds == 2 and open_:  # what lies outside has been counted
            inside = [_inside(at) for at in {id(i): i for i in open_.values()}.values()]
            rows = written(rows.where(reduce(or_, inside)).select("k1", "k2", "size"), "open-keys", hashes=True)
    return [out[j] for j in range(1, shards)]


def _behind(outer: Interval, last: Interval) -> tuple[int, int]:
    """The smallest key behind the interval ``last``, the last with rows in ``outer``."""
    if last.bits1:
        return last.k1 + (1 << last.bits1), 0
    return last.k1, last.k2 + (1 << last.bits2)


def shards(docs: DataFrame, count: int, text: str = "text", key: str = "doc_id", tolerance: int = 0) -> DataFrame:
    """Per row: ``key``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard`` (null: shards of equal bytes move when their number changes)."""
    with scratch() as keep:
        rows = keep(written(keyed(docs, text, key), "keys"))
        ends = splitters(rows, count, tolerance)
        groups = 1 << max(ceil(log2(SLOT_GROUPS)), ceil(log2(max(1, rows.count() / (count * GROUP_ROWS)))))
        behind = [((F.col("k1") > k1) | ((F.col("k1") == k1) & (F.col("k2") >= k2))).cast("int") for k1, k2 in ends]
        shard = reduce(add, behind, F.lit(0)).alias("shard")
        dealt = rows.select("*", shard, F.col("k2").bitwiseAND(F.lit(groups - 1)).cast("int").alias("group"))
        sizes = dealt.groupBy("shard", "group").agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.partitionBy("shard").orderBy("group")) - F.col("n")
        offsets = small(keep(written(sizes.select("shard", "group", before.alias("before")), "offsets")))
    inside = F.row_number().over(Window.partitionBy("shard", "group").orderBy("k1", "k2", key)) - 1
    placed = dealt.withColumn("inside", inside).join(offsets, ["shard", "group"])
    return placed.select(key, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("inside") + F.col("before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
