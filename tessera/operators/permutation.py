"""Shuffled epochs by arithmetic: a keyed permutation of the row numbers 0 to n - 1.

A number is split over a grid of about sqrt(n) by sqrt(n) cells, and the two parts are mixed in
``ROUNDS`` rounds, each of which adds a keyed function of one part to the other (a Feistel
network). That permutes the grid, which has a few cells more than n; a number that lands
behind n - 1 goes through again until it doesn't, which permutes 0 to n - 1. How often that
can be needed is counted beforehand for the cells behind n - 1, at most about sqrt(n) of them.

So the place of a row in an epoch is computed in the row: an epoch needs no sort, no exchange
and no written table, all epochs share one numbering, and a run resumes at any batch. The
other way round, :func:`rows_at` names the rows of a batch without reading any.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIME = (1 << 31) - 1
ROUNDS = 6


def keys(seed: int, epoch: int) -> list[tuple[int, int, int]]:
    """Of each round three numbers below the prime: what is added before the square, the factor and what is added behind it."""
    out = []
    for k in range(ROUNDS):
        digest = hashlib.md5(f"{seed}/{epoch}/{k}".encode()).digest()
        a, b, c = (int.from_bytes(digest[i : i + 4], "big") % (PRIME - 1) + 1 for i in (0, 4, 8))
        out.append((a, b, c))
    return out


def sides(n: int) -> tuple[int, int]:
    """The sides of a grid of at least ``n`` cells; the second one is how many numbers follow before the first part goes on."""
    wide = max(1, int(np.ceil(np.sqrt(n))))
    return -(-max(n, 1) // wide), wide


def _mixed(x, key: tuple[int, int, int]):
    a, b, c = key
    square = (x + a) % PRIME
    return (square * square % PRIME * b + c) % PRIME


def once(x: np.ndarray, n: int, seed: int, epoch: int) -> np.ndarray:
    """The permutation of the grid."""
    high, wide = sides(n)
    left, right = x // wide, x % wide
    for k, key in enumerate(keys(seed, epoch)):
        left, right = right, (left + _mixed(right, key)) % (wide if k % 2 else high)
    return left * wide + right


def back(x: np.ndarray, n: int, seed: int, epoch: int) -> np.ndarray:
    """The inverse of :func:`once`."""
    high, wide = sides(n)
    left, right = x // wide, x % wide
    for k, key in reversed(list(enumerate(keys(seed, epoch)))):
        left, right = (right - _mixed(left, key)) % (wide if k % 2 else high), left
    return left * wide + right


def walks(n: int, seed: int, epoch: int) -> int:
    """How often a number below ``n`` may have to go through again: the longest way through the cells behind. What goes round among those cells for ever is never reached from before, and as long as there are ways, some end at every step."""
    high, wide = sides(n)
    out, steps = np.arange(n, high * wide), 0
    while True:
        left = once(out, n, seed, epoch)
        left = left[left >= n]
        if len(left) == len(out):
            return steps
        out, steps = left, steps + 1


def place_of(row: Column, n: int, seed: int, epoch: int) -> Column:
    """The place of a row number in the order of an epoch."""
    high, wide = sides(n)
    rounds = F.array(*[F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip("abcm", (*key, wide if k % 2 else high), strict=True)]) for k, key in enumerate(keys(seed, epoch))])

    def through(x: Column) -> Column:
        right = x % wide
        start = F.struct(((x - right) / wide).cast("long").alias("l"), right.cast("long").alias("r"))

        def step(s: Column, k: Column) -> Column:
            square = (s["r"] + k["a"]) % PRIME
            mixed = (square * square % PRIME * k["b"] + k["c"]) % PRIME
            return F.struct(s["r"].alias("l"), ((s["l"] + mixed) % k["m"]).alias("r"))

        return F.aggregate(rounds, start, step, lambda s: s["l"] * wide + s["r"])

    first = through(row.cast("long"))
    again = walks(n, seed, epoch)
    return F.aggregate(F.sequence(F.lit(1), F.lit(again)), first, lambda x, _: F.when(x >= n, through(x)).otherwise(x)) if again else first


def rows_at(places: np.ndarray, n: int, seed: int, epoch: int) -> np.ndarray:
    """The row numbers that stand at places of an epoch."""
    out = back(np.asarray(places, np.int64), n, seed, epoch)
    while (behind := out >= n).any():
        out[behind] = back(out[behind], n, seed, epoch)
    return out


def permuted_batches(df: DataFrame, size: int, epochs: int, seed: int, order: str = "row_idx", done: int = 0) -> DataFrame:
    """Every row once an epoch with ``epoch``, ``place`` and ``batch``, in an order of the epoch's own; an incomplete last batch goes, and so do the first ``done`` batches over all epochs.

    ``order`` holds the row numbers 0 to n - 1.
    """
    n = df.count()
    whole = n // size
    out = []
    for epoch in range(done // whole if whole else epochs, epochs):
        placed = df.withColumn("place", place_of(F.col(order), n, seed, epoch))
        batch = F.floor(F.col("place") / size).cast("int")
        out.append(placed.withColumns({"epoch": F.lit(epoch), "batch": batch}).where((F.col("batch") < whole) & (F.col("batch") + epoch * whole >= done)))
    empty = df.where("false").withColumns({"place": F.lit(0).cast("long"), "epoch": F.lit(0), "batch": F.lit(0)})
    return reduce(DataFrame.unionByName, out) if out else empty


def batch_rows(n: int, size: int, seed: int, batch: int) -> np.ndarray:
    """The row numbers of a batch, counted over all epochs, in order."""
    whole = n // size
    epoch, inside = divmod(batch, whole)
    return rows_at(np.arange(inside * size, (inside + 1) * size), n, seed, epoch)


def sql_place(row: str, seed: int, epoch: int, again: int = 8) -> str:
    """DuckDB SQL of :func:`place_of` beside columns ``n``, ``high`` and ``wide``; a number goes through at most ``again`` times more."""
    key = ", ".join(f"{{'l': 0::BIGINT, 'r': 0::BIGINT, 'a': {a}::BIGINT, 'b': {b}::BIGINT, 'c': {c}::BIGINT, 'm': {'wide' if k % 2 else 'high'}}}" for k, (a, b, c) in enumerate(keys(seed, epoch)))
    square = f"((s.r + k.a) % {PRIME}) * ((s.r + k.a) % {PRIME}) % {PRIME}"
    step = f"{{'l': s.r, 'r': (s.l + ({square} * k.b + k.c) % {PRIME}) % k.m, 'a': k.a, 'b': k.b, 'c': k.c, 'm': k.m}}"
    through = lambda x: f"list_transform([list_reduce(list_prepend({{'l': ({x}) // wide, 'r': ({x}) % wide, 'a': 0::BIGINT, 'b': 0::BIGINT, 'c': 0::BIGINT, 'm': 0::BIGINT}}, [{key}]), lambda s, k: {step})], lambda z: z.l * wide + z.r)[1]"
    out = through(row)
    for _ in range(again):
        out = f"list_transform([{out}], lambda y: CASE WHEN y >= n THEN {through('y')} ELSE y END)[1]"
    return out
