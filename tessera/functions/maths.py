"""Scalar formulas of scores and sizes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit(x: Column) -> Column:
    """``x`` within 0 and 1."""
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))


def from_distance(d: Column, tau: float = 0.3) -> Column:
    """exp(-max(0, d) / tau); 0 for what isn't finite."""
    if tau <= 0:
        return F.lit(0.0)
    finite = d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf"))
    return F.when(finite, F.exp(-F.greatest(d, F.lit(0.0)) / tau)).otherwise(0.0)


def held(x: Column, hold: float = 0.8) -> Column:
    """What of ``x`` lies above ``hold``, as a share of what can."""
    return unit((x - hold) / (1 - hold))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null for zero vectors."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    size = norm(a) * norm(b)
    return dot / F.when(size > 0, size)


def eval_similarity(c: Column) -> Column:
    return unit(c)


def reward_similarity(c: Column) -> Column:
    return (c + 1) / 2


def visual(semantic: Column, structural: Column, ws: float = 0.4, wl: float = 0.6, hold: float = 0.8) -> Column:
    """Weighted score of both similarities; weights without a positive sum are 0.4 and 0.6."""
    if ws + wl <= 0:
        ws, wl = 0.4, 0.6
    return unit((ws * held(semantic, hold) + wl * structural) / (ws + wl))


def code_score(bleu: Column, edit: Column) -> Column:
    return unit(0.7 * bleu + 0.3 * edit)


def overlong(length: Column, most: int, buffer: int) -> Column:
    """0 up to the expected length, then linear to -1 at ``most``, and -1 beyond."""
    expected = most - buffer
    return F.when(length <= expected, 0.0).when(length <= most, (expected - length) / buffer).otherwise(-1.0)


def resized(width: Column, height: Column, most: int | None = None, least: int | None = None) -> Column:
    """Struct of ``w`` and ``h``, brought to an area of at most ``most``, then of at least ``least``."""
    if most:
        factor = F.sqrt(F.lit(float(most)) / (width * height))
        large = width * height > most
        width, height = (F.when(large, (x * factor).cast("int")).otherwise(x) for x in (width, height))
    if least:
        factor = F.sqrt(F.lit(float(least)) / (width * height))
        small = width * height < least
        width, height = (F.when(small, (x * factor).cast("int")).otherwise(x) for x in (width, height))
    return F.struct(width.alias("w"), height.alias("h"))


def points_to_pixels(points: Column, density: int) -> Column:
    """Half-way cases go to the even number."""
    return F.rint(points * density / 72).cast("int")


def ceildiv(a: Column, b: int) -> Column:
    return -F.floor(-a / b)


def number(x: Column, default: float | None = None) -> Column:
    """A finite number, else ``default``."""
    x = x.try_cast("double")
    return F.coalesce(F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x), F.lit(default).cast("double"))


def warmup_constant(step: Column, warmup: int) -> Column:
    """A learning rate's factor: linear up to 1 at ``warmup`` steps, then 1."""
    return F.when(step < warmup, F.least(step / max(1, warmup), F.lit(1.0))).otherwise(1.0)


def warmup_cosine(step: Column, warmup: int, total: int, least: float = 0.0, cycles: float = 0.5, first: float = 0.0) -> Column:
    """A learning rate's factor: linear from ``first`` to 1, then half-waves of a cosine between 1 and ``least``."""
    if not 0 <= least <= 1:
        raise ValueError("the least factor lies within 0 and 1")
    rise = first + (1 - first) * step / max(1, warmup)
    wave = F.cos(2 * math.pi * cycles * (step - warmup) / max(1, total - warmup))
    return F.when(step < warmup, rise).otherwise(F.greatest(F.lit(float(least)), wave * (1 - least) / 2 + (1 + least) / 2))


def edit_count(normed: Column, reference_tokens: Column) -> Column:
    return normed * F.greatest(reference_tokens, F.lit(1))
